"""Token ids in Arrow files: fixed-size lists of ids and masks, read back without copying.

Format. A shard is two Arrow IPC files (the stream format with a footer, so any batch can be opened by number).
``tokens-*.arrow`` has one row for each sequence of ``seq_len`` ids: ``ids`` is a fixed-size list of unsigned 16- or
32-bit ids, ``mask`` a fixed-size list of bits, set for an id and not for padding, which only the last row of a shard
has. Every batch but the last has ``ROWS`` rows, so sequence k is row k % ROWS of batch k // ROWS, and as nothing is
compressed, ids and masks of a mapped file are views of it. ``index-*.arrow`` has doc_id, start and length of each
document, counted in ids from the shard's first.

Shards hold ranges of ascending ids. A manifest table names the finished files; a file left by a lost or repeated
task is in no manifest, so it is never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.tables import documents, partitions, prepare, shared_folder, stored
from tapeloom.llm.vocab import default_path, encoder

#: Rows of a batch: with 2048 ids of two bytes, 1 MB.
ROWS = 256
SEQ_LEN = 2048
#: Bytes of text that a shard aims at.
SHARD_BYTES = 64 << 20

MANIFEST = "shard int, tokens_file string, index_file string, n_docs long, n_ids long"
DIGEST = "doc_id long, shard_start long, n_tokens long, ids_crc32 long"


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


def open_arrow(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    """Map a file of the local file system, open any other."""
    files, top = file_system(folder)
    path = f"{top}/{name}"
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(files, pafs.LocalFileSystem) else files.open_input_file(path))


class ShardWriter:
    """Writes one shard, batch by batch; the files get their names once they are whole."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, seq_len: int) -> None:
        self.files, self.top = file_system(folder)
        self.shard, self.dtype, self.seq_len = shard, dtype, seq_len
        tag = f"{shard:06d}-{uuid.uuid4().hex}.arrow"
        self.names = (f"tokens-{tag}", f"index-{tag}")
        ids = pa.from_numpy_dtype(dtype)
        self.row = pa.schema([("ids", pa.list_(pa.field("item", ids, nullable=False), seq_len)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), seq_len))])
        self.entry = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])
        self.outputs = [self.files.open_output_stream(f"{self.top}/.{n}") for n in self.names]
        self.writers = [pa.ipc.new_file(o, s) for o, s in zip(self.outputs, (self.row, self.entry), strict=True)]
        self.held: list[bytes] = []
        self.held_bytes = self.n_ids = self.n_docs = 0

    def add(self, doc_ids: pa.Array, encoded: list[bytes]) -> None:
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // self.dtype.itemsize
        starts = self.n_ids + np.cumsum(lengths) - lengths
        self.writers[1].write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(lengths)], schema=self.entry))
        self.n_ids += int(lengths.sum())
        self.n_docs += len(encoded)
        self.held += encoded
        self.held_bytes += int(lengths.sum()) * self.dtype.itemsize
        if self.held_bytes >= ROWS * self.seq_len * self.dtype.itemsize:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        step = ROWS * self.seq_len
        whole = len(flat) if last else len(flat) // step * step
        for at in range(0, whole, step):
            part = flat[at : min(at + step, whole)]
            n = -(-len(part) // self.seq_len)
            ids, mask = np.zeros(n * self.seq_len, self.dtype), np.zeros(n * self.seq_len, bool)
            ids[: len(part)] = part
            mask[: len(part)] = True
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=self.row.field(k).type) for k, x in enumerate((ids, mask))]
            self.writers[0].write_batch(pa.record_batch(arrays, schema=self.row))
        rest = flat[whole:].tobytes()
        self.held, self.held_bytes = ([rest] if rest else []), len(rest)

    def close(self) -> pa.RecordBatch:
        self._flush(last=True)
        for w, o, n in zip(self.writers, self.outputs, self.names, strict=True):
            w.close()
            o.close()
            self.files.move(f"{self.top}/.{n}", f"{self.top}/{n}")
        row = {"shard": [self.shard], "tokens_file": [self.names[0]], "index_file": [self.names[1]], "n_docs": [self.n_docs], "n_ids": [self.n_ids]}
        types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))


class Shard:
    """Random access to a shard's sequences, masks and documents; arrays are views of the mapped file."""

    def __init__(self, folder: str, tokens_file: str, index_file: str) -> None:
        self.tokens, self.index = open_arrow(folder, tokens_file), open_arrow(folder, index_file)
        self.seq_len = self.tokens.schema.field("ids").type.list_size

    def _flat(self, batch: int) -> np.ndarray:
        return self.tokens.get_batch(batch).column("ids").values.to_numpy(zero_copy_only=True)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence k; the mask is a slice of the mapped bits."""
        at = k % ROWS * self.seq_len
        bits = self.tokens.get_batch(k // ROWS).column("mask").values
        return self._flat(k // ROWS)[at : at + self.seq_len], bits.slice(at, self.seq_len)

    def documents(self) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        """Batches of the index, each with its documents' ids in one or more views."""
        step, number, flat = ROWS * self.seq_len, -1, np.zeros(0)
        for b in range(self.index.num_record_batches):
            batch = self.index.get_batch(b)
            found = []
            for start, length in zip(batch["start"].to_pylist(), batch["length"].to_pylist(), strict=True):
                views, at = [], start
                while at < start + length:
                    if at // step != number:
                        number, flat = at // step, self._flat(at // step)
                    views.append(flat[at % step : min(start + length - number * step, step)])
                    at += len(views[-1])
                found.append(views)
            yield batch, found


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 1, seq_len: int = SEQ_LEN, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all documents in ascending order of their ids (null first, then ties by text); return the stored manifest.

    A null or empty text has the end id alone; an empty table has no shard. Only the two named columns are read.
    """
    spark = prepare(docs.sparkSession)
    rows = documents(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(spark), -(-total // shard_bytes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, out = encoder(tokenizer_path, end_id), None
        for batch in batches:
            if batch.num_rows:
                out = out or ShardWriter(folder, TaskContext.get().partitionId(), code.dtype, seq_len)
                out.add(batch.column(0), code.encode_all(batch.column(1)))
        if out:
            yield out.close()

    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, MANIFEST), folder, "manifest")


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, read from the files.

    The running count over the manifest's few columns takes one row for each shard, not for each document.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    dealt = placed.repartitionByRange(partitions(manifest.sparkSession), "shard")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for index, found in Shard(folder, row["tokens_file"], row["index_file"]).documents():
                    crc = np.zeros(len(found), np.int64)
                    for k, views in enumerate(found):
                        value = 0
                        for view in views:
                            value = zlib.crc32(view.astype("<u4"), value)
                        crc[k] = value
                    starts = index["start"].to_numpy() + row["first"]
                    yield pa.record_batch([index["doc_id"], pa.array(starts), index["length"], pa.array(crc)], names=["doc_id", "shard_start", "n_tokens", "ids_crc32"])

    out = dealt.select("tokens_file", "index_file", "first").mapInArrow(digest, DIGEST)
    return out.select("doc_id", F.col("shard_start").alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write the documents to a new folder of token files and read them back."""
    folder = shared_folder(prepare(docs.sparkSession))
    return read_documents(write_token_files(docs, folder, tokenizer_path or default_path()), folder)
