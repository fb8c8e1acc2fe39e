"""Packing documents into sequences of bounded length by order-preserving dynamic programming.

Documents stay in order of their ids. A sequence is a window of the stream of ids, and a window may end after a
document (free), after a sentence, or, inside long sentences, at every ``GRID``-th id (both at a price in ids). With
p the end of a window that starts at q, the least cost is

    best[p] = price[p] + L - p + min over q in [p - L, p) of (best[q] + q)

and a monotone queue holds the minimum of the sliding range, so each possible cut is entered and left once. Windows
shorter than L are padded, but for the end of a partition's stream: a rest of r ids is cut into powers of two, which
need no padding, where this costs less than to pad it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import documents, partitions, prepare
from tapeloom.llm.vocab import default_path, encoder

SEQ_LEN = 2048
#: What a cut costs, in ids of padding: after a sentence, and inside one.
SENTENCE, INSIDE = 2, 8
#: Ids between possible cuts inside a sentence.
GRID = 32
#: Ids packed at a time; a partition needs memory for one block and its longest document.
BLOCK = 1 << 19
PARTITION_BYTES = 64 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def cut_points(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions where a window may end, from 0 to n, and their prices."""
    price = np.full(n + 1, -1, np.int64)
    price[sentence_ends] = SENTENCE
    price[doc_ends] = 0
    price[[0, n]] = 0
    at = np.flatnonzero(price >= 0)
    wide = np.diff(at) > GRID
    counts = (np.diff(at)[wide] - 1) // GRID
    if counts.sum():
        steps = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        inside = np.repeat(at[:-1][wide], counts) + steps * GRID
        price[inside] = INSIDE
        at = np.flatnonzero(price >= 0)
    return at, price[at]


@cache
def rest_cost(rest: int, seq_len: int) -> int:
    """Of the last ids of a stream: padding them, or cutting them into powers of two."""
    return min(seq_len - rest, INSIDE * (rest.bit_count() - 1))


def rest_lengths(rest: int, seq_len: int) -> list[int]:
    if seq_len - rest <= INSIDE * (rest.bit_count() - 1):
        return [rest]
    return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def best_cuts(at: np.ndarray, price: np.ndarray, seq_len: int, last: bool) -> list[int]:
    """Ends of the cheapest windows over positions ``at`` (gaps of at most ``seq_len``), first to last."""
    points, prices = at.tolist(), price.tolist()
    total, back = [0] * len(points), [0] * len(points)  # best + position of each cut
    queue, head, tail = [0] * len(points), 0, 0  # cuts with rising totals
    for k in range(1, len(points)):
        key = total[k - 1]
        while tail > head and total[queue[tail - 1]] >= key:
            tail -= 1
        queue[tail] = k - 1
        tail += 1
        reach = points[k] - seq_len
        while points[queue[head]] < reach:
            head += 1
        back[k] = q = queue[head]
        total[k] = total[q] + seq_len + prices[k]
    k = len(points) - 1
    if last and k:  # the last window may be cut into powers of two
        first = int(np.searchsorted(at, at[-1] - seq_len))
        back[k] = min(range(first, k), key=lambda q: (total[q] - points[q] + rest_cost(points[k] - points[q], seq_len), q))
    ends = []
    while k:
        ends.append(points[k])
        k = back[k]
    return ends[::-1]


class Packer:
    """Packs a stream of documents in blocks; what follows the last certain cut waits for the next block."""

    def __init__(self, seq_len: int, sentence_end: np.ndarray, dtype: np.dtype, shard: int) -> None:
        self.seq_len, self.sentence_end, self.dtype = seq_len, sentence_end, dtype
        self.sequence = shard << 33
        self.ids = np.zeros(0, dtype)
        self.docs: list[list] = []  # id, ids in all, ids before what is held, ids held
        self.new: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> pa.RecordBatch | None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append([doc_id, n, 0, n])
        self.new.append(ids)
        self.held += n
        return self.pack(last=False) if self.held >= BLOCK else None

    def pack(self, last: bool) -> pa.RecordBatch | None:
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(self.new), self.dtype)])
        self.new = []
        ends = np.cumsum([d[3] for d in self.docs], dtype=np.int64)
        cuts = best_cuts(*cut_points(len(ids), ends, np.flatnonzero(self.sentence_end[ids]) + 1), self.seq_len, last)
        if last and cuts:
            start = cuts[-2] if len(cuts) > 1 else 0
            cuts[-1:] = (start + np.cumsum(rest_lengths(len(ids) - start, self.seq_len))).tolist()
        elif not last:
            cuts = cuts[:-2]  # a later document may move the last two
        out = self.pieces(ids, ends, np.array(cuts, np.int64)) if cuts else None
        done = cuts[-1] if cuts else 0
        gone = int(np.searchsorted(ends, done, side="right"))
        if gone < len(self.docs):
            begun = done - (int(ends[gone - 1]) if gone else 0)
            self.docs = self.docs[gone:]
            self.docs[0][2] += begun
            self.docs[0][3] -= begun
        else:
            self.docs = []
        self.ids, self.held = ids[done:].copy(), len(ids) - done
        return out

    def pieces(self, ids: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        edges = np.union1d(ends[ends < cuts[-1]], cuts)
        begin = np.concatenate([[0], edges[:-1]])
        doc = np.searchsorted(ends, begin, side="right")
        window = np.searchsorted(cuts, begin, side="right")
        first = np.concatenate([[0], cuts[:-1]])
        wide = ids[: cuts[-1]].astype("<u4")
        crc = [zlib.crc32(wide[a:b]) for a, b in zip(begin.tolist(), edges.tolist(), strict=True)]
        starts = np.concatenate([[0], ends[:-1]])
        held_from = np.array([d[2] for d in self.docs], np.int64)
        columns = [
            pa.array([self.docs[d][0] for d in doc.tolist()], pa.int64()),
            pa.array(begin - starts[doc] + held_from[doc]),
            pa.array(edges - begin),
            pa.array(crc, pa.int64()),
            pa.array(np.array([d[1] for d in self.docs], np.int64)[doc]),
            pa.array(self.sequence + window),
            pa.array(begin - first[window]),
            pa.array((cuts - first)[window]),
        ]
        self.sequence += len(cuts)
        return pa.record_batch(columns, names=[f.split()[0] for f in PIECES.split(", ")])


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = SEQ_LEN, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """One row for each piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_length.

    A null or empty text is a document of the end id alone. Rows with equal or null ids are packed one after the
    other. Only the two named columns are read; an empty table gives no pieces. Partitions hold ranges of ids and are
    packed on their own, so sequence ids rise with document ids.
    """
    spark = prepare(docs.sparkSession)
    path = tokenizer_path or default_path()
    rows = documents(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), -(-total // partition_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, end_id)
        packer = Packer(seq_len, code.ends_sentence(), code.dtype, TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), code.encode_all(batch.column(1)), strict=True):
                if (out := packer.add(doc_id, ids)) is not None:
                    yield out
        if (out := packer.pack(last=True)) is not None:
            yield out

    return rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(pack, PIECES)
