"""Reversible line deduplication: exact reference counts by key, with sharded cuckoo filters in front.

A line's key is the line stripped of ASCII white space, with A-Z lower-cased; keys shorter than ``min_chars`` code
points are never dropped. The store keeps three tables in the shared folder:

* ``postings``: key and document id, one row for each distinct key of a document;
* ``counts``: key, number of documents that hold it, and the largest of their ids;
* ``filters``: for each shard of the key space a cuckoo filter of the keys that reached ``min_docs``.

``insert`` and ``delete`` change the counts by sums over the changed documents alone, and put keys that cross
``min_docs`` into the filters or take them out again; deleting what was inserted restores the former store. Where a
deleted document was the last holder of a key, the largest id is taken anew from the postings of those keys.
``apply`` asks the filters which keys of a document may be dropped; the exact counts decide. The filters go to every
task only while they are smaller than ``FILTER_BYTES`` in all; beyond that the counts decide alone, with equal results.

Every row counts as a document, so a repeated row counts again. A null text is one empty line; null ids come before
all others. Keys are compared by 128-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.tables import documents, partitions, prepare, row_key, shared_folder, stored
from tapeloom.llm.text import mixed, utf8

MIN_CHARS, MIN_DOCS = 40, 5
#: ASCII white space that is stripped: \x20 and \x09-\x0D.
BLANKS = b" \t\n\x0b\x0c\r"
#: Filters above this size in all are not sent to the tasks.
FILTER_BYTES = 32 << 20
#: Keys of a shard: one task rebuilds a shard's filter.
SHARD_KEYS = 1 << 18

KEY = ["k1", "k2"]


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key's hash, or None for keys that are too short; ``line`` is lower-cased already."""
    key = line.strip(BLANKS)
    if len(key) < min_chars or len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; supports deletion, and answers for many keys at once."""

    SLOTS = 4

    def __init__(self, table: np.ndarray) -> None:
        self.table = table  # buckets x SLOTS, 0 is free

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, (int(keys / 0.8 / cls.SLOTS) + 1).bit_length())
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key; either bucket gives the other with the fingerprint."""
        key = mixed(key.astype(np.uint64))
        mark = (key >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (key & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, one, one ^ self._step(mark)

    def _step(self, mark: np.ndarray) -> np.ndarray:
        return (mixed(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key found no place: the filter is then to be built anew, larger."""
        for mark, one, two in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            at = one if (self.table[one] == 0).any() else two
            for turn in range(500):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = mark
                    break
                slot = (mark + turn) % self.SLOTS
                mark, self.table[at, slot] = int(self.table[at, slot]), mark
                at ^= int(self._step(np.array([mark], np.uint16))[0])
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        for mark, one, two in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for at in (one, two):
                found = np.flatnonzero(self.table[at] == mark)
                if len(found):
                    self.table[at, found[0]] = 0
                    break


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """k1, k2, doc_id, row_key: one row for each distinct long key of each row of (doc_id, text)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            text = data.tobytes().lower()
            found, rows = [], []
            for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = {k for line in text[a:b].split(b"\n") if (k := line_key(line, min_chars))}
                found += own
                rows += [row] * len(own)
            halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield pa.record_batch([pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(take), batch.column(2).take(take)], names=[*KEY, "doc_id", "row_key"])

    return docs.select("doc_id", "text", row_key()).mapInArrow(keys, "k1 long, k2 long, doc_id long, row_key long")


@dataclass
class LineStore:
    """The three tables after some insertions and deletions; each change makes a new store."""

    spark: SparkSession
    folder: str
    version: int
    shards: int
    min_chars: int
    min_docs: int
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame

    def _shard(self):
        return F.pmod(F.col("k1"), F.lit(self.shards)).cast("int")

    def _frequent(self, counts: DataFrame) -> DataFrame:
        return counts.where(F.col("n_docs") >= self.min_docs)

    def _changed(self, added: DataFrame | None, removed: DataFrame | None) -> LineStore:
        version = self.version + 1
        name = f"v{version}-{uuid.uuid4().hex[:8]}"  # two changes of one store do not meet
        posts, counts = self.postings, self.counts
        if added is not None:
            new = stored(added, self.folder, f"{name}-postings")
            posts = posts.unionByName(new) if self.version else new
            delta = new.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
            if self.version:
                delta = counts.unionByName(delta).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
            counts = stored(delta, self.folder, f"{name}-counts")
        if removed is not None:
            gone = stored(removed, self.folder, f"{name}-removed")
            number = gone.groupBy(*KEY, "doc_id", "row_key").agg(F.count("*").alias("copies"))
            # of equal rows only as many go as were given
            whole = [*KEY, "doc_id", "row_key"]
            held = posts.groupBy(*whole).agg(F.count("*").alias("held"))
            left = held.join(number, [held[c].eqNullSafe(number[c]) for c in whole], "left").select(*(held[c] for c in whole), (F.col("held") - F.coalesce("copies", F.lit(0))).alias("rest"))
            kept = left.where("rest > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rest").cast("int")))).select(*whole)
            posts = stored(kept, self.folder, f"{name}-postings")
            less = gone.groupBy(*KEY).agg((-F.count("*")).alias("n_docs"), F.max("doc_id").alias("lost_doc"))
            old = counts.alias("c").join(less.alias("d"), [F.col(f"c.{k}") == F.col(f"d.{k}") for k in KEY], "left")
            now = old.select(*(F.col(f"c.{k}") for k in KEY), (F.col("c.n_docs") + F.coalesce("d.n_docs", F.lit(0))).alias("n_docs"), "last_doc", (F.col("lost_doc") == F.col("last_doc")).alias("stale")).where("n_docs > 0")
            fresh = posts.join(now.where("stale").select(*KEY), KEY).groupBy(*KEY).agg(F.max("doc_id").alias("found_doc"))
            merged = now.join(fresh, KEY, "left").select(*KEY, "n_docs", F.when(F.col("stale"), F.col("found_doc")).otherwise(F.col("last_doc")).alias("last_doc"))
            counts = stored(merged, self.folder, f"{name}-counts")
        filters = stored(self._refiltered(counts), self.folder, f"{name}-filters")
        return LineStore(self.spark, self.folder, version, self.shards, self.min_chars, self.min_docs, posts, counts, filters)

    def _refiltered(self, counts: DataFrame) -> DataFrame:
        """Filters after keys crossed the threshold: a shard's filter takes insertions and deletions, or is built anew when full."""
        now = self._frequent(counts).select("k1", "k2", F.lit(1).alias("is"), F.lit(0).alias("was"))
        before = self._frequent(self.counts).select("k1", "k2", F.lit(0).alias("is"), F.lit(1).alias("was")) if self.version else now.limit(0)
        keys = now.unionByName(before).groupBy(*KEY).agg(F.max("is").alias("is"), F.max("was").alias("was")).withColumn("shard", self._shard())
        buckets = "shard int, filter binary"

        def update(rows: pa.Table, old: pa.Table) -> pa.Table:
            shard = (rows if rows.num_rows else old)["shard"][0]
            key, now_in, was_in = (rows[c].to_numpy() for c in ("k1", "is", "was"))
            mine = CuckooFilter.load(old["filter"][0].as_py()) if old.num_rows else None
            if mine is not None:
                mine.delete(key[(now_in == 0) & (was_in == 1)])
            if mine is None or not mine.insert(key[(now_in == 1) & (was_in == 0)]):
                size = int(now_in.sum())
                mine = CuckooFilter.sized(size)
                while not mine.insert(key[now_in == 1]):
                    size *= 2
                    mine = CuckooFilter.sized(size)
            return pa.table({"shard": pa.array([shard.as_py()], pa.int32()), "filter": pa.array([mine.dump()], pa.binary())})

        return keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(update, buckets)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineStore:
        return self._changed(postings(documents(docs, id_col, text_col), self.min_chars), None)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineStore:
        """Take out documents that were inserted with these ids and texts."""
        return self._changed(None, postings(documents(docs, id_col, text_col), self.min_chars))

    def maybe_frequent(self, posts: DataFrame) -> DataFrame:
        """Postings whose key may have reached ``min_docs``: those that the filters let through, if these are small."""
        size = self.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
        if size > FILTER_BYTES:
            return posts
        sent = self.spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.collect()})
        shards = self.shards

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {s: CuckooFilter.load(f) for s, f in sent.value.items()}
            for batch in batches:
                key = batch.column("k1").to_numpy()
                shard, keep = np.mod(key, shards), np.zeros(len(key), bool)
                for s in np.unique(shard).tolist():
                    if s in filters:
                        own = np.flatnonzero(shard == s)
                        keep[own] = filters[s].contains(key[own])
                yield batch.filter(pa.array(keep))

        return posts.mapInArrow(probe, posts.schema)

    def drops(self, posts: DataFrame) -> DataFrame:
        """row_key, doc_id, keys: the keys whose lines a document loses."""
        frequent = self._frequent(self.counts)
        found = self.maybe_frequent(posts).join(frequent, KEY)
        return found.where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).groupBy("row_key", "doc_id").agg(F.collect_set(F.struct(*KEY)).alias("keys"))


def empty_store(spark: SparkSession, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None) -> LineStore:
    none = spark.createDataFrame([], "k1 long, k2 long, doc_id long, row_key long")
    counts = spark.createDataFrame([], "k1 long, k2 long, n_docs long, last_doc long")
    filters = spark.createDataFrame([], "shard int, filter binary")
    return LineStore(prepare(spark), shared_folder(spark), 0, shards or partitions(spark), min_chars, min_docs, none, counts, filters)


def kept_lines(min_chars: int):
    """UDF: (text, keys to drop) -> text that stays, lines before, lines dropped."""
    kind = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    @F.arrow_udf("text string, n_lines long, n_dropped long")
    def rebuilt(text: pa.Array, keys: pa.Array) -> pa.Array:
        data, at = utf8(text)
        whole = data.tobytes()
        out, counts, dropped = [], [], []
        for a, b, gone in zip(at[:-1].tolist(), at[1:].tolist(), keys.to_pylist(), strict=True):
            mine = whole[a:b]
            counts.append(mine.count(b"\n") + 1)
            if gone:
                hashes = {np.array([k["k1"], k["k2"]], "<i8").tobytes() for k in gone}
                lines = mine.split(b"\n")
                stay = [x for x in lines if line_key(x.lower(), min_chars) not in hashes]
                mine = b"\n".join(stay)
                dropped.append(len(lines) - len(stay))
            else:
                dropped.append(0)
            out.append(mine)
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], fields=list(kind))

    return rebuilt


def apply_store(store: LineStore, docs: DataFrame, posts: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (the row as given, as a struct), doc_id, text (what stays), n_lines, n_dropped."""
    rows = docs.select(F.struct("*").alias("doc"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("row_key", row_key())
    gone = store.drops(posts if posts is not None else postings(documents(docs, id_col, text_col), store.min_chars))
    both = rows.alias("a").join(gone.alias("b"), (F.col("a.row_key") == F.col("b.row_key")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    made = both.select("a.doc", "a.doc_id", kept_lines(store.min_chars)("a.text", "b.keys").alias("made"))
    return made.select("doc", "doc_id", "made.text", "made.n_lines", "made.n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Insert all documents into an empty store and apply it to them. Other columns ride in ``doc``, whatever their names."""
    store = empty_store(docs.sparkSession, min_chars, min_docs).insert(docs, id_col, text_col)
    return apply_store(store, docs, store.postings, id_col, text_col)


def line_digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
