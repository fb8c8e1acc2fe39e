"""Similarity self-join of documents on word shingles with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct ``SHINGLE``-word runs; documents of the same set are one node. Two
nodes link if 100 * |A & B| >= ``PERCENT`` * |A | B|, so each shares at least ceil(PERCENT * n / 100) = o of its n
shingles with the other. In any common order of all shingles, the first n - o + l of each must then share l (for
every l up to o): a prefix that is l - 1 shingles longer asks for l matches.

1. The order puts shingles of many documents last. How many is estimated from all shingles of every ``SHARE``-th node,
   chosen by its hash, so whatever many nodes hold is seen; the counts become a table of levels by cell of the
   hash, of fixed size, that every task gets. A wrong level only costs time: every order gives the same links. With
   common shingles last, what is a document's own fills its prefix, and a near copy with more of its own than a link
   allows has too few list entries left to meet anyone.
2. Each node picks its own l: the sum of the estimated list lengths over the longer prefix, plus the cost of verifying
   at most sum / l candidates, is to be least. Of two prefixes the one that ends first in the common order shares with
   the other all that it shares with the other's set; so a pair needs at least
   min(l_a - o_a, l_b - o_b) + ceil(PERCENT * (n_a + n_b) / (100 + PERCENT)) common prefix shingles, which is l or more.
3. Prefix shingles of one node only are set aside. Each list is led by the node with the largest share of its prefix
   in lists: the one that differs least from the others. Each node is first verified against its main leader; links
   give first components, and lists within one component need no pairs any more.
4. In lists with several components, nodes outside the list's main component meet all nodes of other components that
   hold enough list entries for the pair; so groups of copies do not make all pairs. Candidates are verified on their
   whole sets.

The result is one row for each document, with the smallest id that links reach. Joins on a common shingle are split
by adaptive execution. Null and empty texts have no shingles and link with nothing; fewer than ``SHINGLE`` words are
one shingle. Rows of equal text are one node, whatever their ids, null included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.graph import components
from tapeloom.llm.tables import documents, prepare, row_key, shared_folder, stored
from tapeloom.llm.text import LOWER, Words, chunks, mixed, window_hashes, words

SHINGLE, PERCENT = 4, 85
#: Bits of a shingle's hash that name its cell in the table of levels.
CELL_BITS = 22
#: Part of the nodes whose shingles are counted, and counted nodes that hold a shingle before it gets a level.
SHARE, COMMON = 16, 3
#: The largest l, and what verifying a candidate costs in list entries.
MOST_MATCHES, VERIFY = 6, 8


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    runs = window_hashes(w.hash, size)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(mixed(window_hashes(w.hash[a:b], b - a) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(n, percent: int):
    """The least number of shingles that a linked node shares."""
    return -(-percent * n // 100)


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles) - (1 << 63)


class Order:
    """Levels of common shingles by cell; ascending (level, hash) is the common order."""

    def __init__(self, cells: np.ndarray, levels: np.ndarray) -> None:
        self.cells, self.levels = cells, levels

    def level(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.cells):
            return np.zeros(len(shingles), np.int64)
        cell = (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return np.where(self.cells[at] == cell, self.levels[at], 0)

    def prefix(self, shingles: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
        """The cheapest prefix and its number of matches."""
        n = len(shingles)
        need = needed(n, percent)
        most = min(MOST_MATCHES, need)
        level = self.level(shingles)
        order = np.lexsort((shingles, level))[: n - need + most]
        cost = np.cumsum(np.exp2(level[order]))[n - need :]  # for l = 1, 2, ...
        matches = int(np.argmin(cost * (1 + VERIFY / np.arange(1, most + 1)))) + 1
        return shingles[order[: n - need + matches]], matches


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, row_key, n_shingles, node, and the shingles to count: all of every ``SHARE``-th node."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in chunks(batch.column(1)):
                sets = shingle_sets(words(LOWER[data], at), size)
                part = batch.slice(row, len(sets))
                nodes = [node_of(s) if len(s) else None for s in sets]
                counted = [s if k is not None and k % SHARE == 0 else s[:0] for s, k in zip(sets, nodes, strict=True)]
                yield pa.record_batch(
                    [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), _lists(counted)],
                    names=["doc_id", "row_key", "n_shingles", "node", "counted"],
                )

    return docs.select("doc_id", "text", row_key()).mapInArrow(sketch, "doc_id long, row_key long, n_shingles long, node long, counted array<long>")


def learn_order(known: DataFrame) -> Order:
    """Levels (base 2 logarithms) of the cells whose shingles many documents hold: at most 2 ** CELL_BITS small rows."""
    once = known.where(F.size("counted") > 0).groupBy("node").agg(F.first("counted").alias("counted"))
    shingle = once.select(F.explode("counted").alias("s"))
    common = shingle.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    cell = F.shiftrightunsigned("s", 64 - CELL_BITS).cast("int").alias("cell")
    table = common.groupBy(cell).agg(F.max(F.floor(F.log2("n"))).cast("byte").alias("level")).orderBy("cell").toArrow()
    return Order(table["cell"].to_numpy().astype(np.int64), table["level"].to_numpy().astype(np.int64))


def prefixes(docs: DataFrame, order: Order, size: int, percent: int) -> DataFrame:
    """node, n, matches, prefix: one row for each node."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, at in chunks(batch.column(0)):
                sets = [s for s in shingle_sets(words(LOWER[data], at), size) if len(s)]
                found = [sent.value.prefix(s, percent) for s in sets]
                yield pa.record_batch(
                    [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([m for _, m in found], pa.int32()), _lists([p for p, _ in found])],
                    names=["node", "n", "matches", "prefix"],
                )

    every = docs.select("text").mapInArrow(cut, "node long, n int, matches int, prefix array<long>")
    return every.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "matches", "prefix")))


def whole_sets(docs: DataFrame, size: int) -> DataFrame:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in chunks(batch.column(1)):
                sets = shingle_sets(words(LOWER[data], at), size)
                yield pa.record_batch([batch.column(0).slice(row, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(gather, "node long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among pairs (a, b)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("one"), batch.column("two"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(p, q), len(p) - 1)
                same = int((p[at] == q).sum())
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("a", "one"), ("b", "two")))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "one", "two").mapInArrow(check, "a long, b long")


def near_sizes(n: Column | str, m: Column | str, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def need(n: str, percent: int) -> Column:
    """``needed`` as a column."""
    return F.floor((percent * F.col(n) + 99) / 100)


def common_needed(n: str, m: str, other_n: str, other_m: str, percent: int) -> Column:
    """Common prefix shingles of a linked pair, at least; from the sizes and matches of both."""
    both = F.floor((percent * (F.col(n) + F.col(other_n)) + 99 + percent) / (100 + percent))
    return F.greatest(F.lit(1), F.least(F.col(m) - need(n, percent), F.col(other_m) - need(other_n, percent)) + both)


def linked(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, n_shingles, node of each row; node and label of each node that has a link), both stored."""
    spark = prepare(docs.sparkSession)
    folder = shared_folder(spark)
    rows = documents(docs, id_col, text_col)
    known = stored(sketches(rows, size, percent), folder, "sketches")
    cut = stored(prefixes(rows, learn_order(known), size, percent), folder, "prefixes")

    entries = cut.select("node", "n", "matches", F.explode("prefix").alias("shingle"))
    shared = entries.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1").select("shingle")
    lists = stored(entries.join(shared, "shingle"), folder, "lists")
    counts = lists.groupBy("node").agg(F.count("*").alias("k"))
    lists = stored(lists.join(counts, "node"), folder, "counted-lists")
    one_row = known.where("node is not null").groupBy("node").agg(F.min("row_key").alias("row_key"))
    texts = rows.withColumn("row_key", row_key()).select("row_key", "text")

    def sets_of(pairs: DataFrame, name: str) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        # a repeated row brings its text more than once: one is enough
        wanted = texts.join(one_row.join(nodes, "node"), "row_key").dropDuplicates(["row_key"])
        return stored(whole_sets(wanted, size), folder, name)

    # first each node against the leader of most of its lists
    share = (F.col("k") / (F.col("n") - need("n", percent) + F.col("matches"))).alias("share")
    leaders = lists.groupBy("shingle").agg(F.max(F.struct(share, F.xxhash64("node").alias("draw"), "node", "n", "matches", "k")).alias("lead"))
    enough = common_needed("n", "matches", "lead.n", "lead.matches", percent)
    led = lists.join(leaders, "shingle").where((F.col("node") != F.col("lead.node")) & near_sizes("n", "lead.n", percent) & (F.least("k", "lead.k") >= enough))
    votes = led.groupBy("node", F.col("lead.node").alias("lead"), enough.alias("enough")).agg(F.count("*").alias("votes")).where("2 * votes >= enough")
    best = votes.groupBy("node").agg(F.max(F.struct("votes", "lead")).alias("best"))
    first = stored(best.select(F.least("node", "best.lead").alias("a"), F.greatest("node", "best.lead").alias("b")).distinct(), folder, "first-pairs")
    links = stored(verified(first, sets_of(first, "first-sets"), percent), folder, "first-links")
    labels = components(links, folder, "first")

    # then pairs between components
    held = lists.join(labels, "node", "left").select("shingle", "node", "n", "matches", "k", F.coalesce("label", "node").alias("label"))
    held = stored(held, folder, "held")
    main = held.groupBy("shingle", "label").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("labels"))
    mixed_lists = main.where("labels > 1").select("shingle", F.col("top.label").alias("main"))
    open_lists = stored(held.join(mixed_lists, "shingle"), folder, "open")
    x, y = open_lists.where("label <> main").alias("x"), open_lists.alias("y")
    once = (F.col("y.label") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    enough = common_needed("x.n", "x.matches", "y.n", "y.matches", percent)
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label")) & once & near_sizes("x.n", "y.n", percent) & (F.least("x.k", "y.k") >= enough))
    pair = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), enough.alias("enough"))
    candidates = stored(pair.groupBy("a", "b", "enough").agg(F.count("*").alias("same")).where("same >= enough").select("a", "b"), folder, "candidates")
    more = stored(verified(candidates, sets_of(candidates, "more-sets"), percent), folder, "more-links")
    return known.drop("counted"), components(links.union(more), folder, "all")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, n_shingles, label: the component, as its smallest node (null without shingles), and
    component_id: the smallest id that a document's links reach, its own included.

    Only the label tells components apart: ids may be null, or the same in several components.
    """
    known, labels = linked(docs, size, percent, id_col, text_col)
    nodes = known.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("smallest"))
    named = nodes.join(labels, "node", "left").select("node", "smallest", F.coalesce("label", "node").alias("label"))
    whole = named.groupBy("label").agg(F.min("smallest").alias("component_id"))
    of_node = named.join(whole, "label").select("node", "label", "component_id")
    return known.join(of_node, "node", "left").select("doc_id", "row_key", "n_shingles", "label", F.coalesce("component_id", "doc_id").alias("component_id"))


def join_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
