"""Hard negatives by exact integer scores: matrix products modulo small primes in float32, put together again.

Rows take part if they have an id, a label and a vector without null or non-finite components; each component becomes
floor(``SCALE`` * x). A row's score for an anchor is their integer inner product; a shorter vector counts as ended by
zeros.

Scores. Components are reduced modulo primes below 2**10 and multiplied as float32 matrices, ``SLAB`` components at a
time: sums stay below 2**24, so they are exact. As many primes are taken as the largest possible score needs (from the
largest component and the length of the vectors, one small aggregate). Chinese remaindering runs in balanced mixed
radix: each digit is found modulo one prime in float32, and the signed score is the digits' sum in 64-bit integers. A
table whose scores could pass 2**62 is refused.

Search. Anchors are dealt into groups of at most ``ANCHORS``; a cell is one group and one part of the rows. Every
anchor goes to all cells of its group, every row to one cell of each group, and a cell's task streams its rows past its
anchors in blocks of ``ROWS``, holding the best few of each anchor only. The cells of one group are merged by rank.

1. For each label, its anchors meet its rows alone: the first ``positives`` of each anchor.
2. Rows of other labels with low * positive score <= 100 * score <= 100 * positive score make a positive's window: its
   first ``negatives`` stay. What lies in no window of an anchor leaves the block before anything is sorted.

Higher scores come first, ties by the smaller id. Repeated rows are rows of their own, told apart by a number that is
stored once; an anchor's twin may be its positive. Rows with a null id cannot be named and take no part. Other columns,
whatever their names, are not read. An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.tables import partitions, prepare, shared_folder, stored

SCALE = 256
POSITIVES, NEGATIVES, LOW = 5, 5, 80
#: Components multiplied before a reduction: 64 products of residues up to 509 stay below 2**24.
SLAB = 64
#: Anchors held by a cell, anchors and rows multiplied at once.
ANCHORS, TILE, ROWS = 16_384, 256, 8192
LARGEST = 1 << 62


def primes(bound: int) -> list[int]:
    """Primes below 1020 in falling order, until their product passes twice the bound."""
    out, product, n = [], 1, 1019
    while product <= 2 * bound + 1:
        if all(n % k for k in range(2, 32)):
            out.append(n)
            product *= n
        n -= 1
    return out


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p in -(p - 1) / 2 .. (p - 1) / 2, for float32 integers below 2**24; twice, as the first quotient may be one off."""
    x = x - np.float32(p) * np.rint(x / np.float32(p))
    return x - np.float32(p) * np.rint(x / np.float32(p))


class Residues:
    """Integer vectors (as float64 rows) modulo each prime."""

    def __init__(self, vectors: np.ndarray, moduli: list[int]) -> None:
        self.moduli = moduli
        # fmod is exact for floats of any size
        self.parts = [balanced(np.fmod(vectors, p).astype(np.float32), p) for p in moduli]

    def take(self, at) -> Residues:
        out = object.__new__(Residues)
        out.moduli, out.parts = self.moduli, [x[at] for x in self.parts]
        return out


def scores(a: Residues, b: Residues) -> np.ndarray:
    """The exact inner products of all rows of a with all rows of b."""
    digits: list[np.ndarray] = []
    out = None
    weight = 1
    for k, p in enumerate(a.moduli):
        x, y = a.parts[k], b.parts[k]
        rest = None
        for at in range(0, max(x.shape[1], 1), SLAB):
            part = balanced(x[:, at : at + SLAB] @ y[:, at : at + SLAB].T, p)
            rest = part if rest is None else balanced(rest + part, p)
        # take off the digits before, and divide by the primes before, modulo p
        for q, digit in zip(a.moduli[:k], digits, strict=True):
            rest = balanced((rest - digit) * np.float32(pow(q, -1, p)), p)
        digits.append(rest)
        # terms may wrap around 2**64, their sum is a score below 2**62
        out = rest.astype(np.int64) * ((weight + (1 << 63)) % (1 << 64) - (1 << 63)) + (0 if out is None else out)
        weight *= p
    return out


def least_score(high: np.ndarray, low: int) -> np.ndarray:
    """ceil(low * high / 100), without products that overflow."""
    whole, rest = np.divmod(high, 100)
    return low * whole - (-low * rest // 100)


def best(keys: tuple[np.ndarray, ...], group: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` of each group in the order of ``keys`` (the first key leads)."""
    order = np.lexsort((*reversed(keys), group))
    own = group[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < count]


class Anchors:
    """The anchors of a cell and, for each, the best rows so far of each window."""

    def __init__(self, number, label, vectors, windows, moduli: list[int]) -> None:
        order = np.lexsort((number, label))
        self.number, self.label, self.moduli = number[order], label[order], moduli
        self.residues = Residues(vectors[order], moduli)
        self.windows = None if windows is None else [windows[k] for k in order]
        if windows is not None:
            width = max(map(len, self.windows), default=0)
            # no score lies between 80 % and 100 % of a negative one: -1 fills up the windows of fewer positives
            self.high = np.array([[*w, *[-1] * (width - len(w))] for w in self.windows], np.int64).reshape(len(order), width)
        self.found: list[tuple[np.ndarray, ...]] = []

    def _merge(self, count: int) -> None:
        anchor, window, score, ids, number = (np.concatenate(x) for x in zip(*self.found, strict=True))
        keep = best((-score, ids, number), anchor * 1024 + window, count)
        self.found = [tuple(x[keep] for x in (anchor, window, score, ids, number))]

    def see(self, number, ids, label, vectors, low: int, count: int) -> None:
        order = np.lexsort((ids, label))
        number, ids, label = number[order], ids[order], label[order]
        rows = Residues(vectors[order], self.moduli)
        for at in range(0, len(self.number), TILE):
            tile = np.arange(at, min(at + TILE, len(self.number)))
            if self.windows is None:
                self._positives(tile, number, ids, label, rows, count)
            else:
                self._negatives(tile, number, ids, label, rows, low, count)
        if self.found:
            self._merge(count)

    def _positives(self, tile, number, ids, label, rows: Residues, count: int) -> None:
        for own in np.unique(self.label[tile]):
            a, b = np.searchsorted(label, [own, own + 1])
            if a == b:
                continue
            anchors = tile[self.label[tile] == own]
            score = scores(self.residues.take(anchors), rows.take(slice(a, b)))
            keep = min(count + 1, b - a)  # the anchor itself may be among them
            if keep < b - a:
                least = np.partition(score, b - a - keep, axis=1)[:, b - a - keep]
            else:
                least = score.min(axis=1)
            i, j = np.nonzero(score >= least[:, None])
            other = self.number[anchors[i]] != number[a + j]
            i, j = i[other], j[other]
            score = score[i, j]
            some = best((-score, ids[a + j], number[a + j]), i, count)
            i, j = i[some], j[some] + a
            self.found.append((anchors[i], np.zeros(len(i), np.int64), score[some], ids[j], number[j]))

    def _negatives(self, tile, number, ids, label, rows: Residues, low: int, count: int) -> None:
        high = self.high[tile]
        if not high.size:
            return
        least = least_score(high, low)
        score = scores(self.residues.take(tile), rows)
        bottom, top = np.where(high >= 0, least, LARGEST).min(axis=1), high.max(axis=1)
        i, j = np.nonzero((score >= bottom[:, None]) & (score <= top[:, None]))
        other = self.label[tile[i]] != label[j]
        i, j = i[other], j[other]
        score = score[i, j]
        order = np.lexsort((number[j], ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        begin = np.searchsorted(i, np.arange(len(tile) + 1))
        for w in range(high.shape[1]):
            inside = (score <= high[i, w]) & (score >= least[i, w])
            # the first of a window: places counted from the anchor's first row inside
            before = np.concatenate([[0], np.cumsum(inside)])
            keep = np.flatnonzero(inside & (before[:-1] - before[begin[i]] < count))
            self.found.append((tile[i[keep]], np.full(len(keep), w), score[keep], ids[j[keep]], number[j[keep]]))

    def rows(self) -> pa.RecordBatch:
        if not self.found:
            self.found = [tuple(np.zeros(0, np.int64) for _ in range(5))]
        anchor, window, score, ids, number = (np.concatenate(x) for x in zip(*self.found, strict=True))
        return pa.record_batch([pa.array(self.number[anchor]), pa.array(window.astype(np.int32)), pa.array(score), pa.array(ids), pa.array(number)], names=["anchor", "window", "score", "found_id", "found"])


FOUND = "anchor long, window int, score long, found_id long, found long"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of float64, ended by zeros."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    out = np.zeros((len(column), width))
    out[np.arange(width) < size[:, None]] = values[offsets[0] : offsets[-1]]
    return out


class Cell:
    """One group of anchors and a part of the rows, as they stream in: anchors first."""

    def __init__(self, number: int, width: int, moduli: list[int], low: int, count: int) -> None:
        self.number, self.width, self.moduli, self.low, self.count = number, width, moduli, low, count
        self.first: list[pa.RecordBatch] = []
        self.waiting: list[pa.RecordBatch] = []
        self.held, self.anchors = 0, None

    def add(self, some: pa.RecordBatch, anchors: bool) -> None:
        if anchors:
            self.first.append(some)
        elif self.first:
            self.waiting.append(some)
            self.held += len(some)
            if self.held >= ROWS:
                self._see()

    def _arrays(self, some: list[pa.RecordBatch], *names: str) -> list[np.ndarray]:
        table = pa.Table.from_batches(some).combine_chunks()
        return [_matrix(table[n].chunk(0), self.width) if n == "vector" else table[n].to_numpy() for n in names]

    def _see(self) -> None:
        if self.anchors is None:
            windows = pa.Table.from_batches(self.first)["windows"]
            self.anchors = Anchors(*self._arrays(self.first, "number", "label", "vector"), None if windows.null_count else windows.to_pylist(), self.moduli)
        self.anchors.see(*self._arrays(self.waiting, "number", "vec_id", "label", "vector"), self.low, self.count)
        self.waiting, self.held = [], 0

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            self._see()
        if self.anchors is not None:
            yield self.anchors.rows()


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """vec_id, label, vector (whole numbers as doubles) of the rows that take part."""
    given = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[label_col].cast("long").alias("label"), rows[vector_col].cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & whole)
    # doubles of 2**53 and more are whole; their floor as a long could overflow
    floor = lambda x: F.when(F.abs(x * SCALE) < 2.0**53, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)
    return good.select("vec_id", "label", F.transform("vector", floor).alias("vector"))


def _search(anchors: DataFrame, rows: DataFrame, groups: int, width: int, moduli: list[int], low: int, count: int) -> DataFrame:
    """The best of every window: ``anchors`` has number, label, vector and windows (null in the first step)."""
    parts = max(1, -(-partitions(rows.sparkSession) // groups))
    group = F.pmod(F.xxhash64("number"), F.lit(groups))
    part = F.pmod(F.xxhash64(F.lit(1), "number"), F.lit(parts))
    number = lambda g, p: (g * parts + p).cast("int")
    all_parts, all_groups = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    held = anchors.select("*", group.alias("g"), all_parts.alias("p")).select(number(F.col("g"), F.col("p")).alias("cell"), F.lit(0).alias("kind"), "number", F.lit(None).cast("long").alias("vec_id"), "label", "vector", "windows")
    seen = rows.select("*", part.alias("p"), all_groups.alias("g")).select(number(F.col("g"), F.col("p")).alias("cell"), F.lit(1).alias("kind"), "number", "vec_id", "label", "vector", F.lit(None).cast("array<long>").alias("windows"))
    dealt = held.union(seen).repartitionById(groups * parts, "cell").sortWithinPartitions("cell", "kind")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        for batch in batches:
            step = batch["cell"].to_numpy() * 2 + batch["kind"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if cell is not None and cell.number != step[a] // 2:
                    yield from cell.finish()
                    cell = None
                cell = cell or Cell(int(step[a] // 2), width, moduli, low, count)
                cell.add(batch.slice(a, b - a), step[a] % 2 == 0)
        if cell is not None:
            yield from cell.finish()

    return dealt.mapInArrow(stream, FOUND)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``anchor`` is a condition on vec_id and label."""
    spark = prepare(rows.sparkSession)
    folder = shared_folder(spark)
    table = stored(usable(rows, id_col, label_col, vector_col).select("*", anchor.alias("is_anchor"), F.monotonically_increasing_id().alias("number")), folder, "rows")
    size = F.aggregate("vector", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    sized = table.select("is_anchor", size.alias("peak"), F.size("vector").alias("width"))
    zero = lambda column, kind: F.coalesce(F.max(column), F.lit(0).cast(kind))
    own = F.when(F.col("is_anchor"), F.col("peak"))
    peak, peak_anchor, width, count = sized.agg(zero(F.col("peak"), "double"), zero(own, "double"), zero(F.col("width"), "int"), F.count_if("is_anchor")).first()
    if peak == float("inf"):
        raise ValueError("a component is too large")
    bound = int(peak) * int(peak_anchor) * width
    if bound >= LARGEST:
        raise ValueError("scores beyond 2**62 do not fit 64-bit integers")
    moduli, groups = primes(bound), max(1, -(-count // ANCHORS))

    anchors = table.where("is_anchor").select("number", "label", "vector")
    none = F.lit(None).cast("array<long>").alias("windows")
    found = _search(anchors.select("*", none), table, groups, width, moduli, low, positives)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "found_id", "found")).alias("place")
    chosen = stored(found.select("*", place).where(F.col("place") <= positives), folder, "positives")

    windows = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("list")).select("anchor", F.col("list.score").alias("windows"))
    searched = anchors.join(windows, F.col("number") == F.col("anchor")).select("number", "label", "vector", "windows")
    met = _search(searched, table, groups, width, moduli, low, negatives)
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "found_id", "found")).alias("rank")
    taken = met.select("*", rank).where(F.col("rank") <= negatives).select(F.col("anchor").alias("of"), (F.col("window") + 1).alias("of_place"), "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = chosen.join(table.select("number", F.col("vec_id").alias("anchor_id")), F.col("anchor") == F.col("number"))
    out = named.join(taken, (F.col("anchor") == F.col("of")) & (F.col("place") == F.col("of_place")))
    return out.select("anchor_id", F.col("found_id").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


def negatives_digest(embeddings: DataFrame) -> DataFrame:
    """Anchors are rows whose id is divisible by 100; where it is divisible by 7, the label is first moved on by one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
