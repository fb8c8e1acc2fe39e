"""Divergence audit of sources: how far the word frequencies of each (language, source) group stand from the others'.

Each language keeps the terms found in at least ``MIN_DOCS`` of its documents. A group with n occurrences of a kept
term has p = 1 + floor(SCALE * (n + 1) / (N + V)), N its occurrences of all V kept terms; so has each language as a
whole. Against q, a term costs floor((p - q) ** 2 / q). A pair of groups costs the sum over all kept terms, those that
neither holds included; the terms that a group uses more than its language are listed by their cost.

1. Terms are counted by task in dictionaries of at most ``HELD`` entries, then by one shuffle on (language, term),
   which serves both the counts by group and the documents by term.
2. Kept terms get ids in order of (language, documents, term): range partitions, sorted, and the row's place in its
   partition. Terms of like frequency are neighbours, so many groups have the same counts over whole stretches.
3. The ids are cut into blocks of ``LEAVES``. Over a block, every group's counts are a segment tree: leaves are
   counts, and a node is named by its two children, level by level, so equal subtrees of any groups are one node; groups
   without terms in the block share one tree of zeros. Places without a term hold a void leaf that costs nothing.
4. Two groups' trees are walked together from the root down. A pair of nodes that a pair of groups reaches several times is
   kept once, with the number of times; so each pair of equal counts is priced once. The sums over blocks are added.

A block's task holds the counts of the groups that occur in it and all groups' totals, never more terms than the
block; pairs are walked ``PAIRS`` at a time. All arithmetic is on integers: the quotients are taken in three steps of a
thousand, exact while N + V is below 9 * 10**15.

Null text, language and source count as empty. Rows are documents: repeated rows count each, ids are not read, nor are
other columns. A language without kept terms has pairs of cost 0 and no terms; a language of one source has no pairs. Ties
are listed by item in byte order. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.tables import partitions, prepare, shared_folder, stored
from tapeloom.llm.text import LOWER, utf8

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Entries of a task's dictionaries, and bytes of one text whose terms are listed at once.
HELD, SLICE = 400_000, 1 << 20
LEAVES, PAIRS = 2048, 512

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def text_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists; a long text is cut between terms."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield TERM.findall(text, at, end)
        at = end


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms: defaultdict[tuple, Counter] = defaultdict(Counter)
    docs: defaultdict[tuple, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in terms.items():
            if counts:
                own = docs[lang, source]
                yield pa.record_batch(
                    [pa.array([lang] * len(counts), pa.string()), pa.array([source] * len(counts), pa.string()), pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64()), pa.array(map(own.__getitem__, counts), pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
        terms.clear()
        docs.clear()

    held = 0
    for batch in batches:
        data, at = utf8(batch.column(2))
        data = LOWER[data].tobytes()
        for k, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            counts, found = terms[group], set()
            held -= len(counts)
            for some in text_terms(data[at[k] : at[k + 1]]):
                counts.update(some)
                found.update(some)
            docs[group].update(found)
            held += len(counts)
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, docs, groups (array of source and n): one row for each kept term."""
    partial = docs.mapInArrow(_counts, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    by_group = partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_group.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("groups"))
    return by_term.where(F.col("docs") >= min_docs)


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), in three steps of a thousand."""
    whole, rest = np.divmod(n + 1, total)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + step
    return whole + 1


class Forest:
    """Segment trees over rows of counts (-1: void); equal subtrees are one node."""

    def __init__(self, counts: np.ndarray) -> None:
        self.values, node = np.unique(counts, return_inverse=True)
        node = node.reshape(counts.shape)
        #: Left and right children of each level's nodes, from the leaves up.
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        size = len(self.values)
        while node.shape[1] > 1:
            pair, inverse = np.unique(node[:, 0::2] * size + node[:, 1::2], return_inverse=True)
            self.children.append((pair // size, pair % size))
            node = inverse.reshape(node.shape[0], -1)
            size = len(pair)
        self.roots = node[:, 0]

    def walk(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tree pairs -> (number of the pair, counts in either tree, how many places have both), each once and in order."""
        pair, a, b = np.arange(len(one)), self.roots[one], self.roots[two]
        times = np.ones(len(one), np.int64)
        for left, right in reversed(self.children):
            pair, times = np.tile(pair, 2), np.tile(times, 2)
            a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            size = int(max(a.max(), b.max())) + 1
            key, inverse = np.unique((pair * size + a) * size + b, return_inverse=True)
            times = np.bincount(inverse, times, len(key)).astype(np.int64)  # at most LEAVES
            pair, a, b = key // (size * size), key // size % size, key % size
        held = self.values[a] >= 0
        return pair[held], self.values[a][held], self.values[b][held], times[held]


PRICED = "lang string, source string, part string, item string, value long"


def _price_block(top: int):
    def price(terms: pa.Table, groups: pa.Table) -> pa.Table:
        names = groups["source"].to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        names = [names[k] for k in order]
        total = (groups["total"].to_numpy() + groups["kept"].to_numpy())[order]
        every = int(groups["total"].to_numpy().sum()) + int(groups["kept"][0].as_py())
        lang = groups["of_lang"][0].as_py()

        lists = terms["groups"].combine_chunks()
        entries = lists.flatten()
        place = np.repeat(terms["place"].to_numpy(), np.diff(lists.offsets.to_numpy()))
        number = {s: k for k, s in enumerate(names)}
        who = np.fromiter(map(number.__getitem__, entries.field("source").to_pylist()), np.int64, len(entries))
        n = entries.field("n").to_numpy()

        # trees: the zeros, then the groups that occur
        present, row = np.unique(who, return_inverse=True)
        counts = np.full((len(present) + 1, LEAVES), -1, np.int64)
        counts[:, terms["place"].to_numpy()] = 0
        counts[row + 1, place] = n
        forest = Forest(counts)
        tree = np.zeros(len(names), np.int64)
        tree[present] = np.arange(len(present)) + 1

        source, item, value = [], [], []
        left, right = np.triu_indices(len(names), 1)
        for at in range(0, len(left), PAIRS):
            one, two = left[at : at + PAIRS], right[at : at + PAIRS]
            pair, x, y, times = forest.walk(tree[one], tree[two])
            p, q = shares(x, total[one[pair]]), shares(y, total[two[pair]])
            square = (p - q) ** 2
            begin = np.searchsorted(pair, np.arange(len(one)))
            for whose, against, cost in ((one, two, square // q), (two, one, square // p)):
                source += [names[k] for k in whose.tolist()]
                item += [names[k] for k in against.tolist()]
                value.append(np.add.reduceat(cost * times, begin))
        parts = [pa.table({"source": pa.array(source, pa.string()), "part": pa.array(["pair"] * len(source), pa.string()), "item": pa.array(item, pa.string()), "value": np.concatenate(value)})] if source else []

        # the terms that a group uses more than its language
        words = terms["term"].to_pylist()
        sorted_words = sorted(range(len(words)), key=lambda k: words[k].encode())
        word_at = np.zeros(LEAVES, np.int64)
        word_at[terms["place"].to_numpy()[sorted_words]] = np.arange(len(words))
        whole = np.bincount(place, minlength=LEAVES) * 0
        np.add.at(whole, place, n)
        p, q = shares(n, total[who]), shares(whole[place], np.full(len(n), every))
        more = np.flatnonzero(p > q)
        cost = (p[more] - q[more]) ** 2 // q[more]
        ranked = np.lexsort((word_at[place[more]], -cost, who[more]))
        more, cost = more[ranked], cost[ranked]
        own = who[more]
        kept = np.arange(len(own)) - np.searchsorted(own, own) < top
        listed = [words[sorted_words[k]] for k in word_at[place[more[kept]]].tolist()]
        parts.append(pa.table({"source": pa.array([names[k] for k in own[kept].tolist()], pa.string()), "part": pa.array(["term"] * len(listed), pa.string()), "item": pa.array(listed, pa.string()), "value": cost[kept]}))
        out = pa.concat_tables(parts)
        return out.add_column(0, "lang", pa.array([lang] * len(out), pa.string()))

    return price


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item (another source, or a term), value, rank.

    All pairs are listed, and of the terms those of ranks up to ``top``.
    """
    spark = prepare(docs.sparkSession)
    folder = shared_folder(spark)
    text = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    rows = docs.select(*text)
    kept = stored(term_counts(rows, min_docs), folder, "kept")

    found = kept.select("lang", F.inline("groups")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    every = rows.select("lang", "source").distinct().join(found, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = stored(every.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")), folder, "groups")

    ordered = kept.repartitionByRange(partitions(spark), "lang", "docs", "term").sortWithinPartitions("lang", "docs", "term")
    number = F.monotonically_increasing_id()
    terms = stored(ordered.select("lang", "term", "groups", number.alias("id")), folder, "terms")
    terms = terms.select("lang", "term", "groups", F.expr(f"id div {LEAVES}").alias("block"), F.expr(f"cast(id % {LEAVES} as int)").alias("place"))
    told = terms.select("lang", "block").distinct().join(groups, "lang").toDF("of_lang", "of_block", "source", "total", "kept")
    cells = terms.groupBy("lang", "block").cogroup(told.groupBy("of_lang", "of_block"))
    priced = stored(cells.applyInArrow(_price_block(top), PRICED), folder, "priced")

    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item")
    costs = priced.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(costs, ["lang", "source", "item"], "left").select("lang", "source", "part", "item", F.coalesce("value", F.lit(0)).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    listed = priced.where("part = 'term'").select("*", place).where(F.col("rank") <= top)
    return pairs.select("*", place).unionByName(listed)
