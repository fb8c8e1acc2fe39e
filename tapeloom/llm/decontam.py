"""Removing benchmark passages with a generalised suffix automaton of the normalised items.

Words are runs of ASCII letters and digits and of everything beyond ASCII, with A-Z lower-cased. One automaton holds
all runs of words of all items of a block; reading a document word by word, its state and the length of the longest
match that ends here follow in amortised constant time. A match of at least ``window`` words, or a whole shorter
item, marks its words.

The items are the query set: they are cut into blocks of about ``BLOCK_BYTES`` by a hash of their ids, and each
block's automaton is sent to all tasks, which read all documents once for each block. Documents are not shuffled;
only if there are several blocks are a document's results gathered.

Null or empty texts have no words; items without words match nothing; items with equal ids count once; the passages of
items with a null id are hits and are cut out, but such items are neither listed nor counted; a repeated document gets its result on every row. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tapeloom.llm.tables import documents, prepare, row_key
from tapeloom.llm.text import LOWER, NOT_ALNUM, Words, chunks, words

WINDOW = 10
BLOCK_BYTES = 1 << 20
#: Stands for an item without an id: its passages are hits, but it is not listed.
NAMELESS = "\x00"
#: A document with a larger share of marked words goes whole.
COVERAGE = 0.5

MATCHES = "doc_id long, row_key long, n_words long, hits array<struct<start:int,length:int>>, items array<string>, longest int"


class SuffixAutomaton:
    """All runs of words of several items; a state is a set of runs that end at the same places."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str]] = []
        whole: dict[int, list[tuple[int, str]]] = {}
        for name, item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)
                ends.append((last, name))
            if 0 < len(item) < window:
                whole.setdefault(last, []).append((len(item), name))
        # the items that hold a state's runs: every prefix's state and those that its links lead to
        owners: list[set[str]] = [set() for _ in self.link]
        for state, name in ends:
            while state > 0 and name not in owners[state]:
                owners[state].add(name)
                state = self.link[state]
        # the state of the last ``window`` words of a longer match, and the short items that end where a match ends
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.at_window = [0] * len(order)
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(order)
        for state in order[1:]:
            up = self.link[state]
            if self.length[state] >= window:
                self.at_window[state] = state if self.length[up] < window else self.at_window[up]
            self.short[state] = self.short[up] + tuple(whole.get(state, ()))
        self.owners = {s: frozenset(owners[s]) for s in set(self.at_window) if s}

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        state = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return state

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        """Split off the runs of q of at most length[p] + 1 words."""
        state = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = state
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = state
            p = self.link[p]
        return state

    def read(self, run: list[int]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Marked spans (start, end) in order of their ends, the items found, and the longest match."""
        state = matched = longest = 0
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for at, word in enumerate(run):
            while word not in self.next[state] and state:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            longest = max(longest, matched)
            if matched >= self.window:
                spans.append((at + 1 - self.window, at + 1))
                found |= self.owners[self.at_window[state]]
            for size, name in self.short[state]:
                if matched >= size:
                    spans.append((at + 1 - size, at + 1))
                    found.add(name)
        return spans, found, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def normal_words(data: np.ndarray, at: np.ndarray) -> Words:
    return words(LOWER[data], at, NOT_ALNUM)


class Block:
    """Items of one block: their words numbered, and their automaton."""

    def __init__(self, names: list[str], texts: list[str | None], window: int) -> None:
        found: list[np.ndarray] = []
        for _, data, at in chunks(pa.array(texts, pa.string())):
            w = normal_words(data, at)
            found += [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.vocabulary, number = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_inverse=True)
        cuts = np.cumsum([0, *map(len, found)])
        items = [(n, number[a:b].tolist()) for n, a, b in zip(names, cuts[:-1], cuts[1:], strict=True)]
        self.automaton = SuffixAutomaton(items, window)
        self.shortest = min([window, *(len(i) for _, i in items if i)])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, -1 for words of no item."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def runs(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of runs of known words inside a document that are long enough to match."""
        known = numbers >= 0
        breaks = np.zeros(len(numbers) + 1, bool)
        breaks[first] = True
        before, after = np.zeros(len(known), bool), np.zeros(len(known), bool)
        before[1:], after[:-1] = known[:-1], known[1:]
        begin = np.flatnonzero(known & (breaks[:-1] | ~before))
        end = np.flatnonzero(known & (breaks[1:] | ~after)) + 1
        long = end - begin >= self.shortest
        return begin[long], end[long]


def blocks(items: DataFrame, window: int, block_bytes: int, id_col: str, text_col: str) -> Iterator[Block]:
    """The blocks of items one after the other."""
    known = items.select(items[id_col].cast("string").alias("item"), items[text_col].cast("string").alias("text"))
    known = known.withColumn("item", F.coalesce("item", F.lit(NAMELESS)))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    for k in range(count):
        rows = known.where(F.pmod(F.xxhash64("item"), F.lit(count)) == k).orderBy("item", "text").collect()
        yield Block([r["item"] for r in rows], [r["text"] for r in rows], window)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, row_key, n_words, hits (spans of marked words), items (their ids), longest (length of the longest match)."""
    spark = prepare(docs.sparkSession)
    rows = documents(docs, id_col, text_col).select("doc_id", row_key(), "text")
    hits = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))

    def passed(block: Block) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, data, at in chunks(batch.column(2)):
                    own = sent.value
                    w = normal_words(data, at)
                    numbers = own.numbers(w.hash)
                    n = len(at) - 1
                    spans: list[list] = [[] for _ in range(n)]
                    names: list[list[str]] = [[] for _ in range(n)]
                    longest = [0] * n
                    begin, end = own.runs(numbers, w.first)
                    owner = np.searchsorted(w.first, begin, side="right") - 1
                    for a, b, d in zip(begin.tolist(), end.tolist(), owner.tolist(), strict=True):
                        found, which, length = own.automaton.read(numbers[a:b].tolist())
                        shift = a - int(w.first[d])
                        spans[d] += [{"start": s + shift, "length": e - s} for s, e in merged(found)]
                        names[d] += which
                        longest[d] = max(longest[d], length)
                    part = batch.slice(row, n)
                    yield pa.record_batch(
                        [part.column(0), part.column(1), pa.array(w.counts), pa.array(spans, hits), pa.array([sorted(set(x) - {NAMELESS}) for x in names], pa.list_(pa.string())), pa.array(longest, pa.int32())],
                        names=["doc_id", "row_key", "n_words", "hits", "items", "longest"],
                    )

        return rows.mapInArrow(search, MATCHES)

    parts = [passed(b) for b in blocks(items, window, block_bytes, item_id_col, item_text_col)]
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # repeated rows share all keys; each block gives one result for each of them
    gathered = every.groupBy("row_key", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.max("longest").alias("longest"),
        (F.count("*") / len(parts)).cast("int").alias("copies"),
    )
    return gathered.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "row_key", "n_words", "hits", "items", "longest")


def covered(hits: str = "hits"):
    """Number of words in the union of spans that are sorted by their starts."""
    return F.expr(
        f"aggregate({hits}, struct(0 as n, 0 as upto), (a, h) -> struct(a.n + greatest(0, h.start + h.length - greatest(h.start, a.upto)) as n, "
        "greatest(a.upto, h.start + h.length) as upto), a -> cast(a.n as bigint))"
    )


def decontamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = matches(docs, items).withColumn("n_hit", covered())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@F.arrow_udf(StringType())
def without_spans(text: pa.Array, hits: pa.Array) -> pa.Array:
    """The text without the bytes from the first to the last word of each span."""
    out: list[bytes] = []
    spans = hits.to_pylist()
    for row, data, at in chunks(text):
        w = normal_words(data, at)
        whole = data.tobytes()
        for k in range(len(at) - 1):
            first, pieces, upto = int(w.first[k]), [], int(at[k])
            for a, b in merged([(h["start"], h["start"] + h["length"]) for h in spans[row + k] or []]):
                pieces.append(whole[upto : int(w.begin[first + a])])
                upto = int(w.end[first + b - 1])
            out.append(b"".join([*pieces, whole[upto : int(at[k + 1])]]))
    return pa.array(out, pa.binary()).cast(pa.string())


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (the row as given, as a struct), doc_id, text without the marked spans; documents with a larger share of
    marked words than ``coverage`` are gone. A document without marks keeps its text, null included."""
    found = matches(docs, items, window, id_col=id_col, text_col=text_col).withColumn("n_hit", covered()).where("n_hit > 0").dropDuplicates(["row_key", "doc_id"])
    rows = docs.select(F.struct("*").alias("doc"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("row_key", row_key())
    both = rows.alias("a").join(found.alias("b"), (F.col("a.row_key") == F.col("b.row_key")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    stays = F.col("b.n_hit").isNull() | (F.col("b.n_hit") <= coverage * F.col("b.n_words"))
    kept = both.where(stays).select("a.doc", "a.doc_id", "a.text", "b.hits")
    return kept.select("doc", "doc_id", F.when(F.col("hits").isNull(), F.col("text")).otherwise(without_spans("text", "hits")).alias("text"))
