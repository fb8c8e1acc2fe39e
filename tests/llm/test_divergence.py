"""The divergence audit against plain counting with Python's integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_rows import COLUMNS, hard_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=200):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        sources = [s for k, s in groups if k == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def p_of(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = p_of(counts[lang, source]), p_of(whole)
        parts = {"pair": [], "term": [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, source][t] and p[t] > q[t]]}
        for s in sources:
            if s != source:
                o = p_of(counts[lang, s])
                parts["pair"].append((s, sum((p[t] - o[t]) ** 2 // o[t] for t in kept)))
        for part, items in parts.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def rows_of(hard):
    return [(r[1], r[2], r[3]) for r in hard]


def corpus(n, seed=4):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdeé日Ω", k=draw.randint(1, 3))) for _ in range(90)]
    out = []
    for k in range(n):
        source = f"s{min(int(draw.expovariate(0.4)), 9)}"
        size = draw.randint(0, 40)
        out.append((k, " ".join(draw.choices(words, weights=[1 / (j + 1) for j in range(90)], k=size)).title(), draw.choice(["a", "b", None]), source, 0, 0, 0, "", ""))
    return out


@pytest.mark.parametrize("leaves, top", [(2048, 200), (4, 3)])
def test_against_plain_counts(spark, hard, monkeypatch, leaves, top):
    monkeypatch.setattr(divergence, "LEAVES", leaves)
    monkeypatch.setattr(divergence, "PAIRS", 7)
    extra = corpus(150)
    docs = hard.union(spark.createDataFrame(extra, COLUMNS))
    got = divergence.audit(docs, top=top)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == plain(rows_of(hard_rows() + extra), top)


def test_small_dictionaries_and_slices(spark, monkeypatch):
    extra = corpus(120, seed=8)
    long = (999, " ".join(x[1] for x in extra) + "x" * 3000, "a", "s1", 0, 0, 0, "", "")
    docs = spark.createDataFrame([*extra, long], COLUMNS)
    parts = docs.selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "text")
    batches = parts.toArrow().to_batches(10)
    monkeypatch.setattr(divergence, "HELD", 25)
    monkeypatch.setattr(divergence, "SLICE", 100)
    got, found = Counter(), Counter()
    for b in divergence._counts(iter(batches)):
        for r in b.to_pylist():
            got[r["lang"], r["source"], r["term"]] += r["n"]
            found[r["lang"], r["source"], r["term"]] += r["docs"]
    want, docs_with = Counter(), Counter()
    for _, text, lang, source, *_ in [*extra, long]:
        terms = TERM.findall(text.translate(LOWER))
        want.update((lang or "", source, t) for t in terms)
        docs_with.update((lang or "", source, t) for t in set(terms))
    assert got == want and found == docs_with


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32))
def test_walks_price_equal_pairs_once(seed):
    draw = np.random.default_rng(seed)
    counts = draw.choice([0, 0, 0, 1, 2, 50, -1], (int(draw.integers(1, 6)), 16))
    counts[:, (counts == -1).any(axis=0)] = -1
    forest = divergence.Forest(counts)
    one, two = draw.integers(0, len(counts), 9), draw.integers(0, len(counts), 9)
    pair, x, y, times = forest.walk(one, two)
    want = Counter()
    for k, (a, b) in enumerate(zip(one, two, strict=True)):
        want.update((k, int(v), int(w)) for v, w in zip(counts[a], counts[b], strict=True) if v >= 0)
    got = list(zip(pair.tolist(), x.tolist(), y.tolist(), strict=True))
    assert len(got) == len(set(got)) and dict(zip(got, times.tolist(), strict=True)) == dict(want)
    assert pair.tolist() == sorted(pair.tolist())


def test_equal_subtrees_are_one_node():
    counts = np.tile(np.array([1, 2, 1, 2, 0, 0, 0, 0]), (50, 1))
    forest = divergence.Forest(counts)
    assert [len(left) for left, _ in forest.children] == [2, 2, 1]


@given(st.integers(0, 10**14), st.integers(1, 8 * 10**15))
def test_shares_are_exact(n, more):
    total = n + more
    assert int(divergence.shares(np.array([n]), np.array([total]))[0]) == 1 + 10**9 * (n + 1) // total


def test_few_rows(spark, none):
    assert divergence.audit(none).collect() == []
    rows = [(1, "a b", "en", "x", 0, 0, 0, "", ""), (1, "a b", "en", "y", 0, 0, 0, "", ""), (2, None, None, None, 0, 0, 0, "", "")]
    got = sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, COLUMNS)).collect()))
    assert got == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
