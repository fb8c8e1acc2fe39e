"""Substring, line and near-duplicate operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_rows import COLUMNS, hard_rows, passage

from tapeloom.llm import linededup, ngramjoin, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = hard_rows()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(got, want):
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)


def brute_substrings(rows, size):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    for (doc_id, *_), w in zip(rows, words, strict=True):
        gone = {p for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for p in range(i, i + size)}
        yield doc_id, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))


@pytest.mark.parametrize(("size", "seed"), [(35, 12), (6, 3)])
def test_substrings(hard, size, seed):
    got = substring.dedup_substrings(hard, size, seed).collect()
    same([(r.doc_id, r.n_words, r.n_removed, sha(r.text)) for r in got], list(brute_substrings(ROWS, size)))


def test_substrings_of_few_words(spark):
    """Many repeats of all kinds: overlapping, inside one text, variants of a passage around one anchor."""
    draw = random.Random(4)
    rows = [(k, " ".join(draw.choices("ab", k=draw.randint(0, 60)))) for k in range(60)]
    rows += [(100 + k, f"{passage(k, 3)} {passage(3, 5)} {passage(k // 3, 4)} {passage(3, 5)}") for k in range(12)]
    got = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 8, 3).collect()
    same([(r.doc_id, r.n_words, r.n_removed, sha(r.text)) for r in got], list(brute_substrings(rows, 8)))


def variants(draw, n, words):
    """Near copies of one passage: each takes one of three words in some places, with its own words around."""
    at = sorted(draw.sample(range(words), words // 25))
    base = passage(70, words).split()
    for k in range(n):
        own = list(base)
        for p in at:
            own[p] = draw.choice((base[p], "x", "y"))
        cut = draw.randrange(words // 2)
        yield k, " ".join([passage(900 + k, draw.randint(0, 20)), *own[cut : cut + draw.randint(40, words)], passage(990 + k, draw.randint(0, 20))])


def test_substrings_of_near_copies(spark):
    rows = list(variants(random.Random(2), 60, 300))
    got = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([(r.doc_id, r.n_words, r.n_removed, sha(r.text)) for r in got], list(brute_substrings(rows, 35)))


def test_anchors_are_in_every_run():
    draw = np.random.default_rng(1)
    words = draw.integers(0, 3, 400).astype(np.uint64)
    first = np.array([0, 30, 30, 34, 200, 400])
    place, _ = substring.anchors(words, first, 20, 5)
    for a, b in zip(first[:-1], first[1:], strict=True):
        for start in range(a, b - 19):
            assert ((place >= start) & (place <= start + 15)).any()


def brute_lines(rows):
    blanks = " \t\n\x0b\x0c\r"
    keys = [[x.strip(blanks).translate(LOWER) for x in (t or "").split("\n")] for _, t, *_ in rows]
    count, last = Counter(), {}
    for (doc_id, *_), own in zip(rows, keys, strict=True):
        for k in set(own):
            count[k] += 1
            if doc_id is not None:
                last[k] = max(last.get(k, doc_id), doc_id)
    for (doc_id, t, *_), own in zip(rows, keys, strict=True):
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, own, strict=True) if not (len(k) >= 40 and count[k] >= 5 and doc_id != last.get(k))]
        yield doc_id, len(lines), len(lines) - len(stay), sha("\n".join(stay))


def test_lines(hard):
    got = linededup.dedup_lines(hard)
    assert got.schema["doc"].dataType == hard.schema
    same([(r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in got.collect()], list(brute_lines(ROWS)))


def test_line_store_is_reversible(spark, hard):
    more = spark.createDataFrame([(100 + k, r[1], *r[2:]) for k, r in enumerate(ROWS)], COLUMNS)
    one = linededup.empty_store(spark, shards=3).insert(hard)
    two = one.insert(more)
    back = two.delete(more)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(back.counts) == key(one.counts) and key(back.postings) == key(one.postings)
    # the filters answer for the same keys
    assert key(back.drops(back.postings)) == key(one.drops(one.postings))
    gone = two.delete(hard)
    assert key(gone.counts) == key(linededup.empty_store(spark, shards=3).insert(more).counts)
    same([(r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in linededup.apply_store(back, hard).collect()], list(brute_lines(ROWS)))


def test_line_filters_may_be_left_out(hard, monkeypatch):
    monkeypatch.setattr(linededup, "FILTER_BYTES", -1)
    same([(r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in linededup.dedup_lines(hard).collect()], list(brute_lines(ROWS)))


def test_cuckoo_filter():
    draw = np.random.default_rng(3)
    keys = draw.integers(-(1 << 63), 1 << 63, 5000)
    mine = linededup.CuckooFilter.sized(len(keys))
    assert mine.insert(keys) and mine.contains(keys).all()
    assert mine.contains(draw.integers(-(1 << 63), 1 << 63, 20_000)).mean() < 0.002
    mine.delete(keys[:2500])
    assert linededup.CuckooFilter.load(mine.dump()).contains(keys[2500:]).all() and mine.contains(keys[:2500]).mean() < 0.01
    mine.delete(keys[2500:])
    assert not mine.table.any()


def brute_near(rows, size, percent):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (doc_id, *_) in zip(group, rows, strict=True):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return [(doc_id, len(s), least.get(g)) for (doc_id, *_), s, g in zip(rows, sets, group, strict=True)]


def edited(rows, draw, edits):
    words = draw.choice(rows)[1].split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = passage(draw.randrange(10**6), 1)
    return " ".join(words)


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (2, 50)])
def test_near_duplicates(hard, size, percent):
    same([tuple(r) for r in ngramjoin.near_duplicates(hard, size, percent).select("doc_id", "n_shingles", "component_id").collect()], brute_near(ROWS, size, percent))


def test_chains_and_groups_of_near_copies(spark):
    """Links of links, many variants of one text, a passage that most texts share, and pairs close to the limit."""
    draw = random.Random(8)
    rows = [(k, passage(k, 200)) for k in range(12)]
    for k in range(90):
        rows.append((1000 - k, edited(rows, draw, draw.randint(1, 9))))
    rows += [(2000 + k, passage(5000, 120) + " " + passage(6000 + k, draw.randint(10, 60))) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (85, 70):
        same([tuple(r) for r in ngramjoin.near_duplicates(frame, 4, percent).select("doc_id", "n_shingles", "component_id").collect()], brute_near(rows, 4, percent))


def test_empty_tables(none):
    assert substring.dedup_substrings(none).count() == linededup.dedup_lines(none).count() == ngramjoin.near_duplicates(none).count() == 0
