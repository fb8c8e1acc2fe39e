"""Sharding, quality rules, decontamination and language identification against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_rows import COLUMNS, hard_rows, passage

from tapeloom.llm import decontam, langid, quality, shards
from tapeloom.llm.tables import shared_folder

ROWS = hard_rows()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same(got, want):
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_shards(spark, hard):
    made = shards.external_shuffle(hard, 7, bucket_bytes=20_000)
    rows = made.collect()
    assert made.schema["doc"].dataType == hard.schema
    same([tuple(r.doc) for r in rows], ROWS)
    counts = Counter(r.shard for r in rows)
    assert sorted(counts) == list(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(7) for k in range(counts[s])]
    again = shards.external_shuffle(hard.repartition(5), 7, bucket_bytes=20_000)
    place = lambda df: sorted((r.doc.doc_id or -1, r.shard, r.slot) for r in df.collect())
    assert place(again) == place(made)
    other = shards.external_shuffle(hard, 7, seed=5, bucket_bytes=20_000)
    assert place(other) != place(made)
    written = shards.write_shards(made, f"{shared_folder(spark)}/out")
    same([tuple(r.doc) + (r.shard, r.slot) for r in written.collect()], [tuple(r.doc) + (r.shard, r.slot) for r in rows])
    got = shards.shard_digest(hard).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in ROWS)


def test_a_bucket_is_shuffled_evenly(spark):
    """Each of 4 rows of one bucket takes each place about as often."""
    rows = spark.range(4).selectExpr("id as doc_id", "'' as text")
    seen = Counter()
    for seed in range(60):
        seen.update((r.doc.doc_id, r.slot) for r in shards.external_shuffle(rows, 1, seed=seed).collect())
    assert len(seen) == 16 and sum((n - 15) ** 2 / 15 for n in seen.values()) < 40


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def char_classes(text):
    out = Counter()
    for c in text or "":
        if re.match("[a-z]", c):
            out["lower"] += 1
        elif re.match(r"[ \x09-\x0D]", c):
            out["space"] += 1
        elif re.match("[A-Z]", c):
            out["upper"] += 1
        elif c.isalpha():
            out["letter"] += 1
        elif re.match(r"\d", c):
            out["digit"] += 1
        elif c in ".,;:!?'\"()-":
            out["mark"] += 1
        else:
            out["other"] += 1
    return out


def distance(p, q):
    """The Jensen-Shannon distance of two counters."""
    a, b = sum(p.values()), sum(q.values())
    total = 0.0
    for k in {*p, *q}:
        x, y = p[k] / a, q[k] / b
        total += sum(v * math.log2(2 * v / (x + y)) / 2 for v in (x, y) if v)
    return math.sqrt(max(0, total))


def test_quality_rules(spark, hard):
    prose = {
        "en": "the house of a man is not for this and that but it was on from",
        "fr": "le chat est dans la maison et il ne va pas sur une table de bois",
    }
    draw = random.Random(1)
    rows = [(*r[:2], None, *r[3:]) for r in ROWS]
    for k in range(40):
        lang = ("en", "fr")[k % 2]
        words = [draw.choice(prose[lang].split()) if draw.random() < 0.6 else passage(k * 1000 + j, 1) for j in range(200)]
        rows.append((3000 + k, (" ".join(words).capitalize() + ".").replace("a", "à" if lang == "fr" else "a"), lang, None, None, None, None, None, None))
    rows.append((4000, " ### ".join(passage(77, 300).split()), None, None, None, None, None, None, None))
    got = quality.judge(spark.createDataFrame(rows, COLUMNS)).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], [(k, *base_counts(t)) for k, t, *_ in rows])
    common = {w for words in quality.COMMON_WORDS.values() for w in words}
    refs = {}
    for lang in ("en", "fr"):
        texts = [t or "" for _, t, own, *_ in rows if own == lang]
        refs[lang] = (sum(map(char_classes, texts), Counter()), Counter(w if w in common else None for t in texts for w in WORD.findall(t)))
    by_text = {}
    for r in got:
        by_text.setdefault((r.doc_id, r.n_words, r.word_chars), r)
    for doc_id, text, *_ in rows:
        r = by_text[(doc_id, *base_counts(text)[:2])]
        n, _, _, _, repeated = base_counts(text)
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        near = False
        for lang, (chars, words) in refs.items():
            if n:
                c, w = distance(char_classes(text), chars), distance(Counter(x if x in common else None for x in WORD.findall(text)), words)
                assert abs(r[f"char_{lang}"] - c) < 1e-6 and abs(r[f"word_{lang}"] - w) < 1e-6
                near |= c <= quality.CHAR_LIMIT and (n < quality.MIN_WORDS or w <= quality.WORD_LIMIT)
        assert r.kept == (not r.base_failed and (len(text or "") < quality.MIN_CHARS or near))
    kept = {r.doc_id for r in got if r.kept}
    assert {3000 + k for k in range(40)} <= kept and 4000 not in kept


def brute_matches(docs, items, window):
    runs = {}
    for name, text in items:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            runs.setdefault(tuple(w[i : i + size]), set()).add(str(name))
    sizes = {len(r) for r in runs}
    for doc_id, text in docs:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for s in sizes:
            for i in range(len(w) - s + 1):
                if (found := runs.get(tuple(w[i : i + s]))) is not None:
                    hit |= set(range(i, i + s))
                    names |= found
        yield doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, passage(1, 14)), (2, passage(1, 60)[40:220]), (10, "one two three"), (11, "two"), (12, None), (13, "!!!"), (14, passage(100, 30).upper()), (15, passage(103, 12)), (16, "Word " * 12)]


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_decontamination(spark, hard, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontam.matches(hard, items, block_bytes=block).withColumn("n_hit", decontam.covered()).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in found]
    same(got, list(brute_matches([r[:2] for r in ROWS], ITEMS, 10)))


def test_decontamination_of_few_words(spark):
    """Many overlapping matches: words from a small alphabet, items within items."""
    draw = random.Random(6)
    text = lambda n: " ".join(draw.choices("abc", k=n))
    items = [(f"i{k}", text(draw.randint(0, 9))) for k in range(25)]
    docs = [(k, text(draw.randint(0, 40))) for k in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontam.matches(frame, spark.createDataFrame(items, "item_id string, text string"), window=5).withColumn("n_hit", decontam.covered()).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in found]
    same(got, list(brute_matches(docs, items, 5)))


def test_decontaminated_texts(spark, hard):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    made = decontam.decontaminate(hard, items)
    marks = {k: (n, h) for k, n, h, *_ in brute_matches([r[:2] for r in ROWS if r[0] is not None and r[0] != 5], ITEMS, 10)}
    got = {r.doc_id: r for r in made.collect() if r.doc_id in marks}
    for doc_id, (n, hit) in marks.items():
        text = ROWS[doc_id][1]
        if hit > 0.5 * n:
            assert doc_id not in got
        elif not hit:
            assert got[doc_id].text == text
        else:
            assert len(ITEM_WORD.findall(got[doc_id].text.translate(LOWER))) == n - hit


def test_codewords_are_far_apart():
    for n in range(2, 30):
        code = langid.codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= (2 ** (n - 2) if n <= 6 else code.shape[1] // 5)


def test_language_identification(spark, hard):
    letters = {"en": "the and thing", "fr": "éàç que le", "de": "ßü sch ung", "xx": "ñó zk"}
    draw = random.Random(2)
    rows = [(k, "".join(draw.choices(letters[lang], k=draw.choice((8, 50, 400)))), lang) for k, lang in enumerate(list(letters) * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 !!", "fr"), (902, "", None), (None, "the thing", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language_digest(docs).collect()}
    assert len(got) == len(rows) + 4
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902))
    assert not got[None].held_out and got[None].lang_pred in letters
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, *_ in rows)
    held = [got[k].lang_pred == lang for k, _, lang in rows if got[k].held_out]
    assert len(held) > 30 and np.mean(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    # what is predicted does not read the language, and learning does not read held-out rows
    blind = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'fr' else lang end as lang")
    assert {r.doc_id: r.lang_pred for r in langid.language_digest(blind).collect()} == {k: r.lang_pred for k, r in got.items()}


def test_common_words_of_short_documents(spark):
    """From 40 to 119 words the common words decide too, within a limit that widens as the text gets shorter."""
    draw = random.Random(6)
    prose = "the house of a man is not for this and that but it was on from".split()
    text = lambda k, n, share: " ".join(draw.choice(prose) if draw.random() < share else passage(k * 1000 + j, 1) for j in range(n))
    rows = [(k, text(k, 200, 0.35), "en") for k in range(40)]
    rows += [(100 + k, " | ".join(passage(500 + k, 40 + 8 * k).split()), None) for k in range(5)]
    rows += [(200 + k, passage(600 + k, 60 + 6 * k), None) for k in range(10)]
    rows += [(300 + k, text(300 + k, 64 + 8 * (k % 7), 0.05 + k / 200), None) for k in range(60)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(not r.kept for k, r in got.items() if 100 <= k < 300)
    wide = 0
    for k, r in got.items():
        limit = 0.28 + 0.04 * max(0, 120 - r.n_words) / 80
        assert r.n_chars >= 200 and r.kept == (r.char_en <= 0.30 and r.word_en <= limit), k
        wide += r.kept and r.word_en > 0.28
    assert wide > 0


def test_empty_tables(spark, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert shards.shard_digest(none).count() == quality.judge(none).count() == langid.language_digest(none).count() == 0
    assert decontam.decontamination_digest(none, items).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_items_without_an_id(spark, block):
    """Their passages are hits, also when another item holds the same words, but only named items are listed."""
    shared, own, lone = passage(70, 12), passage(71, 12), passage(72, 3)
    items = spark.createDataFrame([(None, shared), (None, own), (5, shared), (None, lone), (6, passage(73, 15)), (None, None)], "item_id long, text string")
    docs = [(1, f"x {shared} y", *[None] * 7), (2, f"{own} z", *[None] * 7), (3, "nothing of this", *[None] * 7), (4, f"a {lone} b", *[None] * 7)]
    frame = spark.createDataFrame(docs, COLUMNS)
    found = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontam.matches(frame, items, block_bytes=block).withColumn("n_hit", decontam.covered()).collect()}
    assert found == {1: (12, ["5"]), 2: (12, []), 3: (0, []), 4: (3, [])}
    kept = {r.doc_id: r.text for r in decontam.decontaminate(frame, items, coverage=0.95).collect()}
    assert kept[1].split() == ["x", "y"] and kept[2].split() == ["z"] and kept[3] == docs[2][1]


def test_no_references_and_no_items(spark):
    one = spark.createDataFrame([(1, passage(1, 100), None), (2, "short", None)], "doc_id long, text string, lang string")
    assert [r.kept for r in quality.judge(one).orderBy("doc_id").collect()] == [True, False]
    assert [r.n_hit for r in decontam.decontamination_digest(one, spark.createDataFrame([], "item_id long, text string")).collect()] == [0, 0]
    assert {r.lang_pred for r in langid.language_digest(one).collect()} == {"und"}
