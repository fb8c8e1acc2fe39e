"""The pipeline's stages on rows of all kinds, and its registration."""

import re

import corpus_pipeline
from conftest_rows import COLUMNS, hard_rows, passage
from test_dedup import brute_lines, brute_near
from test_filters import brute_matches

from tapeloom.llm import quality
from tapeloom.llm.tables import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = hard_rows()


def key(row):
    return tuple((x is None, str(x)) for x in row)


def test_stages(spark, hard, tmp_path):
    prepare(spark)
    item = passage(1, 60)
    spark.createDataFrame([(1, item), (2, passage(104, 80))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = hard, ROWS
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(f"{tmp_path}/{k}.parquet")
        made = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        assert made.columns == hard.columns
        got = sorted(map(tuple, made.collect()), key=key)
        if k == 0:
            stays = {(r.doc_id, r.n_words, r.word_chars) for r in quality.judge(docs).collect() if r.kept}
            want = [r for r in kept if (r[0], len(WORD.findall(r[1] or "")), sum(map(len, WORD.findall(r[1] or "")))) in stays]
            assert len(want) > 15
        elif k == 1:
            gone = {i for i, (_, _, n, _) in enumerate(brute_lines(kept)) if n}
            for row, i in zip(kept, range(len(kept)), strict=True):
                if i not in gone:
                    assert row in got
            want = None
        elif k == 2:
            groups = brute_near(kept, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
            lasting = {c for _, n, c in groups if n}
            assert sorted(r[0] for r in got if WORD.search(r[1] or "") and r[0] is not None) == sorted(c for c in lasting if c is not None)
            want = None
        else:
            marks = list(brute_matches([r[:2] for r in kept], [(1, item), (2, passage(104, 80))], 10))
            clean = [r for r, m in zip(kept, marks, strict=True) if not m[2]]
            assert all(r in got for r in clean) and not any(m[2] for m in brute_matches([r[:2] for r in got], [(1, item)], 10) if m[2] > 9 and m[1] < 10)
            want = None
        if want is not None:
            assert got == sorted(want, key=key)
        docs, kept = made, [tuple(r) for r in made.collect()]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r[0] for r in kept}


def test_near_duplicates_of_null_and_equal_ids(spark):
    """Unlinked documents stay, whatever their ids; of linked ones the smallest id stays, or one of the null ids."""
    alone = [(None, passage(300 + k, 60)) for k in range(5)] + [(7, passage(310, 60)), (7, passage(311, 60))]
    twice = [(8, passage(312, 60)), (None, passage(312, 60)), (None, passage(313, 60)), (None, passage(313, 60).upper())]
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(alone + twice, "doc_id long, text string"), "").collect()]
    assert len(got) == len(set(got)) == 9
    assert {*alone, twice[0]} < set(got) and len({*twice[2:]} & set(got)) == 1


def test_run_and_entry(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n in entry.queries() if n.startswith("op")] == [
        "op1_packing", "op2_substring_dedup", "op3_sharding", "op4_quality_rules", "op5_decontamination", "op6_language_id", "op7_html_extraction", "op8_line_dedup", "op9_ngram_join", "op10_token_files",
        "op11_hard_negatives", "op12_byte_bpe", "op13_divergence_audit",
    ]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_empty_table(spark, none, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0 and COLUMNS
