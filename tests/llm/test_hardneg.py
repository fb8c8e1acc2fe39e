"""Hard negatives against brute force, exact scores against Python's integers."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import hardneg

COLUMNS = "vec_id long, embedding array<float>, label int, number long, cell int, windows string"


def brute(rows):
    good = []
    for k, (vec_id, vector, label, *_) in enumerate(rows):
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in vector]
        good.append((k, vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, whole))
    out = []
    for k, anchor_id, label, a in good:
        if anchor_id % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), i, n, lab) for n, i, lab, b in good if n != k]  # noqa: B905
        for p, positive_id, _, _ in sorted(x for x in scored if x[3] == label)[:5]:
            found = sorted(x for x in scored if x[3] != label and 80 * -p <= 100 * -x[0] <= 100 * -p)[:5]
            out += [(anchor_id, positive_id, r, x[1], -p, -x[0]) for r, x in enumerate(found, 1)]
    return sorted(out)


def given_rows():
    draw = np.random.default_rng(6)
    base = draw.normal(0, 0.3, (40, 5))
    rows = []
    for k in range(700):
        v = base[draw.integers(0, 40)] + (draw.normal(0, 0.02, 5) if k % 3 else 0)
        rows.append((int(k * 4), v.astype(np.float32).tolist(), int(draw.integers(0, 4)), k, k, "w"))
    rows += [rows[0], rows[0], rows[25], (None, [0.1] * 5, 1, 1, 1, ""), (100, None, 1, 1, 1, ""), (100, [0.1, None, 0.1, 0.1, 0.1], 1, 1, 1, ""), (200, [float("nan")] * 5, 1, 1, 1, "")]
    rows += [(300, [float("inf")] * 5, 1, 1, 1, ""), (400, [0.5] * 5, None, 1, 1, ""), (500, [], 2, 1, 1, ""), (600, [0.2, 0.3], 3, 1, 1, ""), (700, [-1e-20, 0.0, -0.0, 1.0, -1.0], 9, 1, 1, "")]
    rows += [(900 + k, [0.9] * 5, k % 3, 1, 1, "") for k in range(200)]
    return rows


@pytest.mark.parametrize("anchors, tile, block, groups", [(16_384, 256, 8192, 4), (3, 2, 64, 7)])
def test_against_brute_force(spark, monkeypatch, anchors, tile, block, groups):
    for name, value in (("ANCHORS", anchors), ("TILE", tile), ("ROWS", block)):
        monkeypatch.setattr(hardneg, name, value)
    rows = given_rows()
    got = hardneg.negatives_digest(spark.createDataFrame(rows, COLUMNS).repartition(groups))
    assert [(n, t) for n, t in got.dtypes] == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_few_rows(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert hardneg.negatives_digest(none).collect() == []
    only = spark.createDataFrame([(1, [0.5], 1, 0, 0, ""), (2, [0.5], 2, 0, 0, "")], COLUMNS)
    assert hardneg.negatives_digest(only).collect() == []
    alone = spark.createDataFrame([(100, [0.5], 1, 0, 0, ""), (2, [0.5], 2, 0, 0, "")], COLUMNS)
    assert hardneg.negatives_digest(alone).collect() == []
    # scores of zero lie in the window of a zero
    zeros = [(100, [0.0], 1, 0, 0, ""), (3, [0.5], 1, 0, 0, ""), (4, [0.5], 2, 0, 0, "")]
    assert [tuple(r) for r in hardneg.negatives_digest(spark.createDataFrame(zeros, COLUMNS)).collect()] == [(100, 3, 1, 4, 0, 0)]


def test_large_scores_are_refused(spark):
    rows = [(100, [1e8], 1, 0, 0, ""), (3, [1e8], 1, 0, 0, "")]
    with pytest.raises(ValueError, match="2\\*\\*62"):
        hardneg.negatives_digest(spark.createDataFrame(rows, COLUMNS)).collect()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 300), st.sampled_from([1, 200, 10**5, 10**8, 3 * 10**8]))
def test_scores_are_exact(seed, width, most):
    draw = np.random.default_rng(seed)
    a, b = draw.integers(-most, most + 1, (3, width)), draw.integers(-most, most + 1, (4, width))
    if seed % 3 == 0:
        a[:], b[:] = most, -most
    bound = most * most * width
    if bound >= hardneg.LARGEST:
        return
    moduli = hardneg.primes(bound)
    got = hardneg.scores(hardneg.Residues(a.astype(float), moduli), hardneg.Residues(b.astype(float), moduli))
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]


@given(st.integers(-(10**18), 10**18), st.integers(1, 100))
def test_least_score(high, low):
    assert int(hardneg.least_score(np.array([high]), low)[0]) == -(-low * high // 100)
