"""As-of joins, islands, ranks and bootstraps against brute force on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import asof, intervals, ranks, stats


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("bucket", [50.0, 1e6])
def test_asof_matches_brute_force(spark, forward, bucket):
    rng = np.random.default_rng(0)
    left = pd.DataFrame({"k": rng.integers(0, 3, 200), "t": rng.integers(0, 1000, 200).astype(float), "i": range(200)})
    right = pd.DataFrame({"k": rng.integers(0, 3, 60), "u": rng.permutation(1000)[:60].astype(float)})
    right["v"] = np.where(np.arange(60) % 5 == 0, np.nan, np.arange(60.0))
    r = spark.createDataFrame(right).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = asof.asof_join(spark.createDataFrame(left), r, ["k"], "t", "u", ["v"], tolerance=40, forward=forward, bucket_s=bucket, age="age")
    got = got.orderBy("i").toPandas()
    for row in got.itertuples():
        x = right[right.k == row.k]
        x = x[x.u >= row.t].sort_values("u") if forward else x[x.u <= row.t].sort_values("u", ascending=False)
        if len(x) and abs(x.u.iloc[0] - row.t) <= 40:
            assert row.age == abs(x.u.iloc[0] - row.t)
            assert (np.isnan(row.v) and np.isnan(x.v.iloc[0])) or row.v == x.v.iloc[0]
        else:
            assert np.isnan(row.age) and np.isnan(row.v)


def test_ranks_in_cells_match_pandas(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"g": np.where(np.arange(900) < 600, "hot", "b"), "x": rng.integers(0, 40, 900).astype(float), "i": range(900)})
    p.loc[:250, "x"] = 7.0  # one value holds a third of all rows
    p["y"] = (rng.random(900) < 0.3 + p.x / 100).astype(int)
    df = spark.createDataFrame(p)
    for cells in (2, 8, 256):
        got = ranks.average_rank(df, ["g"], "x", "r", cells=cells).orderBy("i").toPandas()
        np.testing.assert_allclose(got.r, p.groupby("g").x.rank())
        o = ranks.ordinal_rank(df, ["g"], "x", ["i"], "r", cells=cells).orderBy("i").toPandas()
        want = p.sort_values(["x", "i"], ascending=[False, True]).groupby("g").cumcount().sort_index() + 1
        assert (o.r.to_numpy() == want.to_numpy()).all()
        a = ranks.auc(df, ["g"], "x", "y", cells=cells).toPandas().set_index("g").auc
        for g, q in p.groupby("g"):
            pos, neg = q[q.y == 1].x.to_numpy()[:, None], q[q.y == 0].x.to_numpy()[None, :]
            assert a[g] == pytest.approx(((pos > neg) + 0.5 * (pos == neg)).mean())


def test_missing_intervals(spark):
    cov = spark.createDataFrame([("a", 2, 4), ("a", 3, 6), ("a", 8, 9), ("b", 0, 100)], "s string, a long, z long")
    want = spark.createDataFrame([("a", 0, 10), ("b", 5, 7), ("c", 1, 2)], "s string, a long, z long")
    got = intervals.missing_intervals(want, cov, ["s"], "a", "z").orderBy("s", "a").collect()
    assert [tuple(r) for r in got] == [("a", 0, 2), ("a", 6, 8), ("a", 9, 10), ("c", 1, 2)]


def test_false_discovery(spark):
    p = [0.01, 0.04, 0.03, None, 0.5]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = {r.i: r.q_value for r in stats.false_discovery(df, "p").collect()}
    assert got[3] is None
    assert got[0] == pytest.approx(0.04) and got[2] == pytest.approx(0.16 / 3) and got[4] == pytest.approx(0.5)


def test_draw_weights_have_mean_and_variance_one(spark):
    w = spark.range(200).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(1), F.lit(200))).alias("b"))
    m, v = w.select(stats.draw_weight(F.col("c"), F.col("b")).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(m - 1) < 0.03 and abs(v - 1) < 0.05


def test_normal_ppf(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    from tapeloom.functions.numeric import normal_ppf

    points = [1e-300, 1e-20, 1e-6, 0.01, 0.0749, 0.075, 0.3, 0.5, 0.8, 0.925, 0.99, 1 - 1e-12]
    rows = spark.createDataFrame([(p,) for p in [*points, 0.0, 1.0, -1.0, None]], "p double").select("p", normal_ppf(F.col("p")).alias("z")).collect()
    for r in rows:
        want = NormalDist().inv_cdf(r.p) if r.p is not None and 0 < r.p < 1 else None
        assert r.z == want or abs(r.z - want) < 1e-14 * max(1, abs(want))
