"""Scores of indicators against future returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tapeloom.operators import ranks, stats, tiling


def long_scores_input(bars: DataFrame, indicators: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """Long table (symbol, t, indicator, horizon, x, ret, dir) of complete pairs.

    Both unpivots are explodes of literal arrays, so the wide rows are read once and nothing is joined.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("indicator"), F.col(i).alias("x")) for i in indicators])
    goals = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("ret"), F.col(f"dir_{h}").alias("dir")) for h in horizons])
    return (bars.select("symbol", F.col("t").cast("long").alias("t"), F.inline(cells), *[c for h in horizons for c in (f"fwd_{h}", f"dir_{h}")])
            .select("symbol", "t", "indicator", "x", F.inline(goals)).filter(F.col("x").isNotNull() & F.col("ret").isNotNull()))


def purged_split(rows: DataFrame, keys: Sequence[str], order: str, share: float, horizon: str | int) -> DataFrame:
    """``part`` = train / test by row number; the last ``horizon`` train rows are purged (part NULL)."""
    h = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    numbered = tiling.number_rows(rows, keys, order)
    cut = F.floor(F.col(tiling.TOTAL) * share)
    part = F.when(F.col(tiling.ROW) >= cut, "test").when(F.col(tiling.ROW) < cut - h, "train")
    return numbered.withColumn("part", part).drop(*tiling.INTERNAL)


def indicator_scores(long: DataFrame, *, share: float = 0.7, least_day: int = 10, lags: int = 5) -> DataFrame:
    """One row per symbol, indicator and horizon: rank correlation, HAC t, daily t, train and test, hit rate, AUC."""
    g = ["symbol", "indicator", "horizon"]
    long = ranks.materialise(long)  # read by every score below
    z = stats.standardised_ranks(long, g, "x", "ret")
    hac = stats.newey_west_slope(z, g, "t", "zx", "zy", lags, out="ic_nw_t").withColumnRenamed("slope", "ic_spearman")
    dated = long.withColumn("day", F.floor(F.col("t") / 86400)).withColumn("month", F.floor(F.col("t") / (86400 * 30)))
    daily = stats.daily_ic(dated, g, "day", "month", "x", "ret", least=least_day)
    parts = ranks.materialise(purged_split(long, g, "t", share, "horizon"))
    split = stats.spearman(parts.filter(F.col("part").isNotNull()), [*g, "part"], "x", "ret")
    at = lambda p: F.max(F.when(F.col("part") == p, F.col("ic")))
    split = ranks.materialise(split.groupBy(*g).agg(at("train").alias("ic_train"), at("test").alias("ic_test")))
    train = parts.filter(F.col("part") == "train").groupBy(*g).agg(F.percentile("x", F.lit(0.5)).alias("median_train"))
    oos = parts.filter((F.col("part") == "test") & F.col("dir").isNotNull()).join(train, g).join(split, g)
    up = (F.col("x") - F.col("median_train")) * F.signum("ic_train") > 0
    hits = oos.groupBy(*g).agg(F.count(F.lit(1)).alias("n_oos"), F.avg((up == (F.col("dir") == 1)).cast("double")).alias("hit_rate_oos"))
    auc = ranks.auc(oos, g, "x", "dir").select(*g, "auc")
    out = hac.join(daily, g, "left").join(split, g, "left").join(hits, g, "left").join(auc, g, "left")
    return out.withColumn("auc_oos", F.when(F.col("ic_train") > 0, F.col("auc")).when(F.col("ic_train") < 0, 1 - F.col("auc"))).withColumn(
        "p_hit", stats.hit_test(F.col("hit_rate_oos"), F.col("n_oos") / F.col("horizon"))).drop("auc")
