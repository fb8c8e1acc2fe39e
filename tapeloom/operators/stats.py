"""Inference on long tables: rank correlation, HAC tests, bootstraps, false-discovery control."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tapeloom.functions.numeric import as_col, div, normal_cdf, normal_ppf
from tapeloom.functions.prob import brier, log_loss, two_sided_p, wilson
from tapeloom.operators import ranks, tiling

# Cumulative Poisson(1) probabilities.
POISSON1 = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
            0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


@F.pandas_udf(T.DoubleType())
def binomial_half_tail(k: pd.Series, n: pd.Series) -> pd.Series:
    """P(X >= k) for X ~ B(n, 1/2), summed in logs.  Runs on aggregated rows only."""
    def one(a, b):
        if not (np.isfinite(a) and np.isfinite(b)) or b < 1:
            return np.nan
        a, b = int(a), int(b)
        i = np.arange(max(a, 0), b + 1)
        logs = [math.lgamma(b + 1) - math.lgamma(j + 1) - math.lgamma(b - j + 1) - b * math.log(2.0) for j in i]
        return float(min(1.0, np.exp(logs).sum())) if len(logs) else 0.0
    return pd.Series([one(a, b) for a, b in zip(k.astype(float), n.astype(float))])


def hit_test(hit: Column, n_eff: Column) -> Column:
    """One-sided exact p-value of a hit rate with ``floor(n_eff)`` effective trials."""
    n = F.floor(n_eff)
    return binomial_half_tail(F.rint(hit * n), n)


def safe_corr(x: str, y: str) -> Column:
    """Correlation that is NULL, not an error, when one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str, *, by_day: bool = False, out: str = "ic") -> DataFrame:
    """Pearson correlation of average ranks on complete pairs, with the pair count."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if not by_day:
        rows = ranks.materialise(rows.select(*group, x, y))
    rows = ranks.rank_columns(rows, group, {x: "_rx", y: "_ry"}, by_day=by_day)
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), safe_corr("_rx", "_ry").alias(out))


def daily_ic(df: DataFrame, group: Sequence[str], day: str, month: str, x: str, y: str, *, least: int) -> DataFrame:
    """Rank correlation inside each day; its mean, t statistic, and share of months with the sign of the overall rank correlation."""
    days = spearman(df, [*group, month, day], x, y, by_day=True).filter((F.col("n") >= least) & F.col("ic").isNotNull())
    months = days.groupBy(*group, month).agg(F.avg("ic").alias("_m"), F.sum("ic").alias("_s"), F.count(F.lit(1)).alias("_k"), F.sum(F.col("ic") * F.col("ic")).alias("_q"))
    total = months.groupBy(*group).agg(
        F.sum("_k").alias("n_days"), (F.sum("_s") / F.sum("_k")).alias("ic_daily_mean"), F.sum("_q").alias("_q"), F.sum("_s").alias("_s"),
        F.collect_list(F.signum("_m")).alias("_signs"))  # one entry per month
    var = (F.col("_q") - F.col("_s") * F.col("_s") / F.col("n_days")) / (F.col("n_days") - 1)
    total = total.join(spearman(df, group, x, y).drop("n"), list(group))
    return total.select(
        *group, "n_days", "ic_daily_mean",
        F.when((F.col("n_days") > 1) & (var > 0), F.col("ic_daily_mean") / F.sqrt(var / F.col("n_days"))).alias("ic_daily_t"),
        (F.size(F.filter("_signs", lambda s: s == F.signum("ic"))) / F.size("_signs")).alias("frac_months_same_sign"))


def _lag_sums(df: DataFrame, group: Sequence[str], order: str, value: str, lags: int, bucket_s: float) -> DataFrame:
    """gamma_k = sum of e_t e_{t-k} per group, k = 0..lags, on row tiles."""
    tiled = tiling.tile(ranks.materialise(df.select(*group, order, value)), group, order, behind=lags, bucket_s=bucket_s)
    w = tiling.tile_window(group)
    rows = tiling.untile(tiled.withColumns({f"_g{k}": F.col(value) * (F.lag(value, k).over(w) if k else F.col(value)) for k in range(lags + 1)}))
    return rows.groupBy(*group).agg(*[F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)).alias(f"_g{k}") for k in range(lags + 1)])


def _bartlett(lags: int) -> Column:
    total = F.col("_g0")
    for k in range(1, lags + 1):
        total = total + 2.0 * (1.0 - k / (lags + 1.0)) * F.col(f"_g{k}")
    return total


def newey_west_slope(df: DataFrame, group: Sequence[str], order: str, x: str, y: str, lags: int, *,
                     out: str = "nw_t", bucket_s: float = 86400.0) -> DataFrame:
    """t of the no-intercept slope of y on x with a Bartlett kernel and no small-sample correction."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = rows.groupBy(*group).agg((F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("_beta"), F.sum(F.col(x) * F.col(x)).alias("_sxx"))
    resid = rows.join(fit, list(group)).withColumn("_e", F.col(x) * (F.col(y) - F.col("_beta") * F.col(x)))
    var = _bartlett(lags) / (F.col("_sxx") * F.col("_sxx"))
    return fit.join(_lag_sums(resid, group, order, "_e", lags, bucket_s), list(group)).select(
        *group, F.col("_beta").alias("slope"), F.when(var > 0, F.col("_beta") / F.sqrt(var)).alias(out))


def newey_west_mean(df: DataFrame, group: Sequence[str], order: str, value: str, lags: int, *,
                    out: str = "nw_t", bucket_s: float = 86400.0) -> DataFrame:
    """t of a mean with HAC variance."""
    rows = df.filter(F.col(value).isNotNull())
    fit = rows.groupBy(*group).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    resid = rows.join(fit.select(*group, F.col("mean").alias("_mean")), list(group)).withColumn("_e", F.col(value) - F.col("_mean"))
    s = _bartlett(lags) / F.col("n")
    return fit.join(_lag_sums(resid, group, order, "_e", lags, bucket_s), list(group)).select(
        *group, "n", "mean", F.when((F.col("n") >= 3) & (s > 0), F.col("mean") / F.sqrt(s / F.col("n"))).alias(out))


def standardised_ranks(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Centred, scaled average ranks zx, zy: the slope of zy on zx is the rank correlation."""
    rows = ranks.materialise(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()))
    rows = ranks.rank_columns(rows, group, {x: "_rx", y: "_ry"})
    m = rows.groupBy(*group).agg(*[f(c).alias(a) for c, a in (("_rx", "x"), ("_ry", "y")) for f, a in ((F.avg, f"_m{a}"), (F.stddev_pop, f"_s{a}"))])
    return rows.join(m, list(group)).withColumns({
        "zx": div(F.col("_rx") - F.col("_mx"), F.col("_sx")), "zy": div(F.col("_ry") - F.col("_my"), F.col("_sy"))}).drop("_rx", "_ry", "_mx", "_my", "_sx", "_sy")


def pesaran_timmermann(group_df: DataFrame, group: Sequence[str], y: str, pred: str) -> DataFrame:
    """Independence of forecast and outcome, from four averages per group."""
    yy, xx = F.col(y).cast("double"), F.col(pred).cast("double")
    a = group_df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg((yy == xx).cast("double")).alias("hit"), F.avg(yy).alias("py"), F.avg(xx).alias("px"))
    n, py, px = F.col("n"), F.col("py"), F.col("px")
    star = py * px + (1 - py) * (1 - px)
    v = star * (1 - star) / n
    vs = (F.pow(2 * py - 1, F.lit(2.0)) * px * (1 - px) / n + F.pow(2 * px - 1, F.lit(2.0)) * py * (1 - py) / n + 4 * py * px * (1 - py) * (1 - px) / (n * n))
    ok = (v - vs > 0) & (py > 0) & (py < 1) & (px > 0) & (px < 1)
    stat = F.when(ok, (F.col("hit") - star) / F.sqrt(v - vs))
    return a.select(*group, "n", "hit", stat.alias("pt"), (1 - normal_cdf(stat)).alias("pt_p"))


def false_discovery(df: DataFrame, p: str, *, group: Sequence[str] = (), bh: str = "q_value", by: str = "q_value_by") -> DataFrame:
    """Benjamini-Hochberg and Benjamini-Yekutieli q-values over a table of test results (one row per test)."""
    key = list(group) or [F.lit(1)]
    has = F.col(p).isNotNull()
    asc = Window.partitionBy(*key).orderBy(F.col(p).asc_nulls_last())
    whole = Window.partitionBy(*key)
    d = df.withColumn("_i", F.when(has, F.row_number().over(asc))).withColumn("_m", F.count(p).over(whole))
    d = d.withColumn("_h", F.sum(F.when(has, 1.0 / F.col("_i"))).over(whole)).withColumn("_raw", F.col(p) * F.col("_m") / F.col("_i"))
    tail = Window.partitionBy(*key).orderBy(F.col("_i").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    low = F.min("_raw").over(tail)
    return d.withColumn("_low", low).withColumn(bh, F.when(has, F.least("_low", F.lit(1.0)))).withColumn(
        by, F.when(has, F.least(F.col("_low") * F.col("_h"), F.lit(1.0)))).drop("_i", "_m", "_h", "_raw", "_low")


def aggregate_scores(scores: DataFrame) -> DataFrame:
    """Cross-symbol summary per (indicator, horizon): mean, cross t, sign agreement, Stouffer Z and q-values."""
    keys = ["indicator", "horizon"]
    mean = scores.groupBy(*keys).agg(F.avg("ic").alias("_mean"))
    g = scores.join(mean, keys).groupBy(*keys).agg(
        F.count("ic").alias("n_tickers"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"),
        F.avg(F.when(F.col("ic").isNotNull(), (F.signum("ic") == F.signum("_mean")).cast("double"))).alias("frac_same_sign"),
        (F.sum("t") / F.sqrt(F.count("t"))).alias("z_combined"))
    g = g.withColumn("ic_t_cross", F.when(F.col("n_tickers") >= 2, div(F.col("ic_mean"), F.col("ic_std") / F.sqrt("n_tickers")))).withColumn(
        "p_combined", two_sided_p(F.col("z_combined")))
    return false_discovery(g, "p_combined").orderBy(F.abs("ic_mean").desc_nulls_last(), *keys)


def prob_metrics(df: DataFrame, group: Sequence[str], y: str, p: str) -> DataFrame:
    """n, accuracy, balanced accuracy, AUC, Brier, log-loss, skill against the base rate."""
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    yy, pp = F.col(y).cast("double"), F.col(p)
    hit = ((pp >= 0.5) == (yy > 0.5)).cast("double")
    rows = ranks.materialise(rows)
    m = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"),
        ((F.avg(F.when(yy == 1, hit)) + F.avg(F.when(yy == 0, hit))) / 2).alias("balanced_accuracy"),
        F.avg(brier(pp, yy)).alias("brier"), F.avg(log_loss(pp, yy)).alias("logloss"), F.avg(yy).alias("base_rate"))
    m = m.withColumn("brier_skill", 1 - div(F.col("brier"), F.col("base_rate") * (1 - F.col("base_rate"))))
    return m.join(ranks.auc(rows, group, p, y).select(*group, "auc"), list(group))


def calibration(df: DataFrame, group: Sequence[str], y: str, p: str, bins: int = 10) -> DataFrame:
    """Equal-width calibration bins with a Wilson interval of the observed frequency."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*group, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("p_mean"), F.sum(F.col(y).cast("double")).alias("_k"))
    lo, hi = wilson(F.col("_k"), F.col("n"))
    return g.select(*group, "bin", "n", "p_mean", (F.col("_k") / F.col("n")).alias("up_rate"), lo.alias("lo"), hi.alias("hi"))


def quantile_calibration(df: DataFrame, group: Sequence[str], y: str, p: str, bins: int = 10) -> DataFrame:
    """Calibration by quantile bins of the forecast; repeated edges collapse."""
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    probs = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    edges = rows.groupBy(*group).agg(F.array_distinct(F.percentile(p, probs)).alias("_e"))
    k = F.size(F.filter("_e", lambda e: e <= F.col(p))) - 1
    b = F.least(F.greatest(k, F.lit(0)), F.size("_e") - 2)
    return rows.join(edges, list(group)).withColumn("bin", b).groupBy(*group, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("p_mean"), F.avg(F.col(y).cast("double")).alias("up_rate"),
        F.min(F.element_at("_e", F.col("bin") + 1)).alias("p_lo"), F.min(F.element_at("_e", F.col("bin") + 2)).alias("p_hi"))


def tail_check(df: DataFrame, group: Sequence[str], y: str, p: str, lo: float) -> DataFrame:
    """Surprises expected and observed in both tails of the forecast."""
    yy = F.col(y).cast("double")
    low, high = F.col(p) <= lo, F.col(p) >= 1 - lo
    s = lambda c, x: F.sum(F.when(c, x).otherwise(0.0))
    return df.groupBy(*group).agg(
        F.count(F.when(low | high, 1)).alias("n_tail"),
        (s(low, F.col(p)) + s(high, 1 - F.col(p))).alias("expected"), (s(low, yy) + s(high, 1 - yy)).alias("observed"))


def cluster_mean(df: DataFrame, group: Sequence[str], cluster: str, value: str, z: float = 1.96) -> DataFrame:
    """Mean with a confidence interval robust to correlation inside clusters."""
    sums = df.filter(F.col(value).isNotNull()).groupBy(*group, cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    tot = sums.groupBy(*group).agg((F.sum("_s") / F.sum("_n")).alias("mean"), F.sum("_n").alias("n"))
    dev = sums.join(tot, list(group)).withColumn("_d", F.col("_s") - F.col("_n") * F.col("mean"))
    se = dev.groupBy(*group).agg(F.max("mean").alias("mean"), F.max("n").alias("n"), (F.sqrt(F.sum(F.col("_d") * F.col("_d"))) / F.max("n")).alias("se"))
    return se.withColumns({"lo": F.col("mean") - z * F.col("se"), "hi": F.col("mean") + z * F.col("se")})


def draw_weight(cluster: Column, draw: Column, seed: int = 0) -> Column:
    """Poisson(1) weight of a cluster in a bootstrap draw: the same for every statistic, and on every machine."""
    big = 2147483648
    h = F.pmod(cluster.cast("long") * 40503 + draw.cast("long") * 2654435 + seed * 97, F.lit(big))
    for _ in range(3):
        h = F.pmod(F.pmod(h * 1103515245 + 12345, F.lit(big)) + F.floor(h / 65536), F.lit(big))
    u = h / float(big)
    return sum(((u > c).cast("int") for c in POISSON1[1:]), (u > POISSON1[0]).cast("int"))


def cluster_bootstrap(df: DataFrame, group: Sequence[str], cluster: str, ratios: dict[str, tuple[str, str]], draws: int,
                      *, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Ratio estimates (sum num / sum den) with percentile intervals from resampled clusters.

    Rows are first summed to clusters; only the sums are repeated for the draws, and the draws are summed again before
    any shuffle.
    """
    names = sorted({c for pair in ratios.values() for c in pair})
    sums = df.groupBy(*group, cluster).agg(*[F.sum(c).alias(c) for c in names])
    drawn = sums.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn(
        "_w", F.when(F.col("_b") == 0, F.lit(1)).otherwise(draw_weight(F.col(cluster), F.col("_b"), seed)))
    per = drawn.groupBy(*group, "_b").agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in names])
    per = per.select(*group, "_b", *[F.try_divide(F.col(n), F.col(d)).alias(k) for k, (n, d) in ratios.items()])
    q = lambda k, a: F.percentile(F.when(F.col("_b") > 0, F.col(k)), F.lit(a))
    return per.groupBy(*group).agg(*[x for k in ratios for x in (
        F.max(F.when(F.col("_b") == 0, F.col(k))).alias(k), q(k, alpha / 2).alias(f"{k}_lo"), q(k, 1 - alpha / 2).alias(f"{k}_hi"))])


def max_t_band(df: DataFrame, cluster: str, models: Sequence[str], draws: int, *, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Simultaneous band over several means: quantile of the largest |draw - estimate| / sd on common draws."""
    sums = df.groupBy(cluster).agg(*[F.sum(m).alias(m) for m in models], F.count(F.lit(1)).alias("_n"))
    drawn = sums.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn(
        "_w", F.when(F.col("_b") == 0, F.lit(1)).otherwise(draw_weight(F.col(cluster), F.col("_b"), seed)))
    per = drawn.groupBy("_b").agg(*[(F.sum(F.col("_w") * F.col(m)) / F.sum(F.col("_w") * F.col("_n"))).alias(m) for m in models])
    est = per.agg(*[x for m in models for x in (F.max(F.when(F.col("_b") == 0, F.col(m))).alias(f"e_{m}"), F.stddev_samp(F.when(F.col("_b") > 0, F.col(m))).alias(f"s_{m}"))]).withColumn("_k", F.lit(1))
    z = per.filter(F.col("_b") > 0).withColumn("_k", F.lit(1)).join(est, "_k")
    worst = F.greatest(*[F.abs(F.col(m) - F.col(f"e_{m}")) / F.col(f"s_{m}") for m in models])
    return z.withColumn("_t", worst).agg(F.percentile("_t", F.lit(level)).alias("max_t"), *[
        x for m in models for x in (F.max(f"e_{m}").alias(f"mean_{m}"), F.max(f"s_{m}").alias(f"sd_{m}"))])


def block_bootstrap_mean(series: DataFrame, value: str, index: str, block: int, draws: int, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Circular moving-block bootstrap of a mean: a draw is a sum of block sums, each block chosen by a hash.

    ``index`` numbers the series 0..n-1.  A block sum is a difference of running sums, so a draw costs n / block lookups.
    """
    n = series.agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(1))
    wrapped = series.select(F.col(index).alias("i"), F.col(value).alias("x")).withColumn("_k", F.lit(1)).join(n, "_k")
    # each row belongs to the blocks starting at i, i-1, ..., i-block+1 (mod n)
    sums = wrapped.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda j: F.pmod(F.col("i") - j, F.col("n")))).alias("start"), "x").groupBy("start").agg(F.sum("x").alias("s"))
    picks = n.select("n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("b")).select(
        "n", "b", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))).alias("j"))
    big = 2147483648
    h = F.pmod(F.col("b").cast("long") * 40503 + F.col("j").cast("long") * 2654435 + seed * 97, F.lit(big))
    for _ in range(3):
        h = F.pmod(F.pmod(h * 1103515245 + 12345, F.lit(big)) + F.floor(h / 65536), F.lit(big))
    picks = picks.select("n", "b", F.floor(h / float(big) * F.col("n")).alias("start"))
    drawn = picks.join(sums, "start").groupBy("b").agg((F.sum("s") / (F.count(F.lit(1)) * block)).alias("m"))
    ci = drawn.agg(F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    est = series.agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return est.withColumn("_k", F.lit(1)).join(ci.withColumn("_k", F.lit(1)), "_k").select(
        "n", "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def breakeven(curve: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """First x where the curve falls to zero (linear between points); infinity when it never does."""
    w = Window.partitionBy(*group).orderBy(x)
    px, py, first = F.lag(x).over(w), F.lag(y).over(w), F.row_number().over(w) == 1
    cross = F.when(F.col(y) <= 0, F.when(first, F.col(x)).otherwise(px + (F.col(x) - px) * py / (py - F.col(y))))
    marked = curve.filter(F.col(y).isNotNull()).withColumn("_x", cross)
    return marked.groupBy(*group).agg(F.coalesce(F.min_by("_x", F.when(F.col("_x").isNotNull(), F.col(x))), F.lit(float("inf"))).alias("breakeven"))


def last_significant(curve: DataFrame, group: Sequence[str], x: str, lower: str) -> DataFrame:
    """Largest x of the leading run whose lower bound is above zero."""
    w = Window.partitionBy(*group).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    ok = curve.withColumn("_bad", F.max((F.coalesce(F.col(lower), F.lit(-1.0)) <= 0).cast("int")).over(w))
    return ok.groupBy(*group).agg(F.max(F.when(F.col("_bad") == 0, F.col(x))).alias("last_significant"))


def probabilistic_sharpe(df: DataFrame, group: Sequence[str], r: str, sr0: Column | float = 0.0) -> DataFrame:
    """Probability that the true per-period Sharpe exceeds sr0, with the sample skewness and kurtosis."""
    a = df.groupBy(*group).agg(F.count(r).alias("n"), (F.avg(r) / F.stddev_samp(r)).alias("sharpe"), F.skewness(r).alias("_g3"), (F.kurtosis(r) + 3).alias("_g4"))
    den = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("_g3") * F.col("sharpe") + (F.col("_g4") - 1) / 4 * F.col("sharpe") * F.col("sharpe")))
    return a.withColumn("psr", normal_cdf((F.col("sharpe") - as_col(sr0)) * F.sqrt(F.col("n") - 1) / den)).drop("_g3", "_g4")


def deflated_sharpe(trials: DataFrame, name: str, r: str) -> DataFrame:
    """PSR of the best trial against the maximum expected from as many trials without skill."""
    euler = 0.5772156649015329
    trials = ranks.materialise(trials.select(name, r))
    each = probabilistic_sharpe(trials, [name], r).select(name, "n", "sharpe")
    summary = each.agg(F.count(F.lit(1)).alias("n_trials"), F.stddev_samp("sharpe").alias("_sd"), F.max_by(name, "sharpe").alias("best"))
    n = F.col("n_trials")
    sr0 = F.col("_sd") * ((1 - euler) * normal_ppf(1 - 1 / n) + euler * normal_ppf(1 - 1 / (n * math.e)))
    summary = summary.withColumn("sr0", F.when(n >= 2, sr0).otherwise(0.0))
    best = trials.join(F.broadcast(summary), F.col(name) == F.col("best"))  # one summary row
    return probabilistic_sharpe(best, ["best", "n_trials", "sr0"], r, F.col("sr0")).select("best", "n_trials", "sr0", "sharpe", F.col("psr").alias("dsr"))


def mincer_zarnowitz(df: DataFrame, group: Sequence[str], y: str, x: str) -> DataFrame:
    """Intercept, slope, R2 and HC1-robust slope t of realised on forecast, from sums in two passes."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                                   F.regr_r2(y, x).alias("r2"), F.avg(x).alias("_mx"), F.regr_sxx(y, x).alias("_sxx"))
    j = rows.join(fit, list(group))
    d, e = F.col(x) - F.col("_mx"), F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)
    meat = j.groupBy(*group).agg(F.sum(d * d * e * e).alias("_meat"))
    var = F.col("_meat") / (F.col("_sxx") * F.col("_sxx")) * F.col("n") / (F.col("n") - 2)
    return fit.join(meat, list(group)).select(*group, "n", "intercept", "slope", "r2", (F.col("slope") / F.sqrt(var)).alias("slope_t"))


def partial_spearman(df: DataFrame, group: Sequence[str], x: str, y: str, control: str) -> DataFrame:
    """Rank correlation of x and y with the ranks of one control removed."""
    rows = ranks.materialise(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(control).isNotNull()))
    rows = ranks.rank_columns(rows, group, {x: "_a", y: "_b", control: "_c"})
    g = rows.groupBy(*group).agg(safe_corr("_a", "_b").alias("ab"), safe_corr("_a", "_c").alias("ac"), safe_corr("_b", "_c").alias("bc"), F.count(F.lit(1)).alias("n"))
    den = F.sqrt((1 - F.col("ac") * F.col("ac")) * (1 - F.col("bc") * F.col("bc")))
    return g.select(*group, "n", F.try_divide(F.col("ab") - F.col("ac") * F.col("bc"), den).alias("partial_ic"))


def rank_persistence(df: DataFrame, entity: str, period: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Rank correlation of an entity's value with its value k periods later."""
    later = df.select(entity, F.col(period).alias("_p2"), F.col(value).alias("_v2"))
    shifted = df.withColumn("k", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn("_p2", F.col(period) + F.col("k"))
    pairs = shifted.join(later, [entity, "_p2"])
    ic = spearman(pairs, ["k", period], value, "_v2").filter(F.col("n") >= 3)
    return ic.groupBy("k").agg(F.count("ic").alias("n_periods"), F.avg("ic").alias("ic_mean"), F.sum("n").alias("n_pairs"))


