"""Probability scores, calibration, rank correlation, HAC tests, bootstraps and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog import views as v
from tapeloom.catalog.registry import Query
from tapeloom.functions import prob
from tapeloom.functions.numeric import logit, normal_cdf, normal_ppf
from tapeloom.operators import ranks, stats, quantile
from tapeloom.plans import scores, targets
from tapeloom.plans.indicators import compute_indicators

R = v.rsql
Q: dict[str, Query] = {}


def q(name, sql=None):
    def deco(fn):
        Q[name] = Query(fn, sql)
        return fn
    return deco


P = v.base(v.PRED_SQL)
# normal distribution function as a power series, an independent form for the oracle
PHI = lambda x: f"(0.5 + list_sum(list_transform(range(0, 90), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * n + 1) * ln(greatest(abs({x}), 1e-300)) - n * ln(2.0) - lgamma(n + 1) - ln(2.0 * n + 1)))) / sqrt(2 * pi()) * sign({x}))"

# -- feature / target long table --------------------------------------------------------------------------------------------

LONG_SQL = """ft AS (SELECT symbol, t, ln(close) - lag(ln(close)) OVER w AS ret_1, ln(close) - lag(ln(close), 5) OVER w AS ret_5,
  CASE WHEN high = low THEN 0.0 ELSE ((close - low) - (high - close)) / (high - low) END AS clv,
  CASE WHEN lead(t, 1) OVER w - t = 3600 THEN ln(lead(close, 1) OVER w / close) END AS fwd_1, CASE WHEN lead(t, 5) OVER w - t = 18000 THEN ln(lead(close, 5) OVER w / close) END AS fwd_5
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)),
lg AS (SELECT symbol, t, indicator, horizon, x, ret, CASE WHEN ret > 0 THEN 1 WHEN ret < 0 THEN 0 END AS dir FROM (
  SELECT symbol, t, i.indicator, h.horizon, CASE i.indicator WHEN 'ret_1' THEN ret_1 WHEN 'ret_5' THEN ret_5 ELSE clv END AS x, CASE h.horizon WHEN 1 THEN fwd_1 ELSE fwd_5 END AS ret
  FROM ft, (SELECT unnest(['ret_1', 'ret_5', 'clv']) AS indicator) i, (SELECT unnest([1, 5]) AS horizon) h) WHERE x IS NOT NULL AND ret IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY symbol, indicator, horizon ORDER BY x) + (count(*) OVER (PARTITION BY symbol, indicator, horizon, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY symbol, indicator, horizon ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, indicator, horizon, ret) - 1) / 2.0 AS ry FROM lg)"""
L = v.base(LONG_SQL)


def long(spark, d):
    b = compute_indicators(v.bars(spark, d), ["ret_1", "ret_5", "clv"], keep_rows=True)
    return scores.long_scores_input(targets.make_targets(b, [1, 5], bar_s=3600), ["ret_1", "ret_5", "clv"], [1, 5])


G = ["symbol", "indicator", "horizon"]


@q("P01_spearman_ic", L + f"SELECT symbol, indicator, horizon, count(*) AS n, {R('corr(rx, ry)', 'ic')} FROM rk GROUP BY 1, 2, 3")
def _(spark, d):
    return v.r6(stats.spearman(long(spark, d), G, "x", "ret"), *G, "n", ic=None)


DAILY = """, dd AS (SELECT *, t // 86400 AS day, t // 2592000 AS month FROM lg),
dr AS (SELECT *, rank() OVER (PARTITION BY symbol, indicator, horizon, month, day ORDER BY x) + (count(*) OVER (PARTITION BY symbol, indicator, horizon, month, day, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY symbol, indicator, horizon, month, day ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, indicator, horizon, month, day, ret) - 1) / 2.0 AS ry FROM dd),
dic AS (SELECT symbol, indicator, horizon, month, day, corr(rx, ry) AS ic FROM dr GROUP BY ALL HAVING count(*) >= 10 AND isfinite(corr(rx, ry))),
gic AS (SELECT symbol, indicator, horizon, corr(rx, ry) AS ic FROM rk GROUP BY 1, 2, 3),
mo AS (SELECT symbol, indicator, horizon, avg((sign(m) = sign(g.ic))::INT) AS fr FROM (SELECT symbol, indicator, horizon, month, avg(ic) AS m FROM dic GROUP BY ALL) JOIN gic g USING (symbol, indicator, horizon) GROUP BY ALL)"""


@q("P02_daily_ic", L + DAILY + f"SELECT symbol, indicator, horizon, count(*) AS n_days, {R('avg(ic)', 'ic_daily_mean')}, {R('avg(ic) / (stddev_samp(ic) / sqrt(count(*)))', 'ic_daily_t')}, {R('any_value(fr)', 'frac_months_same_sign')} FROM dic JOIN mo USING (symbol, indicator, horizon) GROUP BY 1, 2, 3")
def _(spark, d):
    x = long(spark, d).withColumn("day", F.floor(F.col("t") / 86400)).withColumn("month", F.floor(F.col("t") / 2592000))
    return v.r6(stats.daily_ic(x, G, "day", "month", "x", "ret", least=10), *G, "n_days", ic_daily_mean=None, ic_daily_t=None, frac_months_same_sign=None)


@q("P03_auc", P + f"""SELECT symbol, {R('(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))', 'auc')}, {R('count(*) FILTER (y = 1)', 'n_pos')} FROM (
SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0 AS r FROM pred) GROUP BY 1""")
def _(spark, d):
    return v.r6(ranks.auc(v.predictions(spark, d), ["symbol"], "p", "y"), "symbol", auc=None, n_pos=None)


@q("P03_weighted_auc", P + f"""SELECT {R('sum(w * (below + neg / 2.0)) / (sum(w) * any_value(nn))', 'auc')} FROM (SELECT p, sum(abs(ret)) FILTER (y = 1) AS w, coalesce(sum(abs(ret)) FILTER (y = 0), 0) AS neg,
 coalesce(sum(coalesce(sum(abs(ret)) FILTER (y = 0), 0)) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, (SELECT sum(abs(ret)) FROM pred WHERE y = 0) AS nn FROM pred GROUP BY p)""")
def _(spark, d):
    return v.r6(ranks.auc(v.predictions(spark, d), [], "p", "y", weight=F.abs("ret")), auc=None)


def nw_sql(n="n"):
    return " + ".join([f"g0"] + [f"2 * (1 - {k} / 6.0) * g{k}" for k in range(1, 6)])


@q("P04_newey_west", L + f""", s AS (SELECT *, (rx - avg(rx) OVER g) / stddev_pop(rx) OVER g AS zx, (ry - avg(ry) OVER g) / stddev_pop(ry) OVER g AS zy FROM rk WINDOW g AS (PARTITION BY symbol, indicator, horizon)),
b AS (SELECT symbol, indicator, horizon, sum(zx * zy) / sum(zx * zx) AS beta, sum(zx * zx) AS sxx FROM s GROUP BY 1, 2, 3), e AS (SELECT s.*, beta, sxx, zx * (zy - beta * zx) AS e FROM s JOIN b USING (symbol, indicator, horizon)),
g AS (SELECT symbol, indicator, horizon, any_value(beta) AS beta, any_value(sxx) AS sxx, sum(e * e) AS g0, {', '.join(f'sum(e * e{k}) AS g{k}' for k in range(1, 6))} FROM (SELECT *, {', '.join(f'lag(e, {k}) OVER w AS e{k}' for k in range(1, 6))} FROM e WINDOW w AS (PARTITION BY symbol, indicator, horizon ORDER BY t)) GROUP BY 1, 2, 3)
SELECT symbol, indicator, horizon, {R('beta', 'slope')}, {R(f'beta / sqrt(({nw_sql()}) / (sxx * sxx))', 'nw_t')} FROM g""")
def _(spark, d):
    z = stats.standardised_ranks(long(spark, d), G, "x", "ret")
    return v.r6(stats.newey_west_slope(z, G, "t", "zx", "zy", 5), *G, slope=None, nw_t=None)


@q("P06_diebold_mariano", P + f""", x AS (SELECT symbol, t, (p - y) ** 2 - (p2 - y) ** 2 AS v FROM pred), e AS (SELECT *, v - avg(v) OVER (PARTITION BY symbol) AS e FROM x),
g AS (SELECT symbol, count(*) AS n, avg(v) AS mean, sum(e * e) AS g0, {', '.join(f'sum(e * e{k}) AS g{k}' for k in range(1, 6))} FROM (SELECT *, {', '.join(f'lag(e, {k}) OVER w AS e{k}' for k in range(1, 6))} FROM e WINDOW w AS (PARTITION BY symbol ORDER BY t)) GROUP BY 1)
SELECT symbol, n, {R('mean')}, {R(f'mean / sqrt(({nw_sql()}) / n / n)', 'dm_t')} FROM g""")
def _(spark, d):
    x = v.predictions(spark, d).withColumn("v", prob.brier(F.col("p"), F.col("y")) - prob.brier(F.col("p2"), F.col("y")))
    return v.r6(stats.newey_west_mean(x, ["symbol"], "t", "v", 5, out="dm_t"), "symbol", "n", mean=None, dm_t=None)


@q("P05_pesaran_timmermann", P + f""", a AS (SELECT symbol, count(*) AS n, avg((y = (p >= 0.5)::INT)::INT) AS hit, avg(y) AS py, avg((p >= 0.5)::INT) AS px FROM pred GROUP BY 1),
b AS (SELECT *, py * px + (1 - py) * (1 - px) AS s FROM a)
SELECT symbol, n, {R('hit')}, {R('(hit - s) / sqrt(s * (1 - s) / n - ((2 * py - 1) ** 2 * px * (1 - px) / n + (2 * px - 1) ** 2 * py * (1 - py) / n + 4 * py * px * (1 - py) * (1 - px) / n / n))', 'pt')} FROM b""")
def _(spark, d):
    x = v.predictions(spark, d).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    return v.r6(stats.pesaran_timmermann(x, ["symbol"], "y", "pred"), "symbol", "n", hit=None, pt=None)


@q("P07_false_discovery", L + f""", tt AS (SELECT symbol, indicator, horizon, 1 - abs(corr(rx, ry)) AS pv FROM rk GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (ORDER BY pv) AS i, count(*) OVER () AS m FROM tt),
h AS (SELECT *, pv * m / i AS raw, sum(1.0 / i) OVER () AS hm FROM r)
SELECT symbol, indicator, horizon, {R('least(1, min(raw) OVER w)', 'q_value')}, {R('least(1, hm * min(raw) OVER w)', 'q_value_by')} FROM h WINDOW w AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def _(spark, d):
    t = stats.spearman(long(spark, d), G, "x", "ret").withColumn("pv", 1 - F.abs("ic"))
    return v.r6(stats.false_discovery(t, "pv"), *G, q_value=None, q_value_by=None)


@q("D26_aggregate_scores", L + f""", sc AS (SELECT symbol, indicator, horizon, corr(rx, ry) AS ic, corr(rx, ry) * sqrt(count(*)) AS t FROM rk GROUP BY 1, 2, 3), m AS (SELECT indicator, horizon, avg(ic) AS m FROM sc GROUP BY 1, 2)
SELECT indicator, horizon, count(ic) AS n_tickers, {R('avg(ic)', 'ic_mean')}, {R('stddev_samp(ic)', 'ic_std')}, {R('avg((sign(ic) = sign(m))::INT)', 'frac_same_sign')}, {R('sum(t) / sqrt(count(t))', 'z_combined')}, {R('avg(ic) / (stddev_samp(ic) / sqrt(count(ic)))', 'ic_t_cross')} FROM sc JOIN m USING (indicator, horizon) GROUP BY 1, 2""")
def _(spark, d):
    s = stats.spearman(long(spark, d), G, "x", "ret").withColumn("t", F.col("ic") * F.sqrt("n"))
    return v.r6(stats.aggregate_scores(s), "indicator", "horizon", "n_tickers", ic_mean=None, ic_std=None, frac_same_sign=None, z_combined=None, ic_t_cross=None)


@q("P08_partial_spearman", L + f""", w AS (SELECT symbol, t, any_value(ret) AS y, max(x) FILTER (indicator = 'ret_1') AS a, max(x) FILTER (indicator = 'clv') AS c FROM lg WHERE horizon = 1 GROUP BY 1, 2),
k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY a) + (count(*) OVER (PARTITION BY symbol, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2.0 AS ry,
 rank() OVER (PARTITION BY symbol ORDER BY c) + (count(*) OVER (PARTITION BY symbol, c) - 1) / 2.0 AS rc FROM w WHERE a IS NOT NULL AND y IS NOT NULL AND c IS NOT NULL), m AS (SELECT symbol, count(*) AS n, corr(ra, ry) AS ab, corr(ra, rc) AS ac, corr(ry, rc) AS bc FROM k GROUP BY 1)
SELECT symbol, n, {R('(ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc))', 'partial_ic')} FROM m""")
def _(spark, d):
    x = long(spark, d).filter(F.col("horizon") == 1)
    at = lambda i: F.max(F.when(F.col("indicator") == i, F.col("x")))
    w = x.groupBy("symbol", "t").agg(F.max("ret").alias("y"), at("ret_1").alias("a"), at("clv").alias("c"))
    return v.r6(stats.partial_spearman(w, ["symbol"], "a", "y", "c"), "symbol", "n", partial_ic=None)


@q("P01_indicator_scores")
def _(spark, d):
    return v.r6(scores.indicator_scores(long(spark, d)), *G, "n_days", "n_oos", ic_spearman=None, ic_nw_t=None, ic_daily_mean=None, ic_daily_t=None,
                ic_train=None, ic_test=None, hit_rate_oos=None, auc_oos=None, p_hit=None)


# -- probability scores ---------------------------------------------------------------------------------------------------------

AUC_SQL = "(SELECT symbol, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0 AS r FROM pred) GROUP BY 1)"
LL = "-(y * ln(least(greatest(p, 0.000001), 0.999999)) + (1 - y) * ln(1 - least(greatest(p, 0.000001), 0.999999)))"


@q("D18_prob_metrics", P + f"""SELECT symbol, count(*) AS n, {R('avg(((p >= 0.5) = (y = 1))::INT)', 'accuracy')}, {R('(avg((p >= 0.5)::INT) FILTER (y = 1) + avg((p < 0.5)::INT) FILTER (y = 0)) / 2', 'balanced_accuracy')}, {R('avg((p - y) ** 2)', 'brier')}, {R(f'avg({LL})', 'logloss')}, {R('avg(y)', 'base_rate')},
 {R('1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y)))', 'brier_skill')}, {R('any_value(auc)', 'auc')} FROM pred JOIN {AUC_SQL} USING (symbol) GROUP BY 1""")
def _(spark, d):
    return v.r6(stats.prob_metrics(v.predictions(spark, d), ["symbol"], "y", "p"), "symbol", "n", accuracy=None, balanced_accuracy=None, brier=None, logloss=None, base_rate=None, brier_skill=None, auc=None)


WIL = lambda k, n, s: f"(({k})/({n}) + 1.959963984540054*1.959963984540054/(2*({n})) {s} 1.959963984540054*sqrt(({k})/({n})*(1-({k})/({n}))/({n}) + 1.959963984540054*1.959963984540054/(4*({n})*({n})))) / (1 + 1.959963984540054*1.959963984540054/({n}))"


@q("D20_fixed_bin_calibration", P + f"SELECT symbol, least(floor(p * 10), 9)::INT AS bin, count(*) AS n, {R('avg(p)', 'p_mean')}, {R('avg(y)', 'up_rate')}, {R(WIL('sum(y)::DOUBLE', 'count(*)', '-'), 'lo')}, {R(WIL('sum(y)::DOUBLE', 'count(*)', '+'), 'hi')} FROM pred GROUP BY 1, 2")
def _(spark, d):
    return v.r6(stats.calibration(v.predictions(spark, d), ["symbol"], "y", "p"), "symbol", "bin", "n", p_mean=None, up_rate=None, lo=None, hi=None)


@q("D19_quantile_calibration", P + f""", e AS (SELECT symbol, list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS ed FROM pred GROUP BY 1),
b AS (SELECT pred.*, ed, least(greatest(len(list_filter(ed, lambda z: z <= p)) - 1, 0), len(ed) - 2) AS bin FROM pred JOIN e USING (symbol))
SELECT symbol, bin::INT AS bin, count(*) AS n, {R('avg(p)', 'p_mean')}, {R('avg(y)', 'up_rate')}, {R('min(ed[bin + 1])', 'p_lo')}, {R('min(ed[bin + 2])', 'p_hi')} FROM b GROUP BY 1, 2""")
def _(spark, d):
    return v.r6(stats.quantile_calibration(v.predictions(spark, d), ["symbol"], "y", "p"), "symbol", "bin", "n", p_mean=None, up_rate=None, p_lo=None, p_hi=None)


@q("D21_tail_check", P + f"SELECT symbol, count(*) FILTER (p <= 0.2 OR p >= 0.8) AS n_tail, {R('sum(CASE WHEN p <= 0.2 THEN p WHEN p >= 0.8 THEN 1 - p ELSE 0 END)', 'expected')}, {R('sum(CASE WHEN p <= 0.2 THEN y WHEN p >= 0.8 THEN 1 - y ELSE 0 END)', 'observed')} FROM pred GROUP BY 1")
def _(spark, d):
    return v.r6(stats.tail_check(v.predictions(spark, d), ["symbol"], "y", "p", 0.2), "symbol", "n_tail", expected=None, observed=None)


@q("D15_grouping_cells", P + f"""SELECT coalesce(symbol, 'all') AS symbol, coalesce(half, 'all') AS half, count(*) AS n, {R('avg((p - y) ** 2)', 'brier')} FROM (SELECT *, CASE WHEN t % 86400 < 43200 THEN 'am' ELSE 'pm' END AS half FROM pred) GROUP BY GROUPING SETS ((symbol, half), (half), ())""")
def _(spark, d):
    from tapeloom.operators.cells import grouping_cells
    x = v.predictions(spark, d).withColumn("half", F.when(F.col("t") % 86400 < 43200, "am").otherwise("pm"))
    out = grouping_cells(x, [["symbol", "half"], ["half"], []], [F.count(F.lit(1)).alias("n"), F.avg(prob.brier(F.col("p"), F.col("y"))).alias("brier")])
    return v.r6(out, "symbol", "half", "n", brier=None)


@q("D16_base_rates", v.base(v.MARKETS_SQL) + f"SELECT symbol, count(*) AS n, {R('avg(up::INT)', 'up_share')}, count(*) FILTER (k = f) AS n_ties, {R(WIL('sum(up::INT)::DOUBLE', 'count(*)', '-'), 'lo')}, {R(WIL('sum(up::INT)::DOUBLE', 'count(*)', '+'), 'hi')}, {R('median(trades)', 'trades_p50')} FROM mk GROUP BY 1")
def _(spark, d):
    m = v.markets(spark, d)
    lo, hi = prob.wilson(F.col("_k"), F.col("n"))
    g = m.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("up").cast("double")).alias("_k"), F.count(F.when(F.col("k") == F.col("f"), 1)).alias("n_ties"), F.percentile("trades", F.lit(0.5)).alias("trades_p50"))
    return v.r6(g.withColumn("lo", lo).withColumn("hi", hi), "symbol", "n", "n_ties", up_share=F.col("_k") / F.col("n"), lo=None, hi=None, trades_p50=None)


@q("D12_quantile_summary", v.base() + f"SELECT symbol, count(*) AS n, {', '.join(R(f'quantile_cont(gap, {x})', n) for x, n in ((0.01, 'p01'), (0.1, 'p10'), (0.5, 'p50'), (0.9, 'p90'), (0.99, 'p99')))} FROM (SELECT symbol, (us - lag(us) OVER (PARTITION BY symbol ORDER BY us)) / 1000000.0 AS gap FROM ticks) WHERE gap IS NOT NULL GROUP BY 1")
def _(spark, d):
    from tapeloom.operators import tiling
    tiled = tiling.tile(v.ticks(spark, d), ["symbol"], "ts", behind=1, tie=["seq"])
    us = F.unix_micros("ts")
    gaps = tiling.untile(tiled.withColumn("gap", (us - F.lag(us).over(tiling.tile_window(["symbol"]))) / 1000000))
    g = quantile.exact_quantiles(gaps, ["symbol"], "gap", (0.01, 0.1, 0.5, 0.9, 0.99), "p")
    return v.r6(g, "symbol", "n", **{n: F.col("p")[i] for i, n in enumerate(("p01", "p10", "p50", "p90", "p99"))})


@q("D13_censored_quantiles", P + f"SELECT symbol, {R('CASE WHEN isfinite(quantile_disc(z, 0.5)) THEN quantile_disc(z, 0.5) END', 'p50')}, {R('avg((NOT isfinite(z))::INT)', 'share_censored')} FROM (SELECT symbol, CASE WHEN y = 1 THEN abs(ret) ELSE 'infinity'::DOUBLE END AS z FROM pred) GROUP BY 1")
def _(spark, d):
    z = F.when(F.col("y") == 1, F.abs("ret")).otherwise(F.lit(float("inf")))
    g = v.predictions(spark, d).withColumn("z", z).groupBy("symbol").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY z)").alias("q"), F.avg((F.col("z") == float("inf")).cast("double")).alias("share_censored"))
    return v.r6(g, "symbol", p50=F.when(F.col("q") < float("inf"), F.col("q")), share_censored=None)


@q("D39_pivot_wide", P + f"SELECT day, {', '.join(R(f'''avg(p) FILTER (symbol = '{s}')''', s) for s in ('click', 'error', 'purchase', 'signup', 'view'))} FROM pred GROUP BY 1")
def _(spark, d):
    names = ["click", "error", "purchase", "signup", "view"]
    w = v.predictions(spark, d).groupBy("day").pivot("symbol", names).agg(F.avg("p"))
    return v.r6(w, "day", **{n: None for n in names})


@q("P11_cluster_mean_ci", P + f""", m AS (SELECT symbol, avg(x) AS mean, count(*) AS n FROM (SELECT symbol, (p - y) ** 2 AS x FROM pred) GROUP BY 1), s AS (SELECT symbol, day, sum((p - y) ** 2 - mean) AS dv FROM pred JOIN m USING (symbol) GROUP BY 1, 2)
SELECT symbol, {R('any_value(mean)', 'mean')}, {R('any_value(mean) - 1.96 * sqrt(sum(dv * dv)) / any_value(n)', 'lo')}, {R('any_value(mean) + 1.96 * sqrt(sum(dv * dv)) / any_value(n)', 'hi')} FROM s JOIN m USING (symbol) GROUP BY 1""")
def _(spark, d):
    x = v.predictions(spark, d).withColumn("x", prob.brier(F.col("p"), F.col("y")))
    return v.r6(stats.cluster_mean(x, ["symbol"], "day", "x"), "symbol", mean=None, lo=None, hi=None)


def _weight_ctes(src: str) -> str:
    """Stages of the draw weight, each referring to the one before."""
    out, prev = [], src
    for i in range(3):
        out.append(f"h{i + 1} AS (SELECT * EXCLUDE (h), (((h * 1103515245 + 12345) % 2147483648) + (h // 65536)) % 2147483648 AS h FROM {prev})")
        prev = f"h{i + 1}"
    cuts = " + ".join(f"(h / 2147483648.0 > {c!r})::INT" for c in stats.POISSON1)
    out.append(f"wt AS (SELECT *, CASE WHEN b = 0 THEN 1 ELSE {cuts} END AS w FROM {prev})")
    return ", ".join(out)


BOOT = P + """, s AS (SELECT symbol, day, sum((p - y) ** 2) AS num, sum((p2 - y) ** 2) AS num2, count(*) AS den FROM pred GROUP BY 1, 2),
h0 AS (SELECT s.*, b.b, (day * 40503 + b.b * 2654435) % 2147483648 AS h FROM s, (SELECT unnest(range(0, 201)) AS b) b), """ + _weight_ctes("h0")


@q("P09_cluster_bootstrap", BOOT + f""", r AS (SELECT symbol, b, sum(w * num) / nullif(sum(w * den), 0) AS brier, sum(w * (num - num2)) / nullif(sum(w * den), 0) AS gain FROM wt GROUP BY 1, 2)
SELECT symbol, {', '.join(x for k in ('brier', 'gain') for x in (R(f'max({k}) FILTER (b = 0)', k), R(f'quantile_cont({k}, 0.025) FILTER (b > 0)', k + '_lo'), R(f'quantile_cont({k}, 0.975) FILTER (b > 0)', k + '_hi')))} FROM r GROUP BY 1""")
def _(spark, d):
    one, two = prob.brier(F.col("p"), F.col("y")), prob.brier(F.col("p2"), F.col("y"))
    x = v.predictions(spark, d).withColumns({"num": one, "diff": one - two, "den": F.lit(1.0)})
    out = stats.cluster_bootstrap(x, ["symbol"], "day", {"brier": ("num", "den"), "gain": ("diff", "den")}, 200)
    return v.r6(out, "symbol", brier=None, brier_lo=None, brier_hi=None, gain=None, gain_lo=None, gain_hi=None)


@q("P12_max_t_band", BOOT.replace("GROUP BY 1, 2),\nh0", "GROUP BY 1, 2),\nh0").replace("SELECT symbol, day, sum((p - y) ** 2) AS num", "SELECT 'all' AS symbol, day, sum((p - y) ** 2) AS num") + f""", r AS (SELECT b, sum(w * num) / sum(w * den) AS m1, sum(w * num2) / sum(w * den) AS m2 FROM wt GROUP BY 1), e AS (SELECT max(m1) FILTER (b = 0) AS e1, max(m2) FILTER (b = 0) AS e2, stddev_samp(m1) FILTER (b > 0) AS s1, stddev_samp(m2) FILTER (b > 0) AS s2 FROM r)
SELECT {R('quantile_cont(greatest(abs(m1 - e1) / s1, abs(m2 - e2) / s2), 0.95)', 'max_t')}, {R('any_value(e1)', 'mean_a')}, {R('any_value(s1)', 'sd_a')}, {R('any_value(e2)', 'mean_b')}, {R('any_value(s2)', 'sd_b')} FROM r, e WHERE b > 0""")
def _(spark, d):
    x = v.predictions(spark, d).withColumns({"a": prob.brier(F.col("p"), F.col("y")), "b": prob.brier(F.col("p2"), F.col("y"))})
    return v.r6(stats.max_t_band(x.select("day", "a", "b"), "day", ["a", "b"], 200), max_t=None, mean_a=None, sd_a=None, mean_b=None, sd_b=None)


@q("P10_block_bootstrap", P + f""", sr AS (SELECT row_number() OVER (ORDER BY symbol, t) - 1 AS i, ret AS x, count(*) OVER () AS n FROM pred), h0 AS (SELECT b, j, n, (b * 40503 + j * 2654435) % 2147483648 AS h FROM (SELECT unnest(range(1, 201)) AS b) b, (SELECT unnest(range(0, (SELECT max((n - 1) // 30) FROM sr) + 1)) AS j) j, (SELECT max(n) AS n FROM sr) n), {_weight_ctes("h0")},
st AS (SELECT b, j, n, floor(h / 2147483648.0 * n)::BIGINT AS s FROM h3), dr AS (SELECT b, sum(x) / (count(DISTINCT j) * 30) AS m FROM st, (SELECT unnest(range(0, 30)) AS o) o JOIN sr ON sr.i = (s + o) % st.n GROUP BY 1)
SELECT {R('quantile_cont(m, 0.025)', 'lo')}, {R('quantile_cont(m, 0.975)', 'hi')}, (SELECT {R('avg(x)', 'mean')} FROM sr) AS mean, (SELECT count(*) FROM sr) AS n FROM dr""")
def _(spark, d):
    from tapeloom.operators import tiling
    # one series of all symbols in turn: the row number is the symbol offset plus the row inside the symbol
    p = tiling.number_rows(v.predictions(spark, d).select("symbol", "t", "ret"), ["symbol"], "t")
    from pyspark.sql import Window
    sizes = p.groupBy("symbol").agg(F.max(tiling.TOTAL).alias("_k"))
    off = sizes.select("symbol", F.coalesce(F.sum("_k").over(Window.partitionBy(F.lit(1)).orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    s = p.join(off, "symbol").select((F.col("_off") + F.col(tiling.ROW)).alias("i"), "ret")
    return v.r6(stats.block_bootstrap_mean(s, "ret", "i", 30, 200), "n", mean=None, lo=None, hi=None)


@q("P13_sharpe_family", P + f""", a AS (SELECT symbol, count(*) AS n, avg(r) / stddev_samp(r) AS sr, avg((r - m) ** 3) / pow(var_pop(r), 1.5) AS g3, avg((r - m) ** 4) / pow(var_pop(r), 2) AS g4 FROM (SELECT symbol, CASE WHEN p >= 0.5 THEN ret ELSE -ret END AS r, avg(CASE WHEN p >= 0.5 THEN ret ELSE -ret END) OVER (PARTITION BY symbol) AS m FROM pred) GROUP BY 1)
SELECT symbol, n, {R('sr', 'sharpe')}, {R(PHI('z'), 'psr')} FROM (SELECT *, least(sr * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - g3 * sr + (g4 - 1) / 4 * sr * sr)), 6) AS z FROM a)""")
def _(spark, d):
    x = v.predictions(spark, d).withColumn("r", F.when(F.col("p") >= 0.5, F.col("ret")).otherwise(-F.col("ret")))
    return v.r6(stats.probabilistic_sharpe(x, ["symbol"], "r"), "symbol", "n", sharpe=None, psr=None)


@q("P13_deflated_sharpe")
def _(spark, d):
    x = v.predictions(spark, d).withColumn("r", F.when(F.col("p") >= 0.5, F.col("ret")).otherwise(-F.col("ret")))
    return v.r6(stats.deflated_sharpe(x, "symbol", "r"), "best", "n_trials", sr0=None, sharpe=None, dsr=None)


@q("P14_mincer_zarnowitz", P + f""", f AS (SELECT symbol, count(*) AS n, regr_slope(y, p) AS b, regr_intercept(y, p) AS a, regr_r2(y, p) AS r2, avg(p) AS mp, regr_sxx(y, p) AS sxx FROM pred GROUP BY 1)
SELECT symbol, any_value(n) AS n, {R('any_value(a)', 'intercept')}, {R('any_value(b)', 'slope')}, {R('any_value(r2)', 'r2')}, {R('any_value(b) / sqrt(sum((p - mp) ** 2 * (y - a - b * p) ** 2) / pow(any_value(sxx), 2) * any_value(n) / (any_value(n) - 2))', 'slope_t')} FROM pred JOIN f USING (symbol) GROUP BY 1""")
def _(spark, d):
    x = v.predictions(spark, d).withColumn("y", F.col("y").cast("double"))
    return v.r6(stats.mincer_zarnowitz(x, ["symbol"], "y", "p"), "symbol", "n", intercept=None, slope=None, r2=None, slope_t=None)


@q("P17_breakeven", P + f""", c AS (SELECT symbol, least(floor(p * 10), 9) AS x, avg(ret) - 0.2 * least(floor(p * 10), 9) + 1 AS y FROM pred GROUP BY 1, 2), k AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM c WINDOW w AS (PARTITION BY symbol ORDER BY x))
SELECT symbol, {R('arg_min(CASE WHEN px IS NULL THEN x ELSE px + (x - px) * py / (py - y) END, x) FILTER (y <= 0)', 'breakeven')}, {R('max(x) FILTER (ok)', 'last_significant')} FROM (SELECT *, bool_and(y > 0) OVER (PARTITION BY symbol ORDER BY x) AS ok FROM k) GROUP BY 1""")
def _(spark, d):
    c = v.predictions(spark, d).groupBy("symbol", F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("x")).agg(F.avg("ret").alias("m"))
    c = c.withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("m") - 0.2 * F.col("x") + 1)
    b = stats.breakeven(c, ["symbol"], "x", "y").join(stats.last_significant(c, ["symbol"], "x", "y"), "symbol")
    return v.r6(b, "symbol", breakeven=F.when(F.col("breakeven") < float("inf"), F.col("breakeven")), last_significant=None)


@q("P20_cross_sectional_ic", L + f""", c AS (SELECT indicator, horizon, t, x, ret FROM lg), k AS (SELECT *, rank() OVER (PARTITION BY indicator, horizon, t ORDER BY x) + (count(*) OVER (PARTITION BY indicator, horizon, t, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY indicator, horizon, t ORDER BY ret) + (count(*) OVER (PARTITION BY indicator, horizon, t, ret) - 1) / 2.0 AS ry FROM c),
i AS (SELECT indicator, horizon, t, corr(rx, ry) AS ic FROM k GROUP BY ALL HAVING count(*) >= 4)
SELECT indicator, horizon, count(*) AS n, {R('avg(ic)', 'mean')} FROM i WHERE isfinite(ic) GROUP BY 1, 2""")
def _(spark, d):
    g = ["indicator", "horizon", "t"]
    ic = stats.spearman(long(spark, d), g, "x", "ret").filter((F.col("n") >= 4) & F.col("ic").isNotNull())
    return v.r6(stats.newey_west_mean(ic, ["indicator", "horizon"], "t", "ic", 5), "indicator", "horizon", "n", mean=None)


@q("H02_sort_abs_nulls_last", L + f"SELECT indicator, horizon, symbol, {R('corr(rx, ry)', 'ic')} FROM rk GROUP BY ALL ORDER BY abs(corr(rx, ry)) DESC NULLS LAST LIMIT 10")
def _(spark, d):
    s = stats.spearman(long(spark, d), G, "x", "ret").orderBy(F.abs("ic").desc_nulls_last()).limit(10)
    return v.r6(s, "indicator", "horizon", "symbol", ic=None)


@q("H05_top_by_mean_ic", L + f"SELECT indicator, {R('avg(abs(ic))', 'score')} FROM (SELECT symbol, indicator, horizon, corr(rx, ry) AS ic FROM rk GROUP BY ALL) GROUP BY 1 HAVING count(ic) >= 5 ORDER BY avg(abs(ic)) DESC LIMIT 2")
def _(spark, d):
    s = stats.spearman(long(spark, d), G, "x", "ret").groupBy("indicator").agg(F.avg(F.abs("ic")).alias("score"), F.count("ic").alias("k"))
    return v.r6(s.filter(F.col("k") >= 5).orderBy(F.col("score").desc()).limit(2), "indicator", score=None)


@q("H07_choose_by_loss", P + f"""SELECT symbol, arg_min(k, (loss, k)) AS k, {R('min(loss)', 'loss')} FROM (SELECT symbol, k.k, avg((0.5 + (p - 0.5) * k.k / 10.0 - y) ** 2) AS loss FROM pred, (SELECT unnest([2, 5, 8, 10, 12]) AS k) k GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    from tapeloom.operators.cells import choose_by_loss
    ks = F.array(*[F.lit(k) for k in (2, 5, 8, 10, 12)])
    x = v.predictions(spark, d).withColumn("k", F.explode(ks))
    return v.r6(choose_by_loss(x, ["symbol"], "k", prob.brier(0.5 + (F.col("p") - 0.5) * F.col("k") / 10.0, F.col("y"))), "symbol", "k", loss=None)


@q("D27_family_summary", L + f"""SELECT family, count(*) AS n, {R('median(abs(ic))', 'ic_p50')}, {R('max(abs(ic))', 'ic_max')}, arg_max(indicator, abs(ic)) AS best FROM (SELECT CASE WHEN indicator = 'clv' THEN 'microstructure' ELSE 'momentum' END AS family, indicator, corr(rx, ry) AS ic FROM rk GROUP BY symbol, indicator, horizon) GROUP BY 1""")
def _(spark, d):
    from tapeloom.operators.cells import family_summary
    s = stats.spearman(long(spark, d), G, "x", "ret")
    return v.r6(family_summary(s, {"ret_1": "momentum", "ret_5": "momentum", "clv": "microstructure"}), "family", "n", "best", ic_p50=None, ic_max=None)


@q("W19_average_rank", v.with_(v.TICKS_SQL) + "SELECT symbol, seq, rank() OVER (PARTITION BY symbol ORDER BY price) + (count(*) OVER (PARTITION BY symbol, price) - 1) / 2.0::DOUBLE AS rk FROM ticks".replace("rank() OVER (PARTITION BY symbol ORDER BY price) +", "rank() OVER (PARTITION BY symbol ORDER BY price)::DOUBLE +"))
def _(spark, d):
    return ranks.average_rank(v.ticks(spark, d), ["symbol"], "price", "rk").select("symbol", "seq", "rk")


@q("W18_ordinal_rank", v.with_(v.TICKS_SQL) + "SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY price DESC, seq) AS rk FROM ticks")
def _(spark, d):
    return ranks.ordinal_rank(v.ticks(spark, d), ["symbol"], "price", ["seq"], "rk").select("symbol", "seq", "rk")


# -- scalar functions -----------------------------------------------------------------------------------------------------------



@q("F10_normal_cdf", v.with_(v.TICKS_SQL) + f"SELECT seq, {R(PHI('z'), 'cdf')} FROM (SELECT seq, (seq % 901 - 450) / 100.0 AS z FROM ticks)")
def _(spark, d):
    return v.r6(v.ticks(spark, d).withColumn("z", (F.col("seq") % 901 - 450) / 100.0), "seq", cdf=normal_cdf(F.col("z")))


@q("F10_normal_ppf", v.with_(v.TICKS_SQL) + f"SELECT seq, {R('z', 'round_trip')} FROM (SELECT seq, (seq % 901 - 450) / 100.0 AS z FROM ticks)")
def _(spark, d):
    z = (F.col("seq") % 901 - 450) / 100.0
    return v.r6(v.ticks(spark, d), "seq", round_trip=normal_ppf(normal_cdf(z)))




@q("F05_taker_fee", v.with_(v.TAPE_SQL) + f"SELECT tx, seq, {R('CASE WHEN p BETWEEN 0 AND 1 THEN round_even(size * 0.07::DOUBLE * (p * (1 - p)) * 100000, 0) / 100000 END', 'fee')}, {R('p + 0.07 * p * (1 - p)', 'breakeven')} FROM (SELECT *, price AS p FROM tape)")
def _(spark, d):
    return v.r6(v.tape(spark, d), "tx", "seq", fee=prob.taker_fee(F.col("price"), F.col("size")), breakeven=prob.taker_cost(F.col("price")))


@q("F07_choose_side", P + f"""SELECT symbol, t, {R('eu', 'ev_up')}, {R('ed', 'ev_down')}, CASE WHEN greatest(eu, ed) > 0.02 THEN CASE WHEN eu >= ed THEN 'up' ELSE 'down' END END AS side FROM (SELECT *, p - (0.52::DOUBLE + 0.07::DOUBLE * (0.52::DOUBLE * (1 - 0.52::DOUBLE))) AS eu, 1 - p - (0.5::DOUBLE + 0.07::DOUBLE * (0.5::DOUBLE * 0.5::DOUBLE)) AS ed FROM pred)""")
def _(spark, d):
    c = prob.choose_side(F.col("p"), F.lit(0.52), F.lit(0.50), 0.02)
    x = v.predictions(spark, d).withColumn("side", c["side"])
    return v.r6(x, "symbol", "t", "side", ev_up=c["ev_up"], ev_down=c["ev_down"])


@q("F22_variance_factor", v.with_(v.TICKS_SQL) + f"""SELECT seq, {R('CASE WHEN r <= -60 THEN 900 - 20 WHEN r <= 0 THEN 900 - 40 + (-r) - r * r / 60.0 + (-r) * r * r / 10800.0 WHEN r <= 840 THEN 900 - r - 40 ELSE (900 - r) ** 3 / 10800.0 END', 'factor')}, CASE WHEN r <= -60 THEN 1 WHEN r <= 0 THEN 2 WHEN r <= 840 THEN 3 ELSE 4 END AS phase FROM (SELECT seq, seq % 1000 - 100 AS r FROM ticks WHERE seq % 1000 <= 1000)""")
def _(spark, d):
    t, s, e = F.col("seq") % 1000 - 100, F.lit(0), F.lit(900)
    return v.r6(v.ticks(spark, d).withColumn("phase", prob.phase_of(t, s, e, 60)), "seq", "phase", factor=prob.variance_factor(t, s, e, 60))


@q("F23_fair_probability", v.base(v.MARKETS_SQL) + f"""SELECT symbol, s, {R(PHI('z'), 'p_up')} FROM (SELECT symbol, s, least(greatest(ln(f / k) / (0.05 * sqrt(600 - 40)), -4.5), 4.5) AS z FROM mk)""")
def _(spark, d):
    m = v.markets(spark, d)
    z = F.least(F.greatest(F.log(F.col("f") / F.col("k")) / (0.05 * F.sqrt(F.lit(560.0))), F.lit(-4.5)), F.lit(4.5))
    return v.r6(m, "symbol", "s", p_up=prob.fair_probability(z, F.lit(1.0), F.lit(1.0)))


@q("F30_wilson", P + f"SELECT symbol, day, {R(WIL('sum(y)::DOUBLE', 'count(*)', '-'), 'lo')}, {R(WIL('sum(y)::DOUBLE', 'count(*)', '+'), 'hi')} FROM pred GROUP BY 1, 2")
def _(spark, d):
    g = v.predictions(spark, d).groupBy("symbol", "day").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = prob.wilson(F.col("k"), F.col("n"))
    return v.r6(g, "symbol", "day", lo=lo, hi=hi)


@q("F31_binomial_tail", P + f"""SELECT symbol, day, {R('(SELECT least(1, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0)))) FROM (SELECT unnest(range(k, n + 1)) AS i))', 'p')} FROM (SELECT symbol, day, sum(y)::BIGINT AS k, count(*) AS n FROM pred GROUP BY 1, 2)""")
def _(spark, d):
    g = v.predictions(spark, d).groupBy("symbol", "day").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    return v.r6(g, "symbol", "day", p=stats.binomial_half_tail(F.col("k").cast("double"), F.col("n").cast("double")))


@q("F32_logit", P + f"SELECT symbol, t, {R('ln(p / (1 - p))', 'logit')} FROM (SELECT symbol, t, least(greatest(p, 0.000001), 0.999999) AS p FROM pred)")
def _(spark, d):
    return v.r6(v.predictions(spark, d), "symbol", "t", logit=logit(F.col("p")))


@q("F33_stouffer", P + f"SELECT symbol, {R('sum(z) / sqrt(count(z))', 'z')}, {R('sum(CASE WHEN sign(z) = sign(z2) THEN sign(z) * least(abs(z), abs(z2)) ELSE 0 END)', 'cons')} FROM (SELECT symbol, day, avg(p - 0.5) / 0.1 AS z, avg(ret) AS z2 FROM pred GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    g = v.predictions(spark, d).groupBy("symbol", "day").agg((F.avg(F.col("p") - 0.5) / 0.1).alias("z"), F.avg("ret").alias("z2"))
    out = g.groupBy("symbol").agg((F.sum("z") / F.sqrt(F.count("z"))).alias("zz"), F.sum(prob.conservative_t(F.col("z"), F.col("z2"))).alias("cons"))
    return v.r6(out, "symbol", z=F.col("zz"), cons=None)


@q("F34_pointwise_losses", P + f"SELECT symbol, {R('avg((p - y) ** 2)', 'brier')}, {R(f'avg({LL})', 'logloss')}, {R('avg(greatest(ret * ret, 1e-12) / greatest(p * p, 1e-12) - ln(greatest(ret * ret, 1e-12) / greatest(p * p, 1e-12)) - 1)', 'qlike')}, {R('avg(abs(abs(ret) - p))', 'mae')} FROM pred GROUP BY 1")
def _(spark, d):
    p, y, r = F.col("p"), F.col("y"), F.col("ret")
    g = v.predictions(spark, d).groupBy("symbol").agg(F.avg(prob.brier(p, y)).alias("brier"), F.avg(prob.log_loss(p, y)).alias("logloss"), F.avg(prob.qlike(p * p, r * r)).alias("qlike"), F.avg(F.abs(F.abs(r) - p)).alias("mae"))
    return v.r6(g, "symbol", brier=None, logloss=None, qlike=None, mae=None)


@q("F36_min_detectable", P + f"SELECT symbol, {R('0.5 + 0.5 * sqrt(6.182557232019488 / (count(*) + 6.182557232019488))', 'accuracy')} FROM pred GROUP BY 1")
def _(spark, d):
    g = v.predictions(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return v.r6(g, "symbol", accuracy=prob.min_detectable_accuracy(F.col("n")))


QUERIES = Q
