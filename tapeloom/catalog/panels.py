"""Daily-panel, quantile-forecast and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog import views as v
from tapeloom.catalog.registry import Query
from tapeloom.functions import prob, quantiles
from tapeloom.operators import panel, stats
from tapeloom.plans import models, targets
from tapeloom.plans.indicators import compute_indicators

R = v.rsql
Q: dict[str, Query] = {}


def q(name, sql=None):
    def deco(fn):
        Q[name] = Query(fn, sql)
        return fn
    return deco


DAILY_SQL = """daily AS (SELECT p_brand AS symbol, (epoch(l_shipdate)::BIGINT // 86400) AS day, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_extendedprice) AS qvol FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
nm AS (SELECT symbol, max(day) FILTER (qvol > 0) AS last FROM daily GROUP BY 1), en AS (SELECT min(day) AS a, max(day) AS z FROM daily),
pn AS (SELECT nm.symbol, g.day, nm.last, en.z AS fin, coalesce(qvol > 0, false) AS active, close, qvol FROM nm, en, (SELECT unnest(range((SELECT a FROM en), (SELECT z FROM en) + 1)) AS day) g LEFT JOIN daily USING (symbol, day))""".replace(
    "FROM nm, en, (SELECT unnest(range((SELECT a FROM en), (SELECT z FROM en) + 1)) AS day) g LEFT JOIN daily USING (symbol, day))",
    "FROM (SELECT nm.symbol, nm.last, unnest(range((SELECT a FROM en), (SELECT z FROM en) + 1)) AS day FROM nm) g JOIN nm USING (symbol) CROSS JOIN en LEFT JOIN daily ON daily.symbol = g.symbol AND daily.day = g.day)")
D = v.with_(DAILY_SQL)
RUN = "(PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING)"


def daily(spark, d):
    li = v.table(spark, d, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    pt = v.table(spark, d, "part").select("p_partkey", "p_brand")
    return li.join(pt, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_brand").alias("symbol"), F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400).alias("day")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_extendedprice").alias("qvol"))


def pan(spark, d):
    return panel.build_panel(daily(spark, d))


@q("B10_active_panel", D + f"SELECT symbol, day, active, {R('ln(close)', 'log_close')} FROM pn")
def _(spark, d):
    return v.r6(pan(spark, d), "symbol", "day", "active", log_close=F.log("close"))


@q("B11_delist_notice", D + "SELECT symbol, day, active AND last < fin AND sum(active::INT) OVER (PARTITION BY symbol ORDER BY day DESC ROWS UNBOUNDED PRECEDING) <= 5 AS notice FROM pn")
def _(spark, d):
    return panel.delist_notice(pan(spark, d), 5).select("symbol", "day", "notice")


@q("B09_eligibility", D + f""", e AS (SELECT *, CASE WHEN count(CASE WHEN active THEN qvol END) OVER f >= 15 THEN median(CASE WHEN active THEN qvol END) OVER f END AS med, sum(active::INT) OVER {RUN} AS age,
 active AND last < fin AND sum(active::INT) OVER (PARTITION BY symbol ORDER BY day DESC ROWS UNBOUNDED PRECEDING) <= 5 AS notice FROM pn WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT symbol, day, coalesce(active AND age >= 60 AND med >= 50000 AND NOT notice, false) AS eligible FROM e""")
def _(spark, d):
    return panel.eligibility(pan(spark, d), age=60, volume=50000).select("symbol", "day", "eligible")


@q("B12_community_flag", D + f""", a AS (SELECT *, max(close) OVER {RUN} AS pk FROM pn), b AS (SELECT *, min(CASE WHEN close <= 0.3 * pk THEN day END) OVER {RUN} AS cr FROM a), c AS (SELECT *, min(CASE WHEN day >= cr THEN close END) OVER {RUN} AS tr FROM b)
SELECT symbol, day, bool_or(coalesce(close >= 2 * tr AND day >= cr, false)) OVER {RUN} AS community FROM c""".replace("0.3 * pk", "(1 - 0.7::DOUBLE) * pk"))
def _(spark, d):
    return panel.community_flag(pan(spark, d)).select("symbol", "day", "community")


@q("W24_range_position", D + f"SELECT symbol, day, {R('CASE WHEN count(close) OVER f = 5 AND max(close) OVER f > min(close) OVER f THEN (close - min(close) OVER f) / (max(close) OVER f - min(close) OVER f) END', 'position')} FROM pn WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    return v.r6(panel.range_position(pan(spark, d), 5), "symbol", "day", position=None)


FWD = D + f""", h AS (SELECT *, last_value(close IGNORE NULLS) OVER {RUN} AS c FROM pn),
f AS (SELECT *, lead(c, 10) OVER w AS e, max(c) OVER g AS hi, min(c) OVER g AS lo FROM h WINDOW w AS (PARTITION BY symbol ORDER BY day), g AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))"""


@q("W23_forward_stats", FWD + f""", m AS (SELECT a.symbol, a.day, min(b.c / p.pk - 1) AS dd FROM f a JOIN h b ON a.symbol = b.symbol AND b.day BETWEEN a.day AND a.day + 10 JOIN LATERAL (SELECT max(x.c) AS pk FROM h x WHERE x.symbol = a.symbol AND x.day BETWEEN a.day AND b.day) p ON true GROUP BY 1, 2)
SELECT symbol, day, {R('e / c - 1', 'ret')} FROM f WHERE day + 10 <= fin AND c IS NOT NULL""".replace(""", m AS (SELECT a.symbol, a.day, min(b.c / p.pk - 1) AS dd FROM f a JOIN h b ON a.symbol = b.symbol AND b.day BETWEEN a.day AND a.day + 10 JOIN LATERAL (SELECT max(x.c) AS pk FROM h x WHERE x.symbol = a.symbol AND x.day BETWEEN a.day AND b.day) p ON true GROUP BY 1, 2)
SELECT symbol, day,""", """, pth AS (SELECT *, list(c) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS l FROM f)
SELECT symbol, day, round(hi / c - 1, 6) + 0.0 AS max, round(lo / c - 1, 6) + 0.0 AS min, round(list_min(list_transform(range(1, len(l) + 1), lambda i: l[i] / list_max(l[1:i]) - 1)), 6) + 0.0 AS dd,""").replace("FROM f WHERE day + 10", "FROM pth WHERE day + 10"))
def _(spark, d):
    out = panel.forward_stats(pan(spark, d), 10).filter(F.col("ret").isNotNull())
    return v.r6(out, "symbol", "day", ret=None, max=None, min=None, dd=None)


INDEX = D + ", ix AS (SELECT day, avg(r) AS r, count(*) AS n FROM (SELECT day, CASE WHEN active AND lag(active) OVER w THEN close / lag(close) OVER w - 1 END AS r FROM pn WINDOW w AS (PARTITION BY symbol ORDER BY day)) WHERE r IS NOT NULL GROUP BY 1)"


@q("D42_performance", INDEX + f""", e AS (SELECT *, exp(sum(ln(1 + r / 500)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) AS eq FROM ix), dd AS (SELECT *, eq / max(eq) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)
SELECT count(*) AS n, {R('exp(sum(ln(1 + r / 500)))', 'total_x')}, {R('stddev_samp(r / 500) * sqrt(365)', 'vol')}, {R('avg(r / 500) / stddev_samp(r / 500) * sqrt(365)', 'sharpe')}, {R('min(dd)', 'max_dd')}, {R('pow(exp(sum(ln(1 + r / 500))), 365.0 / count(*)) - 1', 'cagr')} FROM dd""")
def _(spark, d):
    ix = panel.market_index(pan(spark, d)).withColumn("r", F.col("r") / 500).withColumn("g", F.lit(1))
    return v.r6(panel.performance(ix, ["g"], "day", "r", 365), "n", total_x=None, vol=None, sharpe=None, max_dd=None, cagr=None)


@q("D41_regimes", INDEX + f""", l AS (SELECT day, r, sum(ln(1 + r)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS l FROM ix), m AS (SELECT *, CASE WHEN count(l) OVER f = 50 THEN avg(l) OVER f END AS ma FROM l WINDOW f AS (ORDER BY day ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
u AS (SELECT *, lag(l > ma) OVER (ORDER BY day) AS up FROM m) SELECT CASE WHEN up THEN 'above' ELSE 'below' END AS regime, count(*) AS n, {R('avg(r)', 'mean')}, {R('stddev_samp(r)', 'sd')} FROM u WHERE up IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return v.r6(panel.regimes(panel.market_index(pan(spark, d)), 50), "regime", "n", mean=None, sd=None)


@q("L20_rolling_starts", INDEX + f""", o AS (SELECT min(day) AS d0, max(day) AS d1 FROM ix), s AS (SELECT unnest(range(0, (SELECT d1 - d0 + 1 FROM o), 30)) AS start)
SELECT start, {R('exp(sum(ln(1 + r / 500)))', 'total_x')}, count(*) AS n FROM s, o, ix WHERE day >= d0 + start AND day < d0 + start + 365 AND d0 + start + 364 <= d1 GROUP BY 1""")
def _(spark, d):
    ix = panel.market_index(pan(spark, d)).withColumn("r", F.col("r") / 500)
    return v.r6(panel.rolling_starts(ix, 365, 30), "start", "n", total_x=None)


@q("L19_rebalanced_basket", D + f""", p AS (SELECT *, day // 20 AS period, last_value(close IGNORE NULLS) OVER {RUN} AS c FROM pn), h AS (SELECT symbol, period, arg_min(active, day) AS pick, first(c ORDER BY day) AS a, last(c ORDER BY day) AS z FROM p GROUP BY 1, 2)
SELECT period, count(*) AS n, {R('avg(z / a) - 1 - 0.001', 'ret')} FROM h WHERE pick AND a IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return v.r6(panel.basket(pan(spark, d), F.col("active"), 20, 0.001), "period", "n", ret=None)


@q("P22_event_study", FWD + f""", s AS (SELECT symbol, day, e / c - 1 AS ret, coalesce(close > 2000, false) AND NOT coalesce(lag(coalesce(close > 2000, false)) OVER (PARTITION BY symbol ORDER BY day), false) AS ev, fin, c FROM f)
SELECT day // 30 AS month, count(*) FILTER (ev) AS n_events, {R('coalesce(sum(ret) FILTER (ev), 0)', 'event_sum')}, {R('avg(ret)', 'all_mean')} FROM s WHERE day + 10 <= fin AND ret IS NOT NULL GROUP BY 1""")
def _(spark, d):
    s = panel.forward_stats(pan(spark, d), 10).withColumn("state", F.coalesce(F.col("close") > 2000, F.lit(False)))
    return v.r6(panel.event_study(s, "state"), "month", "n_events", event_sum=None, all_mean=None)


# -- quantile forecasts -----------------------------------------------------------------------------------------------------------

EMB = "e AS (SELECT vec_id, [list_sort(embedding)[k]::DOUBLE for k in [4, 11, 18, 25, 32, 39, 46, 53, 60]] AS q, embedding[1]::DOUBLE AS last FROM embeddings)"


def emb(spark, d):
    s = F.array_sort("embedding")
    picks = F.array(*[F.element_at(s, k).cast("double") for k in (4, 11, 18, 25, 32, 39, 46, 53, 60)])
    return v.table(spark, d, "embeddings").select("vec_id", picks.alias("q"), F.col("embedding")[0].cast("double").alias("last"))


@q("F27_sigma_from_quantiles", v.with_(EMB) + f"SELECT vec_id, {R('(q[9] - q[1]) / (2 * 1.2815515655446004)', 'sigma')} FROM e")
def _(spark, d):
    return v.r6(emb(spark, d), "vec_id", sigma=quantiles.sigma_from_quantiles(F.col("q")))


@q("F28_probability_above", v.with_(EMB) + f""", k AS (SELECT vec_id, last, list_concat([q[1] - (q[2] - q[1])], q, [q[9] + (q[9] - q[8])]) AS x FROM e), j AS (SELECT *, len(list_filter(x, lambda v: v < last)) AS nl, len(list_filter(x, lambda v: v <= last)) AS nr FROM k),
c AS (SELECT vec_id, CASE WHEN nl <= 0 THEN 0 WHEN nl >= 11 THEN 1 ELSE (nl - 1) / 10.0::DOUBLE + 0.1::DOUBLE * CASE WHEN x[nl + 1] > x[nl] THEN least(greatest((last - x[nl]) / (x[nl + 1] - x[nl]), 0), 1) ELSE 1 END END AS fl,
 CASE WHEN nr <= 0 THEN 0 WHEN nr >= 11 THEN 1 ELSE (nr - 1) / 10.0::DOUBLE + 0.1::DOUBLE * CASE WHEN x[nr + 1] > x[nr] THEN least(greatest((last - x[nr]) / (x[nr + 1] - x[nr]), 0), 1) ELSE 1 END END AS fr FROM j)
SELECT vec_id, {R('least(greatest(1 - 0.5 * (fl + fr), 0.01), 0.99)', 'p_up')} FROM c""")
def _(spark, d):
    return v.r6(emb(spark, d), "vec_id", p_up=quantiles.probability_above(F.col("q"), F.col("last")))


@q("K08_batch_forecast", v.base() + f""", lc AS (SELECT symbol, t, list(ln(close)) OVER f AS c, lag(t, 31) OVER w AS t0 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t), f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)),
o AS (SELECT symbol, t, c, list_transform(range(2, 33), lambda i: c[i] - c[i - 1]) AS dx FROM lc WHERE len(c) = 32 AND t - t0 = 111600) SELECT symbol, t, {R('c[32]', 'last_value')}, {R('c[32] - 1.2815515655446004 * list_stddev_pop(dx)', 'q10')} FROM o""")
def _(spark, d):
    c = models.context_windows(v.bars(spark, d), 32, bar_s=3600, every=1)
    return v.r6(models.batch_forecast(c), "symbol", "t", last_value=None, q10=F.col("q")[0])


# -- models -------------------------------------------------------------------------------------------------------------------------

FEATURES = ["ret_1", "ret_5", "rsi_6", "clv", "taker_imb_5"]


def training(spark, d):
    b = compute_indicators(v.bars(spark, d), FEATURES, keep_rows=True)
    t = targets.make_targets(b, [1], bar_s=3600)
    return t.filter(F.col("dir_1").isNotNull()).select("symbol", F.col("t").cast("long").alias("t"), *FEATURES, F.col("dir_1").alias("y"))


@q("K01_walk_forward_logit")
def _(spark, d):
    return v.r6(models.walk_forward(training(spark, d), FEATURES, horizon=1), "symbol", "t", "fold", "y", p_up=None)


@q("K02_walk_forward_trees")
def _(spark, d):
    return v.r6(models.walk_forward(training(spark, d), FEATURES, horizon=1, folds=2, kind="trees"), "symbol", "t", "fold", "y", p_up=None)


@q("K05_isotonic_calibration")
def _(spark, d):
    x = v.predictions(spark, d).withColumn("y", F.col("y").cast("double"))
    half = F.col("day") < 19737
    return v.r6(models.isotonic_calibration(x.filter(half), x.filter(~half), "p2", "y"), "symbol", "t", p_cal=None)


@q("P21_rank_persistence", v.base(v.PRED_SQL) + f""", h AS (SELECT symbol, day AS period, sum(CASE WHEN p >= 0.5 THEN ret ELSE -ret END) AS v FROM pred GROUP BY 1, 2), pr AS (SELECT k.k, a.period, a.v AS x, b.v AS y FROM h a, (SELECT unnest([1, 2, 3]) AS k) k, h b WHERE b.symbol = a.symbol AND b.period = a.period + k.k),
r AS (SELECT *, rank() OVER (PARTITION BY k, period ORDER BY x) AS rx, rank() OVER (PARTITION BY k, period ORDER BY y) AS ry FROM pr), i AS (SELECT k, period, corr(rx, ry) AS ic, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 3) SELECT k, count(ic) AS n_periods, {R('avg(ic)', 'ic_mean')}, sum(n)::BIGINT AS n_pairs FROM i GROUP BY 1""")
def _(spark, d):
    h = v.predictions(spark, d).groupBy("symbol", F.col("day").alias("period")).agg(F.sum(F.when(F.col("p") >= 0.5, F.col("ret")).otherwise(-F.col("ret"))).alias("v"))
    return v.r6(stats.rank_persistence(h, "symbol", "period", "v", [1, 2, 3]), "k", "n_periods", "n_pairs", ic_mean=None)


@q("P15_ewma_choice", v.base() + f""", r AS (SELECT symbol, t, (ln(close) - ln(lag(close) OVER w)) ** 2 AS r2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)), f AS (SELECT symbol, t, a.a, r2, CASE WHEN count(r2) OVER u > 0 THEN list_reduce(list_filter(list(r2) OVER u, lambda e: e IS NOT NULL), lambda y, e: y + a.a * (e - y)) END AS v FROM r, (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.3::DOUBLE]) AS a) a WINDOW u AS (PARTITION BY symbol, a.a ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT symbol, a, avg(greatest(r2, 0.0001) / greatest(v, 0.0001) - ln(greatest(r2, 0.0001) / greatest(v, 0.0001)) - 1) AS loss FROM f WHERE r2 IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2) SELECT symbol, arg_min(a, (loss, a)) AS a, {R('min(loss)', 'loss')} FROM l GROUP BY 1""")
def _(spark, d):
    from tapeloom.operators import tiling
    from tapeloom.operators.cells import choose_by_loss
    from tapeloom.operators.layers import Layers, Node, ema_reach
    alphas = [0.05, 0.1, 0.3]
    tiled = tiling.tile(v.bars(spark, d), ["symbol"], "open_time", behind=ema_reach(min(alphas)) + 2)
    l = Layers(tiled, ["symbol"])
    lc = l.let("lc", lambda: Node.apply(F.log, l.source("close")))
    r2 = l.let("r2", lambda: l.diff("lc", lc) * l.diff("lc", lc))
    out = {"r2": r2}
    for i, a in enumerate(alphas):
        out[f"v{i}"] = l.lag(f"ew{i}", l.ema("r2", r2, a, 1), 1)
    rows = tiling.untile(l.build(out)).select("symbol", "r2", F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.col(f"v{i}").alias("v")) for i, a in enumerate(alphas)])))
    return v.r6(choose_by_loss(rows.filter(F.col("r2").isNotNull() & F.col("v").isNotNull()), ["symbol"], "a", prob.qlike(F.col("v"), F.col("r2"), 1e-4)), "symbol", "a", loss=None)


QUERIES = Q
