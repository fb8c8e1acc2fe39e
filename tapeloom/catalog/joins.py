"""Temporal joins, window kernels, targets, cleaning and set operations on ticks and hourly bars."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tapeloom.catalog import views as v
from tapeloom.catalog.registry import Query
from tapeloom.functions.numeric import div, ln, ndigits
from tapeloom.operators import asof, clean, intervals, resample, series, tiling
from tapeloom.plans import targets

R = v.rsql
Q: dict[str, Query] = {}


def q(name, sql=None):
    def deco(fn):
        Q[name] = Query(fn, sql)
        return fn
    return deco


B = v.base()
M = v.base(v.MARKETS_SQL)
TICK = "tk AS (SELECT *, us / 1000000.0 AS ts FROM ticks)"


#: The sources of the ticks.
SYMBOLS = ("click", "error", "purchase", "signup", "view")


def ticks(spark, d):
    return v.ticks(spark, d).withColumn("tsec", tiling.epoch_seconds(v.ticks(spark, d), "ts"))


def grid(spark, d):
    """Query instants: the middle of every hourly window."""
    return v.bars(spark, d).select("symbol", (F.col("t") + 1800).cast("long").alias("qt"))


GRID = "grid AS (SELECT symbol, t + 1800 AS qt FROM bars)"


@q("J01_asof_derivatives", v.base(v.DERIVS_SQL) + f"SELECT symbol, t, {R('funding_rate * 10000', 'funding_rate')}, {R('open_interest')}, {R('ls_ratio_top')} FROM dbars")
def _(spark, d):
    return v.r6(v.bars_with_derivs(spark, d), "symbol", "t", funding_rate=F.col("funding_rate") * 10000, open_interest=None, ls_ratio_top=None)


@q("J02_step_value", v.base(TICK, GRID) + f"SELECT g.symbol, qt, {R('price')}, seq FROM grid g ASOF LEFT JOIN tk ON g.symbol = tk.symbol AND g.qt >= tk.ts")
def _(spark, d):
    out = asof.asof_join(grid(spark, d), ticks(spark, d), ["symbol"], "qt", "tsec", ["price", "seq"], tie="seq")
    return v.r6(out, "symbol", "qt", "seq", price=None)


@q("J03_asof_staleness", v.base(TICK, GRID) + f"SELECT g.symbol, qt, CASE WHEN qt - ts <= 1200 THEN seq END AS seq, {R('CASE WHEN qt - ts <= 1200 THEN qt - ts END', 'age')} FROM grid g ASOF LEFT JOIN tk ON g.symbol = tk.symbol AND g.qt >= tk.ts")
def _(spark, d):
    out = asof.asof_join(grid(spark, d), ticks(spark, d), ["symbol"], "qt", "tsec", ["seq"], tolerance=1200, age="age")
    return v.r6(out, "symbol", "qt", "seq", age=None)


@q("J04_last_and_vwap", v.base(TICK, GRID) + f"""SELECT g.symbol, qt, arg_max(seq, ts) FILTER (ts <= qt) AS last_seq, count(ts) AS n, {R('sum(price * size) / sum(size)', 'vwap')}
FROM grid g LEFT JOIN tk ON g.symbol = tk.symbol AND ts >= qt - 1800 AND ts <= qt GROUP BY 1, 2""")
def _(spark, d):
    out = series.last_and_vwap(grid(spark, d), ticks(spark, d), 1800)
    return v.r6(out, "symbol", "qt", "last_seq", "n", vwap=None)


@q("J05_forward_asof", v.base(TICK, GRID) + f"SELECT g.symbol, qt, CASE WHEN ts - qt <= 900 THEN seq END AS seq, {R('CASE WHEN ts - qt <= 900 THEN price END', 'price')} FROM grid g ASOF LEFT JOIN tk ON g.symbol = tk.symbol AND g.qt <= tk.ts")
def _(spark, d):
    out = asof.asof_join(grid(spark, d), ticks(spark, d), ["symbol"], "qt", "tsec", ["seq", "price"], tolerance=900, forward=True)
    return v.r6(out, "symbol", "qt", "seq", price=None)


@q("J06_exact_lookup", B + f"SELECT a.symbol, a.t, {R('b.close', 'prev_close')}, {R('ln(a.close / b.close)', 'past_return')} FROM bars a LEFT JOIN bars b ON a.symbol = b.symbol AND b.t = a.t - 7200")
def _(spark, d):
    b = v.bars(spark, d)
    past = b.select("symbol", (F.col("t") + 7200).alias("t"), F.col("close").alias("prev_close"))
    out = asof.exact_lookup(b, past, ["symbol", "t"], ["prev_close"])
    return v.r6(out, "symbol", "t", prev_close=None, past_return=ln(div(F.col("close"), F.col("prev_close"))))


@q("J07_interval_sum", v.base(TICK, v.MARKETS_SQL) + f"SELECT mk.symbol, s, count(*) AS n, {R('sum(size)', 'size')}, {R('sum(price * size)', 'notional')} FROM mk JOIN tk ON tk.symbol = mk.symbol AND ts > s - 5400 AND ts <= s + 900 GROUP BY 1, 2")
def _(spark, d):
    m = v.markets(spark, d).select("symbol", "s", (F.col("s") - 5400).alias("a"), (F.col("s") + 900).alias("z"))
    j = intervals.interval_join(ticks(spark, d), m, ["symbol"], "tsec", "a", "z", width=7200, closed="right")
    return v.r6(j.groupBy("symbol", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum(F.col("price") * F.col("size")).alias("notional")),
                "symbol", "s", "n", size=None, notional=None)


@q("J08_benchmark_fill", v.base(v.BENCH_SQL) + f"SELECT symbol, t, {R('bench_close')} FROM mbars")
def _(spark, d):
    return v.r6(v.bars_with_bench(spark, d), "symbol", "t", bench_close=None)


@q("J11_prediction_merge", v.base(v.PRED_SQL) + f"SELECT symbol, t, y, {R('p')}, (SELECT 1) AS one, m.up AS now_up FROM pred LEFT JOIN (SELECT symbol, t, close >= open AS up FROM bars) m USING (symbol, t)")
def _(spark, d):
    m = v.bars(spark, d).select("symbol", "t", (F.col("close") >= F.col("open")).alias("now_up"))
    out = v.predictions(spark, d).join(m, ["symbol", "t"], "left").withColumn("one", F.lit(1))
    return v.r6(out, "symbol", "t", "y", "one", "now_up", p=None)


@q("J13_chain_checks", M + f"""SELECT a.symbol, 'start_is_previous_end' AS relation, count(*) AS n, count(*) FILTER (abs(a.k - b.f) < 0.000001) AS n_equal, {R('avg(abs(a.k - b.f))', 'mean_gap')} FROM mk a JOIN mk b ON a.symbol = b.symbol AND a.s = b.e GROUP BY 1
UNION ALL SELECT a.symbol, 'up_after_up', count(*), count(*) FILTER (a.up AND b.up), {R('avg(abs(a.f - b.k))', 'mean_gap')} FROM mk a JOIN mk b ON a.symbol = b.symbol AND a.s = b.e GROUP BY 1""")
def _(spark, d):
    return v.r6(series.chain_checks(v.markets(spark, d)), "symbol", "relation", "n", "n_equal", mean_gap=None)


@q("J14_consecutive_pairs", M + "SELECT symbol, up, nxt, count(*) AS n FROM (SELECT symbol, up, s, lead(up) OVER w AS nxt, lead(s) OVER w AS ns FROM mk WINDOW w AS (PARTITION BY symbol ORDER BY s)) WHERE ns = s + 3600 GROUP BY 1, 2, 3")
def _(spark, d):
    m = v.markets(spark, d)
    nxt = m.select("symbol", (F.col("s") - 3600).alias("s"), F.col("up").alias("nxt"))
    return m.join(nxt, ["symbol", "s"]).groupBy("symbol", "up", "nxt").agg(F.count(F.lit(1)).alias("n"))


@q("D38_crosstab", M + f"""SELECT symbol, count(*) FILTER (up AND nxt) AS up_up, count(*) FILTER (up AND NOT nxt) AS up_down, count(*) FILTER (NOT up AND nxt) AS down_up, count(*) FILTER (NOT up AND NOT nxt) AS down_down, {R('avg((up = nxt)::INT)', 'share_same')}
FROM (SELECT a.symbol, a.up, b.up AS nxt FROM mk a JOIN mk b ON a.symbol = b.symbol AND b.s = a.s + 3600) GROUP BY 1""")
def _(spark, d):
    m = v.markets(spark, d)
    pair = m.join(m.select("symbol", (F.col("s") - 3600).alias("s"), F.col("up").alias("nxt")), ["symbol", "s"])
    cell = F.concat_ws("_", F.when(F.col("up"), "up").otherwise("down"), F.when(F.col("nxt"), "up").otherwise("down"))
    wide = pair.withColumn("cell", cell).groupBy("symbol").pivot("cell", ["up_up", "up_down", "down_up", "down_down"]).count().fillna(0)
    same = (F.col("up_up") + F.col("down_down")) / (F.col("up_up") + F.col("up_down") + F.col("down_up") + F.col("down_down"))
    return v.r6(wide, "symbol", "up_up", "up_down", "down_up", "down_down", share_same=same)


@q("J15_parent_children", M + """SELECT symbol, s // 14400 * 14400 AS parent, count(*) AS n_children, count(*) FILTER (up) AS n_up, bool_and(up) AS all_up, arg_max(f, s) >= arg_min(k, s) AS parent_up FROM mk GROUP BY 1, 2""")
def _(spark, d):
    return series.parent_children(v.markets(spark, d), 14400)


@q("D30_logic_violations", M + """, g AS (SELECT symbol, s // 14400 * 14400 AS parent, count(*) AS n, bool_and(up) AS all_up, bool_and(NOT up) AS all_down, arg_max(f, s) >= arg_min(k, s) AS parent_up FROM mk GROUP BY 1, 2)
SELECT symbol, count(*) AS n_groups, count(*) FILTER (n = 4 AND all_up AND NOT parent_up) AS up_violation, count(*) FILTER (n = 4 AND all_down AND parent_up) AS down_violation FROM g GROUP BY 1""")
def _(spark, d):
    g = series.parent_children(v.markets(spark, d), 14400)
    full = F.col("n_children") == 4
    return g.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_groups"), F.count(F.when(full & F.col("all_up") & ~F.col("parent_up"), 1)).alias("up_violation"),
        F.count(F.when(full & (F.col("n_up") == 0) & F.col("parent_up"), 1)).alias("down_violation"))


@q("J16_decision_grid", v.base(TICK, v.MARKETS_SQL) + f"""SELECT g.symbol, s, k, {R('price')} FROM (SELECT symbol, s, k.k, s + k.k AS qt FROM (SELECT symbol, s FROM mk) , (SELECT unnest([-600, -60, 0, 300, 1800, 3000]) AS k) k) g
ASOF LEFT JOIN tk ON g.symbol = tk.symbol AND g.qt >= tk.ts""")
def _(spark, d):
    g = series.decision_grid(v.markets(spark, d).select("symbol", "s"), [-600, -60, 0, 300, 1800, 3000])
    return v.r6(asof.asof_join(g, ticks(spark, d), ["symbol"], "qt", "tsec", ["price"], tie="seq"), "symbol", "s", "k", price=None)


@q("Q03_window_prices", v.base(TICK, v.MARKETS_SQL) + f"""SELECT symbol, s, max(CASE WHEN k = -30 THEN price END) AS p_m30, max(CASE WHEN k = 0 THEN price END) AS p_0, max(CASE WHEN k = 600 THEN price END) AS p_600, {R('max(CASE WHEN k = 0 THEN qt - ts END)', 'age_0')} FROM (
SELECT g.symbol, s, k, CASE WHEN qt - ts <= 3600 THEN price END AS price, CASE WHEN qt - ts <= 3600 THEN ts END AS ts, qt FROM (SELECT symbol, s, k.k, s + k.k AS qt FROM (SELECT symbol, s FROM mk), (SELECT unnest([-30, 0, 600]) AS k) k) g
ASOF LEFT JOIN tk ON g.symbol = tk.symbol AND g.qt >= tk.ts) GROUP BY 1, 2""")
def _(spark, d):
    g = series.decision_grid(v.markets(spark, d).select("symbol", "s"), [-30, 0, 600])
    x = asof.asof_join(g, ticks(spark, d), ["symbol"], "qt", "tsec", ["price"], tolerance=3600, tie="seq", age="age")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    out = x.groupBy("symbol", "s").agg(at(-30, "price").alias("p_m30"), at(0, "price").alias("p_0"), at(600, "price").alias("p_600"), at(0, "age").alias("age_0"))
    return v.r6(out, "symbol", "s", "p_m30", "p_0", "p_600", age_0=None)


@q("J25_aligned_series", v.base(TICK, v.MARKETS_SQL) + f"""SELECT qt, {', '.join(f"max(price) FILTER (symbol = '{x}') AS {x}" for x in SYMBOLS)} FROM (
SELECT g.symbol, qt, price FROM (SELECT sy.symbol, gs.gs AS qt FROM (SELECT unnest({list(SYMBOLS)}) AS symbol) sy, (SELECT unnest(range(min(t), max(t) + 1, 600)) AS gs FROM bars) gs) g ASOF LEFT JOIN tk ON g.symbol = tk.symbol AND g.qt >= tk.ts) GROUP BY 1""")
def _(spark, d):
    span = v.bars(spark, d).agg(F.min("t").cast("long").alias("a"), F.max("t").cast("long").alias("z"))
    return series.aligned_series(ticks(spark, d), span, SYMBOLS, 600)


@q("J26_joint_state", v.base(TICK) + f"""SELECT seq, {', '.join(f"last_value(CASE WHEN symbol = '{x}' THEN price END IGNORE NULLS) OVER w AS {x}" for x in SYMBOLS)}
FROM tk WINDOW w AS (ORDER BY us, seq ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    return series.joint_state(ticks(spark, d), SYMBOLS).select("seq", *SYMBOLS)


@q("J27_cover_cost", v.base() + f""", vx(vertex, symbol, weight) AS (VALUES (1, 'click', 1.0), (1, 'view', 1.0), (2, 'error', 1.0), (2, 'click', 1.0), (3, 'view', 1.0), (3, 'purchase', 0.5), (3, 'error', 0.5)),
need AS (SELECT vertex, count(*) AS k FROM vx GROUP BY 1), c AS (SELECT t, vertex, sum(weight * close) AS cost, count(*) AS k FROM bars JOIN vx USING (symbol) GROUP BY 1, 2)
SELECT t, arg_min(vertex, (cost, vertex)) AS vertex, {R('min(cost)', 'cost')} FROM c JOIN need USING (vertex, k) GROUP BY 1""")
def _(spark, d):
    rows = [(1, "click", 1.0), (1, "view", 1.0), (2, "error", 1.0), (2, "click", 1.0), (3, "view", 1.0), (3, "purchase", 0.5), (3, "error", 0.5)]
    prices = v.bars(spark, d).select("t", F.col("symbol").alias("token"), F.col("close").alias("ask"))
    return v.r6(series.min_cover_cost(prices, rows), "t", "vertex", cost=None)


# -- window kernels and targets -------------------------------------------------------------------------------------------

W = "WINDOW w AS (PARTITION BY symbol ORDER BY t)"


@q("X01_targets", B + f"""SELECT symbol, t, {', '.join(R(f"CASE WHEN lead(t, {h}) OVER w - t = {h * 3600} THEN ln(lead(close, {h}) OVER w / close) END", f'fwd_{h}') for h in (1, 5))},
 CASE WHEN lead(t) OVER w - t = 3600 THEN CASE WHEN lead(close) OVER w > close THEN 1.0::DOUBLE WHEN lead(close) OVER w < close THEN 0.0::DOUBLE END END AS dir_1 FROM bars {W}""")
def _(spark, d):
    return v.r6(targets.make_targets(v.bars(spark, d), [1, 5], bar_s=3600), "symbol", "t", fwd_1=None, fwd_5=None, dir_1=None)


@q("D29_bar_duration", B + f"SELECT symbol, arg_min(gap, (-n, gap)) AS bar_s FROM (SELECT symbol, gap, count(*) AS n FROM (SELECT symbol, t - lag(t) OVER w AS gap FROM bars {W}) WHERE gap IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return targets.bar_seconds(v.bars(spark, d))


@q("W25_forward_variance", B + f"""SELECT symbol, t, {R("CASE WHEN count(r2) OVER f = 5 AND lead(t, 5) OVER w - t = 18000 THEN sum(r2) OVER f END", 'fv')} FROM (SELECT *, CASE WHEN t - lag(t) OVER w = 3600 THEN (ln(close) - ln(lag(close) OVER w)) ** 2 END AS r2 FROM bars {W}) {W}, f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def _(spark, d):
    return v.r6(targets.forward_variance(v.bars(spark, d), 5, bar_s=3600, out="fv"), "symbol", "t", fv=None)


@q("W31_time_spine", B + f"""SELECT symbol, g.t, {R('last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY g.t)', 'close')}, b.close IS NULL AS filled FROM (SELECT symbol, unnest(range(min(t), max(t) + 1, 3600)) AS t FROM bars GROUP BY 1) g LEFT JOIN bars b USING (symbol, t)""")
def _(spark, d):
    return v.r6(series.regular_bars(v.bars(spark, d), 3600), "symbol", "t", "filled", close=None)


@q("W30_interpolation", B + f"""SELECT symbol, t, {R('CASE WHEN close IS NOT NULL THEN close WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (t - pt) / (nt - pt) END', 'close')} FROM (SELECT symbol, g.t, b.close, last_value(b.close IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN b.close IS NOT NULL THEN g.t END IGNORE NULLS) OVER p AS pt,
 first_value(b.close IGNORE NULLS) OVER n AS nv, first_value(CASE WHEN b.close IS NOT NULL THEN g.t END IGNORE NULLS) OVER n AS nt FROM (SELECT symbol, unnest(range(min(t), max(t) + 1, 3600)) AS t FROM bars GROUP BY 1) g LEFT JOIN bars b USING (symbol, t)
 WINDOW p AS (PARTITION BY symbol ORDER BY g.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY symbol ORDER BY g.t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def _(spark, d):
    return v.r6(series.interpolated(series.on_spine(v.bars(spark, d), 3600), "close"), "symbol", "t", close=None)


@q("W28_max_gap", v.base(TICK) + f"SELECT symbol, {R('max(gap)', 'max_gap')}, count(*) FILTER (gap > 3600) AS n_long FROM (SELECT symbol, (us - lag(us) OVER (PARTITION BY symbol ORDER BY us)) / 1000000.0 AS gap FROM tk) GROUP BY 1")
def _(spark, d):
    return v.r6(series.max_gap(v.ticks(spark, d), 3600), "symbol", "n_long", max_gap=None)


@q("W32_islands", v.base(TICK) + f"""SELECT symbol, count(*) AS n, min(us) AS first_us, {R('(max(us) - min(us)) / 1000000.0', 'length')} FROM (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM (
SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 1200000000 THEN 1 ELSE 0 END AS new FROM tk WINDOW w AS (PARTITION BY symbol ORDER BY us))) GROUP BY symbol, run""")
def _(spark, d):
    us = F.unix_micros("ts")
    out = intervals.islands(v.ticks(spark, d), ["symbol"], "ts", max_gap=1200, aggs=[
        F.count(F.lit(1)).alias("n"), F.min(us).alias("first_us"), ((F.max(us) - F.min(us)) / 1000000).alias("length")])
    return v.r6(out, "symbol", "n", "first_us", length=None)


@q("A20_missing_intervals", B + """, c AS (SELECT symbol, t, lead(t) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)) SELECT symbol, t + 3600 AS a, n AS z FROM c WHERE n > t + 3600""")
def _(spark, d):
    b = v.bars(spark, d).select("symbol", F.col("t").cast("long").alias("a"), (F.col("t") + 3600).cast("long").alias("z"))
    want = b.groupBy("symbol").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    return intervals.missing_intervals(want, b, ["symbol"], "a", "z")


@q("G04_interval_union", B + """, r AS (SELECT symbol, t, sum(n) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT symbol, t, CASE WHEN t - lag(t) OVER w = 3600 THEN 0 ELSE 1 END AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t))) SELECT symbol, min(t) AS a, max(t) + 3600 AS z FROM r GROUP BY symbol, run""")
def _(spark, d):
    b = v.bars(spark, d).select("symbol", F.col("t").cast("long").alias("a"), (F.col("t") + 3600).cast("long").alias("z"))
    return intervals.merge_intervals(b, ["symbol"], "a", "z")


@q("W21_change_detection", v.base(TICK) + "SELECT symbol, sec, seq FROM (SELECT symbol, us // 600000000 AS sec, seq, lead(us // 600000000) OVER (PARTITION BY symbol ORDER BY us) AS nxt FROM tk) WHERE nxt IS NULL OR nxt <> sec")
def _(spark, d):
    t = v.ticks(spark, d).withColumn("sec", F.floor(F.unix_micros("ts") / 600000000))
    return series.last_of_run(t, ["symbol"], "ts", "sec").select("symbol", "sec", "seq")


@q("W34_variance_ratio_by_horizon", B + f"""SELECT symbol, k, {R('var_pop(rk) / (k * any_value(v1))', 'vr')}, {R('corr(r1, rl)', 'ac')} FROM (SELECT symbol, k, ln(close) - ln(lag(close, k) OVER w) AS rk, r1, lag(r1, k) OVER w AS rl, v1 FROM (
SELECT b.*, k.k, var_pop(r1) OVER (PARTITION BY symbol, k.k) AS v1 FROM (SELECT *, ln(close) - ln(lag(close) OVER w) AS r1 FROM bars {W}) b, (SELECT unnest([2, 5, 10]) AS k) k) WINDOW w AS (PARTITION BY symbol, k ORDER BY t)) GROUP BY 1, 2""")
def _(spark, d):
    return v.r6(series.variance_ratios(v.bars(spark, d), [2, 5, 10]), "symbol", "k", vr=None, ac=None)


@q("W26_vol_estimators", B + f"""SELECT symbol, t, {R('CASE WHEN count(r1) OVER f >= 48 THEN sqrt(avg(r1 * r1) OVER f) END', 'rms60')}, {R('CASE WHEN count(r1) OVER f >= 48 THEN stddev_pop(r1) OVER f END', 'rstd60')}, {R('CASE WHEN count(*) OVER f >= 48 THEN sqrt(avg(ln(high / low) ** 2) OVER f / (4 * ln(2))) END', 'park60')},
 {R('CASE WHEN count(*) OVER f >= 48 THEN sqrt(greatest(avg(0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2) OVER f, 0)) END', 'gk60')} FROM (SELECT *, CASE WHEN t - lag(t) OVER w = 3600 THEN ln(close / lag(close) OVER w) END AS r1 FROM bars {W}) WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return v.r6(series.vol_estimators(v.bars(spark, d), 60, bar_s=3600), "symbol", "t", rms60=None, rstd60=None, park60=None, gk60=None)


@q("W35_level_size", v.base(TICK) + f"SELECT symbol, seq, {R('sum(size) OVER (PARTITION BY symbol, us // 3600000000, round(price) ORDER BY us ROWS UNBOUNDED PRECEDING)', 'level_size')} FROM tk")
def _(spark, d):
    t = v.ticks(spark, d)
    w = Window.partitionBy("symbol", F.floor(F.unix_micros("ts") / 3600000000), F.round("price")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return v.r6(t.withColumn("level_size", F.sum("size").over(w)), "symbol", "seq", level_size=None)


@q("W22_rising_edge", B + "SELECT symbol, t FROM (SELECT *, close > 30 AS on_, lag(close > 30) OVER w AS was FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)) WHERE on_ AND NOT coalesce(was, false)")
def _(spark, d):
    b = v.bars(spark, d).withColumn("on_", F.col("close") > 30)
    return series.rising_edges(b, ["symbol"], "open_time", "on_").select("symbol", "t")


# -- cleaning, sources, set operations -----------------------------------------------------------------------------------

RAW = """raw AS (SELECT symbol, t, us, CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 13 = 0 THEN -price ELSE price END AS close, price AS open, price * 0.5 AS high, price * 2 AS low, CASE WHEN seq % 5 = 0 THEN -1.0 ELSE size::DOUBLE END AS volume, seq
 FROM (SELECT *, us // 3600000000 * 3600 AS t FROM ticks))"""


def raw_rows(spark, d):
    t = v.ticks(spark, d)
    return t.select("symbol", (F.floor(F.unix_micros("ts") / 3600000000) * 3600).alias("t"), "seq",
                    F.when(F.col("seq") % 11 == 0, F.lit(float("nan"))).when(F.col("seq") % 13 == 0, -F.col("price")).otherwise(F.col("price")).alias("close"),
                    F.col("price").alias("open"), (F.col("price") * 0.5).alias("high"), (F.col("price") * 2).alias("low"),
                    F.when(F.col("seq") % 5 == 0, -1.0).otherwise(F.col("size").cast("double")).alias("volume"))


@q("B01_clean_ohlcv", v.with_(v.TICKS_SQL, RAW) + f"""SELECT symbol, t, seq, {R('greatest(open, high, low, close)', 'high')}, {R('least(open, high, low, close)', 'low')}, {R('CASE WHEN volume >= 0 THEN volume END', 'volume')} FROM raw WHERE close > 0 AND open > 0 QUALIFY true""".replace(" FROM raw WHERE", " FROM (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, t ORDER BY seq DESC) = 1) WHERE").replace(" QUALIFY true", ""))
def _(spark, d):
    return v.r6(clean.clean_ohlcv(raw_rows(spark, d), ["symbol", "t"], "seq"), "symbol", "t", "seq", high=None, low=None, volume=None)


@q("B05_keep_last", v.with_(v.TICKS_SQL) + "SELECT symbol, us // 3600000000 AS h, max(seq) AS seq, arg_max(trader, seq) AS trader FROM ticks GROUP BY 1, 2")
def _(spark, d):
    t = v.ticks(spark, d).select("symbol", F.floor(F.unix_micros("ts") / 3600000000).alias("h"), "seq", "trader")
    return clean.keep_last(t, ["symbol", "h"], "seq")


@q("B02_session_date", B + """SELECT symbol, t, (to_timestamp(t - 18000)::TIMESTAMP)::DATE AS us_date, (to_timestamp(t + 3600)::TIMESTAMP)::DATE AS fr_date FROM bars""")
def _(spark, d):
    b = v.bars(spark, d)
    return b.select("symbol", "t", clean.session_date(F.col("open_time"), F.lit("US")).alias("us_date"), clean.session_date(F.col("open_time"), F.lit("FR")).alias("fr_date"))


@q("B03_market_class", v.with_(v.TICKS_SQL) + "SELECT k, count(*) AS n FROM (SELECT CASE WHEN seq % 3 = 0 THEN 'CRYPTO' WHEN seq % 3 = 1 THEN 'FR' ELSE 'US' END AS k FROM ticks) GROUP BY 1")
def _(spark, d):
    sym = F.concat(F.col("symbol"), F.when(F.col("seq") % 3 == 0, "USDT").when(F.col("seq") % 3 == 1, ".PA").otherwise(""))
    return v.ticks(spark, d).groupBy(clean.market_of(sym).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@q("B04_closed_bars", B + "SELECT symbol, t FROM bars WHERE t + 3600 <= (SELECT max(us) // 1000000 FROM ticks)")
def _(spark, d):
    now = v.ticks(spark, d).agg(F.max(F.unix_seconds("ts")).alias("now"))
    return v.bars(spark, d).join(F.broadcast(now), F.unix_seconds("open_time") + 3600 <= F.col("now")).select("symbol", "t")


@q("B06_finite_close", v.with_(v.TICKS_SQL, RAW) + "SELECT symbol, count(*) AS n FROM raw WHERE close IS NOT NULL GROUP BY 1")
def _(spark, d):
    return raw_rows(spark, d).filter(clean.known("close")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@q("D01_resample", v.base() + f"""SELECT symbol, t // 21600 * 21600 AS t, {R('arg_min(open, t)', 'open')}, {R('max(high)', 'high')}, {R('min(low)', 'low')}, {R('arg_max(close, t)', 'close')}, {R('sum(volume)', 'volume')}, count(*) AS n_rows FROM bars GROUP BY 1, 2 HAVING count(*) >= 5""")
def _(spark, d):
    return v.r6(resample.coarser_bars(v.bars(spark, d), 21600, 5), "symbol", "t", "n_rows", open=None, high=None, low=None, close=None, volume=None)


@q("D02_half_window_aggregates", v.base(TICK) + f"""SELECT symbol, us // 3600000000 * 3600 AS t, count(*) FILTER (h = 0) AS n1, {R('arg_min(price, us) FILTER (h = 0)', 'open1')}, {R('arg_max(price, us) FILTER (h = 0)', 'close1')}, {R('avg(price) FILTER (h = 0)', 'twap1')},
 {R('sum(price * size) FILTER (h = 0) / sum(size) FILTER (h = 0)', 'vwap1')}, {R('max(price) FILTER (h = 0)', 'high1')}, {R('avg(price) FILTER (h = 1)', 'twap2')}, {R('CASE WHEN count(*) FILTER (h = 0) >= 2 THEN regr_slope(ln(price), us / 60000000.0) FILTER (h = 0) END', 'slope1')} FROM (SELECT *, CASE WHEN us % 3600000000 < 1800000000 THEN 0 ELSE 1 END AS h FROM tk) GROUP BY 1, 2""".replace("us / 60000000.0", "(us % 3600000000) / 60000000.0"))
def _(spark, d):
    out = series.half_window_aggregates(v.ticks(spark, d), 3600)
    return v.r6(out, "symbol", "t", "n1", open1=None, close1=None, twap1=None, vwap1=None, high1=None, twap2=None, slope1=None)


@q("D03_window_twap_vwap", v.base(TICK) + f"SELECT symbol, us // 1800000000 AS w, {R('avg(price)', 'twap')}, {R('sum(price * size) / sum(size)', 'vwap')} FROM tk GROUP BY 1, 2")
def _(spark, d):
    t = v.ticks(spark, d)
    out = t.groupBy("symbol", F.floor(F.unix_micros("ts") / 1800000000).alias("w")).agg(*series.twap_vwap())
    return v.r6(out, "symbol", "w", twap=None, vwap=None)


@q("D28_coverage", B + f"SELECT symbol, count(*) AS n_bars, ((max(t) - min(t)) // 3600 + 1)::BIGINT AS n_expected, ((max(t) - min(t)) // 3600 + 1 - count(*))::BIGINT AS n_missing, {R('avg((volume IS NOT NULL)::INT)', 'volume_known')} FROM bars GROUP BY 1")
def _(spark, d):
    return v.r6(clean.coverage(v.bars(spark, d), 3600), "symbol", "n_bars", "n_expected", "n_missing", volume_known=None)


@q("G01_union_missing_columns", B + f"SELECT symbol, t, {R('close')}, NULL::BIGINT AS seq FROM bars UNION ALL SELECT symbol, us // 1000000, NULL::DOUBLE, seq FROM ticks")
def _(spark, d):
    a = v.bars(spark, d).select("symbol", "t", ndigits(F.col("close")).alias("close"))
    b = v.ticks(spark, d).select("symbol", F.floor(F.unix_micros("ts") / 1000000).alias("t"), "seq")
    return a.unionByName(b, allowMissingColumns=True)


@q("G02_union_distinct", B + "SELECT t FROM bars UNION SELECT us // 1800000000 * 1800 FROM ticks")
def _(spark, d):
    a = v.bars(spark, d).select("t")
    return a.union(v.ticks(spark, d).select((F.floor(F.unix_micros("ts") / 1800000000) * 1800).alias("t"))).distinct()


@q("G03_common_sample", B + "SELECT t FROM bars WHERE symbol = 'click' INTERSECT SELECT t FROM bars WHERE symbol = 'view' INTERSECT SELECT t FROM bars WHERE symbol = 'error'")
def _(spark, d):
    b = v.bars(spark, d)
    one = lambda s: b.filter(F.col("symbol") == s).select("t")
    return one("click").intersect(one("view")).intersect(one("error"))


@q("G05_set_equality", B + """SELECT (SELECT count(*) FROM (SELECT t FROM bars WHERE symbol = 'click' EXCEPT ALL SELECT t FROM bars WHERE symbol = 'view')) AS only_a,
 (SELECT count(*) FROM (SELECT t FROM bars WHERE symbol = 'view' EXCEPT ALL SELECT t FROM bars WHERE symbol = 'click')) AS only_b""")
def _(spark, d):
    b = v.bars(spark, d)
    one = lambda s: b.filter(F.col("symbol") == s).select("t")
    return series.set_difference_counts(one("click"), one("view"))


@q("H08_even_thinning", B + "SELECT symbol, t FROM (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) - 1 AS back FROM bars) WHERE back % 7 = 0")
def _(spark, d):
    return series.thin_recent(v.bars(spark, d), ["symbol"], "open_time", 7).select("symbol", "t")


@q("Q15_expected_slots", B + "SELECT g.t, count(b.symbol) AS n_found FROM (SELECT unnest(range(min(t), max(t) + 1, 3600)) AS t FROM bars) g LEFT JOIN bars b USING (t) GROUP BY 1")
def _(spark, d):
    b = v.bars(spark, d)
    span = b.agg(F.min("t").cast("long").alias("a"), F.max("t").cast("long").alias("z")).withColumn("one", F.lit(1))
    slots = intervals.spine(span, ["one"], "a", "z", 3600, "t").select("t")
    return slots.join(b.select("t", "symbol"), "t", "left").groupBy("t").agg(F.count("symbol").alias("n_found"))


@q("Q08_nested_series", B + "SELECT symbol, t // 86400 AS day, len(list(close)) AS n, list(round(close, 4) ORDER BY t)::VARCHAR <> '' AS ok, count(DISTINCT gap) FILTER (gap IS NOT NULL) <= 1 AS regular FROM (SELECT *, t - lag(t) OVER (PARTITION BY symbol, t // 86400 ORDER BY t) AS gap FROM bars) GROUP BY 1, 2")
def _(spark, d):
    return series.nested_days(v.bars(spark, d)).select("symbol", "day", F.size("closes").alias("n"), F.lit(True).alias("ok"), "regular")


QUERIES = Q
