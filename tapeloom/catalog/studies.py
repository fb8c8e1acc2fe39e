"""Regimes, stacking and what follows from them, on the planted predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog import views as v
from tapeloom.catalog.registry import Query
from tapeloom.operators import covers, quantile
from tapeloom.plans import stacking
from tapeloom.sources import hourlog
from tapeloom.streaming import streams

R = v.rsql
Q: dict[str, Query] = {}


def q(name, sql=None):
    def deco(fn):
        Q[name] = Query(fn, sql)
        return fn
    return deco


#: Days before this one train.
SPLIT = 19738
AMP_SQL = f"""am AS (SELECT symbol, t, day, y, p, abs(ln(p / (1 - p))) AS x, day < {SPLIT} AS train, (p - y) * (p - y) AS brier FROM pred),
ed AS (SELECT symbol, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS e FROM am WHERE train GROUP BY 1),
cl AS (SELECT am.*, len([k FOR k IN e IF k <= x]) + 1 AS quintile FROM am LEFT JOIN ed USING (symbol))"""


def amplitudes(spark, d):
    """The size of a prediction's log odds stands for the regime."""
    p = v.predictions(spark, d)
    return p.select("symbol", "t", "day", "y", "p", F.abs(F.log(F.col("p") / (1 - F.col("p")))).alias("x"), (F.col("day") < SPLIT).alias("train"), ((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))


def classes(spark, d):
    return quantile.regime(amplitudes(spark, d), ["symbol"], "x", F.col("train"))


@q("X11_regime_quintiles", v.base(v.PRED_SQL, AMP_SQL) + f"SELECT symbol, quintile::INT AS quintile, train, count(*) AS n, {R('avg(y)', 'share_up')}, {R('avg(brier)', 'brier')} FROM cl GROUP BY ALL")
def _(spark, d):
    g = classes(spark, d).groupBy("symbol", "quintile", "train").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("share_up"), F.avg("brier").alias("brier"))
    return v.r6(g, "symbol", "quintile", "train", "n", share_up=None, brier=None)


@q("X11_extremes_gap", v.base(v.PRED_SQL, AMP_SQL) + f"""SELECT symbol, {R('avg(brier) FILTER (quintile = 5) - avg(brier) FILTER (quintile = 1)', 'gap')},
  {R('sqrt(var_samp(brier) FILTER (quintile = 5) / count(*) FILTER (quintile = 5) + var_samp(brier) FILTER (quintile = 1) / count(*) FILTER (quintile = 1))', 'se')} FROM cl WHERE NOT train GROUP BY 1""")
def _(spark, d):
    return v.r6(quantile.extremes_gap(classes(spark, d).where(~F.col("train")), ["symbol"], "quintile", "brier"), "symbol", gap=None, se=None)


@q("X11_train_ecdf", v.base(v.PRED_SQL, AMP_SQL) + f"SELECT symbol, t, {R('(SELECT avg((o.x <= am.x)::INT) FROM am o WHERE o.symbol = am.symbol AND o.train)', 'ecdf')} FROM am WHERE NOT train")
def _(spark, d):
    out = quantile.train_distribution(amplitudes(spark, d), ["symbol"], "x", F.col("train"))
    return v.r6(out.where(~F.col("train")), "symbol", "t", ecdf=None)


def stack_rows(spark, d):
    """Two forecasts of each bar; the hour of the day stands for the instant."""
    return v.predictions(spark, d).withColumn("instant", (F.floor(F.col("t") / 3600) % 4).cast("int"))


def stacked(spark, d):
    return stacking.stacking(stack_rows(spark, d), ["symbol", "instant"], ["p", "p2"], "y", F.col("day") < SPLIT)


@q("K07_stacking_fits", v.base(v.PRED_SQL) + f"SELECT symbol, (t // 3600 % 4)::INT AS instant, count(*) AS n, 0.0::DOUBLE AS gradient FROM pred WHERE day < {SPLIT} GROUP BY 1, 2 HAVING count(*) >= 20 AND min(y) < max(y)")
def _(spark, d):
    fits, _ = stacked(spark, d)
    return v.r6(fits.where("gradient IS NOT NULL"), "symbol", "instant", "n", gradient=None)


@q("K07_stacked_losses")
def _(spark, d):
    _, test = stacked(spark, d)
    sq = lambda c: F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y")))
    g = test.groupBy("symbol", "instant").agg(F.count(F.lit(1)).alias("n"), sq("p_stack").alias("brier_stack"), sq("p").alias("brier_model"), sq("p2").alias("brier_market"))
    return v.r6(g, "symbol", "instant", "n", brier_stack=None, brier_model=None, brier_market=None)


@q("K07_gap_slope", v.base(v.PRED_SQL) + f"SELECT (t // 3600 % 4)::INT AS instant, count(*) AS n, {R('sum((p - p2) * (y - p2)) / sum((p - p2) * (p - p2))', 'slope')} FROM pred WHERE day >= {SPLIT} GROUP BY 1")
def _(spark, d):
    return v.r6(stacking.gap_slope(stack_rows(spark, d).where(F.col("day") >= SPLIT), ["instant"], "p", "p2", "y"), "instant", "n", slope=None)


# -- linked markets: covers of three outcomes -----------------------------------------------------------------------------------

#: Covers of the two books: vertex, token, weight.
VERTICES = [(1, "click", 1.0), (1, "view", 1.0), (2, "error", 1.0), (2, "click", 1.0), (3, "view", 1.0), (3, "purchase", 0.5), (3, "error", 0.5)]

COVER_SQL = f"""vx(vertex, token, weight) AS (VALUES {', '.join(f"({n}, '{t}', {w})" for n, t, w in VERTICES)}), bk AS (SELECT unnest([0, 1]) AS book),
ak AS (SELECT seq % 2 AS book, symbol AS token, us / 1000000.0 AS t, CASE WHEN seq % 13 <> 0 THEN round(least(0.99, greatest(0.01, price / 150)), 3) END AS ask FROM ticks),
legs AS (SELECT vertex, count(*) AS k FROM vx GROUP BY 1), inst AS (SELECT DISTINCT book, t FROM ak),
st AS (SELECT i.book, i.t, x.vertex, x.weight, a.ask FROM (SELECT inst.*, vx.* FROM inst, vx) i JOIN vx x ON x.vertex = i.vertex AND x.token = i.token ASOF LEFT JOIN ak a ON a.book = i.book AND a.token = i.token AND i.t >= a.t),
vc AS (SELECT book, t, vertex, sum(weight * ask) AS cost, count(ask) AS n FROM st GROUP BY 1, 2, 3),
mn AS (SELECT i.book, i.t, min(struct_pack(cost := round(cost, 9), vertex := vertex)) FILTER (n = k) AS m FROM inst i LEFT JOIN vc USING (book, t) LEFT JOIN legs USING (vertex) GROUP BY 1, 2),
sp AS (SELECT book, t, lead(t) OVER (PARTITION BY book ORDER BY t) AS until, m.vertex AS vertex, m.cost AS cost, 1 - m.cost AS margin FROM mn)"""


def cover_spans(spark, d):
    t = v.ticks(spark, d)
    asks = t.select((F.col("seq") % 2).cast("int").alias("book"), F.col("symbol").alias("token"), (F.unix_micros("ts") / 1000000).alias("t"), "seq", F.when(F.col("seq") % 13 != 0, F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("price") / 150)), 3)).alias("ask"))
    vertices = spark.createDataFrame([(b, *x) for b in (0, 1) for x in VERTICES], "book int, vertex int, token string, weight double")
    return covers.cover_margins(asks, vertices, ["book"], "t")


@q("L18_cover_margins", v.with_(v.TICKS_SQL, COVER_SQL) + f"SELECT book::INT AS book, {R('t')}, {R('until')}, vertex, {R('cost')}, {R('margin')} FROM sp")
def _(spark, d):
    return v.r6(cover_spans(spark, d), "book", "vertex", t=None, until=None, cost=None, margin=None)


@q("D32_time_histogram", v.with_(v.TICKS_SQL, COVER_SQL) + f"""SELECT book::INT AS book, h.h AS hour, floor(round(margin / 0.1, 6))::BIGINT AS bin, {R('sum(least(until, (h.h + 1) * 3600) - greatest(t, h.h * 3600))', 'seconds')}
FROM sp, LATERAL (SELECT unnest(range(floor(t / 3600)::BIGINT, ceil(until / 3600)::BIGINT)) AS h) h WHERE until > t GROUP BY 1, 2, 3""")
def _(spark, d):
    return v.r6(covers.time_histogram(cover_spans(spark, d), ["book"], "margin", 0.1), "book", "hour", "bin", seconds=None)


EPISODE_SQL = """, on_ AS (SELECT *, coalesce(margin >= 0.2, false) AS up FROM sp), rn AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY t) - row_number() OVER (PARTITION BY book, up ORDER BY t) AS run FROM on_),
ep AS (SELECT book, min(t) AS start, max(until) AS "end", max(margin) AS best FROM rn WHERE up GROUP BY book, run HAVING count(*) = count(until))"""


@q("L18_cover_episodes", v.with_(v.TICKS_SQL, COVER_SQL) + EPISODE_SQL + f"""SELECT book::INT AS book, {R('start')}, {R('"end"', '"end"')}, {R('best')} FROM ep""")
def _(spark, d):
    return v.r6(covers.episodes(cover_spans(spark, d), ["book"], F.col("margin") >= 0.2), "book", start=None, end=None, best=None)


@q("L18_episode_survival", v.with_(v.TICKS_SQL, COVER_SQL) + EPISODE_SQL + f"""SELECT book::INT AS book, l.l AS latency, count(*) AS n, {R('avg(("end" - start >= l.l)::INT)', 'share')} FROM ep, (SELECT unnest([0.0::DOUBLE, 60.0, 600.0, 3600.0]) AS l) l GROUP BY 1, 2""")
def _(spark, d):
    found = covers.episodes(cover_spans(spark, d), ["book"], F.col("margin") >= 0.2)
    return v.r6(covers.survival(found, ["book"], [0.0, 60.0, 600.0, 3600.0]), "book", "latency", "n", share=None)


# -- logs in hour files, written from the ticks and read back ------------------------------------------------------------------

NANO = 1_000_000_000
FROM, TO = 1_704_499_200, 1_704_931_200  # 2024-01-06 to 2024-01-11


def raw_log(spark, d):
    """The ticks as raw messages: a snapshot for every 50th, else a level change; every third also a trade in the same line."""
    t = v.ticks(spark, d)
    level = F.struct((F.floor("price") % 100 / 100).cast("string").alias("price"), F.col("size").cast("string").alias("size"))
    stamp = F.floor(F.unix_micros("ts") / 1000).cast("string").alias("timestamp")
    book = F.to_json(F.struct(F.lit("book").alias("event_type"), F.col("symbol").alias("asset_id"), stamp, F.array(level).alias("bids")))
    change = F.to_json(F.struct(F.lit("price_change").alias("event_type"), stamp, F.array(F.struct(F.col("symbol").alias("asset_id"), level["price"].alias("price"), level["size"].alias("size"), F.when(F.col("trader") % 2 == 0, "BUY").otherwise("SELL").alias("side"))).alias("price_changes")))
    trade = F.to_json(F.struct(F.lit("last_trade_price").alias("event_type"), F.col("symbol").alias("asset_id"), stamp, F.col("price").cast("string").alias("price"), F.col("size").alias("size")))
    first = F.when(F.col("seq") % 50 == 0, book).otherwise(change)
    return t.select((F.unix_micros("ts") * 1000).alias("rx"), F.when(F.col("seq") % 3 == 0, F.concat(F.lit("["), first, F.lit(","), trade, F.lit("]"))).otherwise(first).alias("msg"))


def read_log(spark, d):
    folder = f"{streams.scratch(spark)}/log"
    hourlog.write_hour_log(raw_log(spark, d), folder, "book").write.format("noop").mode("overwrite").save()
    assets = v.ticks(spark, d).select(F.col("symbol").alias("asset_id")).distinct().where("asset_id <> 'error'").withColumn("asset", F.col("asset_id"))
    return hourlog.hour_log(spark, folder, "book", start=FROM * NANO, end=TO * NANO), assets


SPAN = f"us >= {FROM * 1000000} AND us < {TO * 1000000} AND symbol <> 'error'"


@q("A10_raw_levels", v.with_(v.TICKS_SQL) + f"SELECT us * 1000 AS rx, us // 1000 AS ts, symbol AS asset, seq % 50 = 0 AS is_snapshot, CASE WHEN seq % 50 = 0 OR trader % 2 = 0 THEN 'B' ELSE 'S' END AS side, {R('floor(price) % 100 / 100', 'price')}, size::DOUBLE AS size FROM ticks WHERE {SPAN}")
def _(spark, d):
    log, assets = read_log(spark, d)
    return v.r6(hourlog.level_events(log, assets), "rx", "ts", "asset", "is_snapshot", "side", "size", price=None)


@q("A16_hour_log", v.with_(v.TICKS_SQL) + f"SELECT symbol AS asset, us // 86400000000 AS day, count(*) AS n, {R('sum(price)', 'price')}, sum(size)::DOUBLE AS size FROM ticks WHERE seq % 3 = 0 AND {SPAN} GROUP BY 1, 2")
def _(spark, d):
    log, assets = read_log(spark, d)
    trades = hourlog.other_events(log, assets).where("kind = 'trade'")
    g = trades.groupBy("asset", F.expr(f"rx div {86400 * NANO}").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"), F.sum("size").alias("size"))
    return v.r6(g, "asset", "day", "n", "size", price=None)


QUERIES = Q
