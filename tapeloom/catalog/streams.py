"""Streaming queries, run to completion over the files at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog import views as v
from tapeloom.catalog.registry import Query
from tapeloom.functions.numeric import logistic
from tapeloom.streaming import state, streams

R = v.rsql
Q: dict[str, Query] = {}


def q(name, sql=None):
    def deco(fn):
        Q[name] = Query(fn, sql)
        return fn
    return deco


B = v.base()
EDGE = "(SELECT max(us) // 1000 FROM ticks)"


@q("ST01_streaming_bars", B + f"SELECT symbol, t, {R('open')}, {R('high')}, {R('low')}, {R('close')}, volume::BIGINT AS volume FROM bars WHERE (t + 3600) * 1000 <= {EDGE} - 600000")
def _(spark, d):
    out = streams.run_available(streams.streaming_bars(streams.tick_stream(spark, d), "1 hour", "10 minutes"))
    return v.r6(out, "symbol", "t", "volume", open=None, high=None, low=None, close=None)


@q("ST14_streaming_sessions", v.with_(v.TICKS_SQL) + f""", s AS (SELECT symbol, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM (
SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w >= 1200000000 THEN 1 ELSE 0 END AS new FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY us))) GROUP BY symbol, run) SELECT symbol, first_us, n FROM s WHERE (last_us + 1200000000) <= ({EDGE} - 600000) * 1000""")
def _(spark, d):
    return streams.run_available(streams.streaming_sessions(streams.tick_stream(spark, d), "20 minutes", "10 minutes"))


@q("ST09_duplicate_events", v.with_(v.TICKS_SQL) + "SELECT symbol, count(*) AS n FROM ticks GROUP BY 1")
def _(spark, d):
    t = streams.tick_stream(spark, d)
    twice = t.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return streams.run_available(streams.deduplicated(twice, ["symbol", "seq"], "10 minutes")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@q("ST10_streaming_cooldown", """WITH RECURSIVE ev AS (SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) / 1000000.0 AS t FROM events),
k AS (SELECT symbol, min(t) AS t FROM ev GROUP BY 1 UNION ALL SELECT symbol, t FROM (SELECT k.symbol, min(ev.t) AS t FROM k JOIN ev ON ev.symbol = k.symbol AND ev.t - k.t >= 5400 GROUP BY 1))
SELECT ev.symbol, seq FROM ev JOIN k USING (symbol, t)""")
def _(spark, d):
    return streams.run_available(streams.streaming_cooldown(streams.tick_stream(spark, d), 5400.0, "10 minutes")).select("symbol", "seq")


@q("ST03_streaming_variance", v.with_(v.TICKS_SQL) + f""", r AS (SELECT symbol, seq, us, (ln(price) - ln(lag(price) OVER (PARTITION BY symbol ORDER BY us))) ** 2 AS sq FROM ticks)
SELECT symbol, seq, {R('list_reduce(list_filter(list(sq) OVER w, lambda e: e IS NOT NULL), lambda y, e: y + 0.05::DOUBLE * (e - y))', 'var')}, count(sq) OVER w AS n FROM r WHERE true QUALIFY n > 0 WINDOW w AS (PARTITION BY symbol ORDER BY us ROWS UNBOUNDED PRECEDING)""".replace(" WHERE true QUALIFY n > 0 WINDOW w AS (PARTITION BY symbol ORDER BY us ROWS UNBOUNDED PRECEDING)", " WINDOW w AS (PARTITION BY symbol ORDER BY us ROWS UNBOUNDED PRECEDING) QUALIFY count(sq) OVER w > 0"))
def _(spark, d):
    out = streams.run_available(streams.streaming_ewma_variance(streams.tick_stream(spark, d), 0.05, "10 minutes"))
    return v.r6(out.filter(F.col("n") > 0), "symbol", "seq", "n", var=None)


@q("ST13_transport_delay", v.with_(v.TICKS_SQL) + f"SELECT symbol, us // 3600000000 * 3600 AS t, count(*) AS n, {R('max(size * 0.01)', 'worst')} FROM ticks GROUP BY 1, 2 HAVING (us // 3600000000 * 3600 + 3600) * 1000 <= {EDGE} - 600000".replace("HAVING (us // 3600000000 * 3600 + 3600)", "HAVING (any_value(us // 3600000000) * 3600 + 3600)"))
def _(spark, d):
    t = streams.tick_stream(spark, d).withColumn("delay", F.col("size") * 0.01)
    return v.r6(streams.run_available(streams.transport_delay(t, "1 hour", "10 minutes")), "symbol", "t", "n", worst=None)


# -- state and timers: rows are applied once the watermark has passed them ------------------------------------------------------

PASSED = f"us <= ({EDGE} - 600000) * 1000"


@q("ST02_price_buffer", v.with_(v.TICKS_SQL) + f"""SELECT symbol, seq, us, count(*) OVER w AS held, {R('first_value(price) OVER w', 'oldest')}, {R('avg(price) OVER w', 'mean')} FROM ticks WHERE {PASSED}
WINDOW w AS (PARTITION BY symbol ORDER BY us RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return v.r6(streams.run_available(state.price_buffer(streams.tick_stream(spark, d), ["symbol"], 7200.0, "10 minutes")), "symbol", "seq", "us", "held", oldest=None, mean=None)


@q("ST15_liveness", v.with_(v.TICKS_SQL) + f""", g AS (SELECT symbol, us AS since, lead(us) OVER (PARTITION BY symbol ORDER BY us) AS nxt FROM ticks WHERE {PASSED})
SELECT symbol, since, since + 3600000000 AS silent_at, back.b AS back_at FROM g, LATERAL (SELECT unnest([NULL, nxt]) AS b) back WHERE (nxt - since > 3600000000) OR (nxt IS NULL AND b IS NULL AND (since + 3600000001 + 999) // 1000 <= {EDGE} - 600000) QUALIFY row_number() OVER (PARTITION BY symbol, since, b) = 1""")
def _(spark, d):
    return streams.run_available(state.liveness(streams.tick_stream(spark, d), ["symbol"], 3600.0, "10 minutes"))


@q("ST04_live_signal", v.with_(v.TICKS_SQL) + f""", pr AS (SELECT symbol, us, round(1 / (1 + exp(-(price - 50) / 40)), 3) AS p, seq FROM ticks), lf AS (SELECT * FROM pr WHERE seq % 2 = 0 AND {PASSED}),
bk AS (SELECT symbol, us AS bus, greatest(round(p - 0.02, 3), 0.01) AS bid, least(round(p + 0.02, 3), 0.99) AS ask FROM pr WHERE seq % 2 = 1),
j AS (SELECT lf.*, bid, ask, (us - bus) / 1000000.0 AS age_s FROM lf ASOF LEFT JOIN bk ON lf.symbol = bk.symbol AND lf.us >= bk.bus),
e AS (SELECT *, p - ask - 0.07::DOUBLE * ask * (1 - ask) AS ev_up, 1 - p - round(1 - bid, 3) - 0.07::DOUBLE * round(1 - bid, 3) * (1 - round(1 - bid, 3)) AS ev_down FROM j)
SELECT symbol, us, {R('p')}, {R('bid')}, {R('ask')}, {R('age_s')}, {R('ev_up')}, {R('ev_down')}, CASE WHEN age_s <= 1200 AND greatest(ev_up, ev_down) > 0.05 THEN CASE WHEN ev_up >= ev_down THEN 'up' ELSE 'down' END ELSE 'none' END AS decision FROM e""")
def _(spark, d):
    p = streams.tick_stream(spark, d).select("symbol", "ts", "seq", F.round(logistic((F.col("price") - 50) / 40), 3).alias("p"))
    books = p.where("seq % 2 = 1").select("symbol", "ts", "seq", F.greatest(F.round(F.col("p") - 0.02, 3), F.lit(0.01)).alias("bid"), F.least(F.round(F.col("p") + 0.02, 3), F.lit(0.99)).alias("ask"))
    out = streams.run_available(state.live_signal(p.where("seq % 2 = 0"), books, ["symbol"], "10 minutes", margin=0.05, stale_s=1200.0))
    return v.r6(out, "symbol", "us", "decision", p=None, bid=None, ask=None, age_s=None, ev_up=None, ev_down=None)


QUERIES = Q
