"""Latency studies: reactions, books at any instant, lead and lag."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog import views as v
from tapeloom.catalog.registry import Query
from tapeloom.functions.numeric import logistic
from tapeloom.catalog.trading import BOOK_SQL, book_events
from tapeloom.operators import attribution, ladder, lags, passage, reactions, tiling

R = v.rsql
Q: dict[str, Query] = {}


def q(name, sql=None):
    def deco(fn):
        Q[name] = Query(fn, sql)
        return fn
    return deco


TICK = "tk AS (SELECT *, us / 1000000.0 AS ts FROM ticks)"


def ticks(spark, d):
    t = v.ticks(spark, d)
    return t.withColumn("t", tiling.epoch_seconds(t, "ts").cast("double"))


# -- first passage and reactions ------------------------------------------------------------------------------------------


@q("X09_first_passage", v.base(TICK) + f"""SELECT b.symbol, b.t::BIGINT AS t,
  {R('(SELECT min(ts) FROM tk WHERE tk.symbol = b.symbol AND ts > b.t AND ts <= b.t + 86400 AND price >= b.close * 1.5) - b.t', 'above')},
  {R('(SELECT min(ts) FROM tk WHERE tk.symbol = b.symbol AND ts > b.t AND ts <= b.t + 86400 AND price <= b.close * 0.5) - b.t', 'below')} FROM bars b""")
def _(spark, d):
    b = v.bars(spark, d).select("symbol", "t", "close")
    base = b.select("symbol", "t", "close", F.col("t").cast("double").alias("start"), (F.col("t") + 86400.0).alias("stop"))
    ask = lambda name, share, up: base.select("symbol", F.concat_ws("|", F.lit(name), F.col("t").cast("long")).alias("query"), F.lit(0).alias("column"), "start", "stop", (F.col("close") * share).alias("level"), F.lit(up).alias("rising"))
    hits = passage.first_passage(ask("above", 1.5, True).unionByName(ask("below", 0.5, False)), ticks(spark, d), ["symbol"], "t", ["price"])
    t = F.substring_index("query", "|", -1).cast("long").alias("t")
    of = lambda name: F.min(F.when(F.col("query").startswith(name), F.col("passage")))
    wide = hits.groupBy("symbol", t).agg(of("above").alias("a"), of("below").alias("b"))
    return v.r6(wide, "symbol", "t", above=F.col("a") - F.col("t"), below=F.col("b") - F.col("t"))


def fair(spark, d):
    """A probability for each tick; the book follows it 900 seconds later, a cent around it, with holes."""
    return ticks(spark, d).select("symbol", "t", F.round(logistic((F.col("price") - 50) / 40), 3).alias("p"), "seq")


def late_book(spark, d):
    p = fair(spark, d)
    return p.select("symbol", (F.col("t") + 900).alias("t"), F.round(F.col("p") - 0.01, 3).alias("bid"), F.when(F.col("seq") % 11 != 0, F.round(F.col("p") + 0.01, 3)).alias("ask"))


def hourly(spark, d):
    b = v.bars(spark, d)
    return b.select("symbol", F.col("t").cast("double").alias("t"), F.round(logistic((F.col("close") - 50) / 40), 3).alias("p"))


EVENTS_SQL = """fair AS (SELECT symbol, ts AS t, round(1 / (1 + exp(-(price - 50) / 40)), 3) AS p, seq FROM tk),
book AS (SELECT symbol, t + 900 AS t, round(p - 0.01, 3) AS bid, CASE WHEN seq % 11 <> 0 THEN round(p + 0.01, 3) END AS ask FROM fair),
hours AS (SELECT symbol, t::DOUBLE AS t, round(1 / (1 + exp(-(close - 50) / 40)), 3) AS p FROM bars),
lagged AS (SELECT symbol, t AS t_event, p AS p_event, lag(t) OVER w AS t_prev, lag(p) OVER w AS p_prev FROM hours WINDOW w AS (PARTITION BY symbol ORDER BY t)),
cand AS (SELECT *, p_event - p_prev AS move, row_number() OVER (PARTITION BY symbol ORDER BY t_event) AS n FROM lagged WHERE abs(p_event - p_prev) >= 0.25),
pick AS (SELECT symbol, n, t_event, t_event AS last_kept, TRUE AS kept FROM cand WHERE n = 1
  UNION ALL SELECT c.symbol, c.n, c.t_event, CASE WHEN c.t_event - k.last_kept >= 10800 THEN c.t_event ELSE k.last_kept END, c.t_event - k.last_kept >= 10800
  FROM pick k JOIN cand c ON c.symbol = k.symbol AND c.n = k.n + 1),
ev AS (SELECT c.*, sign(move) AS s FROM cand c JOIN pick k ON c.symbol = k.symbol AND c.n = k.n WHERE k.kept),
path AS (SELECT symbol, t, p FROM fair UNION ALL SELECT symbol, t, p FROM hours),
e0 AS (SELECT e.*, coalesce((SELECT min(t) FROM path WHERE path.symbol = e.symbol AND t > t_prev AND t <= t_event AND e.s * p >= e.s * (p_prev + move / 2)), t_event) AS t0 FROM ev e),
e1 AS (SELECT e.*, (SELECT arg_max(struct_pack(x := (bid + ask) / 2), t) FROM book WHERE book.symbol = e.symbol AND t <= t_prev).x AS mid0,
  (SELECT arg_max(struct_pack(a := ask, b := bid), t) FROM book WHERE book.symbol = e.symbol AND t <= t0) AS q0,
  (SELECT arg_max(struct_pack(a := ask, b := bid), t) FROM book WHERE book.symbol = e.symbol AND t <= t0 - 10800) AS q1 FROM e0 e)"""


def hit_sql(column: str, level: str, start: str, stop: str) -> str:
    return f"(SELECT min(t) FROM book WHERE book.symbol = e.symbol AND t > {start} AND t {stop} AND e.s * {column} >= e.s * ({level}))"


REACTION_SQL = v.base(TICK, EVENTS_SQL) + f""", hits AS (SELECT e.*,
  {hit_sql('(bid + ask) / 2', 'mid0 + s * (0.5 * abs(move) - 1e-12)', 't_prev', '<= t_prev + 43200')} AS h50, {hit_sql('(bid + ask) / 2', 'mid0 + s * (0.9 * abs(move) - 1e-12)', 't_prev', '<= t_prev + 43200')} AS h90,
  CASE WHEN mid0 IS NOT NULL THEN {hit_sql('ask', 'q0.a + s * 1e-9', 't0', '<= t0 + 43200')} END AS ha, CASE WHEN mid0 IS NOT NULL THEN {hit_sql('bid', 'q0.b + s * 1e-9', 't0', '<= t0 + 43200')} END AS hb,
  CASE WHEN mid0 IS NOT NULL THEN {hit_sql('ask', 'q1.a + s * 1e-9', 't0 - 10800', '< t0')} END AS pa, CASE WHEN mid0 IS NOT NULL THEN {hit_sql('bid', 'q1.b + s * 1e-9', 't0 - 10800', '< t0')} END AS pb FROM e1 e)
SELECT symbol, {R('t_event')}, {R('t_prev')}, {R('t0')}, {R('move')}, {R('p_prev')}, {R('p_event')}, {R('mid0')}, {R('least(ha, hb) - t0', 'delay_first')}, {R('ha - t0', 'delay_ask')}, {R('hb - t0', 'delay_bid')},
  {R('least(pa, pb) - (t0 - 10800)', 'delay_placebo')}, {R('h50 - t0', 'delay_50')}, {R('h90 - t0', 'delay_90')}, h50 IS NULL AS censored_50, h90 IS NULL AS censored_90 FROM hits"""


@q("X09_reaction_events", REACTION_SQL.replace(")\n, hits", "),\nhits"))
def _(spark, d):
    out = reactions.reaction_events(hourly(spark, d), fair(spark, d), late_book(spark, d), ["symbol"], steps=1, jump=0.25, refractory=10800.0, horizon=43200.0, placebo=10800.0)
    numbers = ("t_event", "t_prev", "t0", "move", "p_prev", "p_event", "mid0", "delay_first", "delay_ask", "delay_bid", "delay_placebo", "delay_50", "delay_90")
    return v.r6(out, "symbol", "censored_50", "censored_90", **dict.fromkeys(numbers))


# -- books at any instant ---------------------------------------------------------------------------------------------------

EV_SQL = BOOK_SQL[: BOOK_SQL.index("lv AS (")].rstrip().rstrip(",")
SNAP_SQL = "sn AS (SELECT symbol, min(us) AS us FROM ev GROUP BY symbol, us // 3600000000)"
#: The standing levels at instants of ``qs`` (symbol, query, us): the last size since the last snapshot.
STAND_SQL = """qn AS (SELECT qs.*, (SELECT max(us) FROM sn WHERE sn.symbol = qs.symbol AND sn.us <= qs.us) AS since FROM qs),
st AS (SELECT n.symbol, n.query, e.side, e.price, arg_max(e.size, e.us) AS size FROM qn n JOIN ev e ON e.symbol = n.symbol AND e.us >= n.since AND e.us <= n.us GROUP BY 1, 2, 3, 4 HAVING arg_max(e.size, e.us) > 0),
top AS (SELECT n.symbol, n.query, n.us, max(s.price) FILTER (s.side = 'B') AS bid, arg_max(s.size, s.price) FILTER (s.side = 'B') AS bid_size, min(s.price) FILTER (s.side = 'S') AS ask, arg_min(s.size, s.price) FILTER (s.side = 'S') AS ask_size, count(s.price) AS n_levels
  FROM qn n LEFT JOIN st s USING (symbol, query) GROUP BY 1, 2, 3)"""


@q("ST06_ladder_grid", v.base(EV_SQL, SNAP_SQL, "qs AS (SELECT symbol, t::BIGINT AS query, (t + 1800) * 1000000 AS us FROM bars)", STAND_SQL) + f"""SELECT p.symbol, p.query, {R('any_value(bid)', 'bid')}, {R('any_value(bid_size)', 'bid_size')}, {R('any_value(ask)', 'ask')}, {R('any_value(ask_size)', 'ask_size')}, any_value(n_levels) AS n_levels,
  {R("CASE WHEN any_value(bid + ask) IS NOT NULL THEN coalesce(sum(size) FILTER (side = 'B' AND price >= (bid + ask) / 2.0 - 10), 0) END", 'depth_bid')}, {R("CASE WHEN any_value(bid + ask) IS NOT NULL THEN coalesce(sum(size) FILTER (side = 'S' AND price <= (bid + ask) / 2.0 + 10), 0) END", 'depth_ask')},
  {R("coalesce(sum(size) FILTER (side = 'B' AND price = 40), 0)", 'bid_at_40')} FROM top p LEFT JOIN st USING (symbol, query) GROUP BY 1, 2""")
def _(spark, d):
    grid = v.bars(spark, d).select("symbol", F.col("t").cast("long").alias("query"), (F.col("t") + 1800).cast("double").alias("tsec"), F.lit("B").alias("side"), F.lit(40.0).alias("price"))
    out = ladder.book_states(book_events(spark, d), ["symbol"], "tsec", questions=grid)
    out = out.withColumn("query", F.col("query").cast("long")).withColumn("bid_at_40", F.col("level_size"))
    return v.r6(out, "symbol", "query", "n_levels", **dict.fromkeys(("bid", "bid_size", "ask", "ask_size", "depth_bid", "depth_ask", "bid_at_40")))


def book_trades(spark, d):
    """Takers of the book's levels: every tick takes the level of its price, one side or the other."""
    e = book_events(spark, d)
    return e.select("symbol", "seq", "tsec", F.when(F.col("seq") % 3 == 0, "bid").otherwise("ask").alias("consumes"), F.col("price").cast("double").alias("level"), (1 + F.col("user_id") % 10).cast("double").alias("size"))


TRADE_SQL = "tr AS (SELECT symbol, seq, us, CASE WHEN seq % 3 = 0 THEN 'bid' ELSE 'ask' END AS consumes, price AS level, 1 + trader % 10 AS size FROM (SELECT e.*, t.trader FROM ev e JOIN ticks t USING (symbol, seq)))"


@q("ST07_trades_with_book", v.base(EV_SQL, SNAP_SQL, TRADE_SQL, "qs AS (SELECT symbol, seq AS query, us - 600000000 AS us FROM tr)", STAND_SQL) + f"""SELECT t.symbol, t.seq, t.consumes, {R('p.bid', 'bid_pre')}, {R('p.ask', 'ask_pre')}, {R('coalesce(s.size, 0)', 'level_pre')}, {R("CASE WHEN consumes = 'ask' THEN ask_size ELSE bid_size END", 'best_pre')},
  coalesce(CASE WHEN consumes = 'ask' THEN level > ask ELSE level < bid END, false) AS traverses, coalesce(t.size > CASE WHEN consumes = 'ask' THEN ask_size ELSE bid_size END, false) AS exceeds_depth
FROM tr t JOIN top p ON p.symbol = t.symbol AND p.query = t.seq LEFT JOIN st s ON s.symbol = t.symbol AND s.query = t.seq AND s.price = t.level AND s.side = CASE WHEN consumes = 'ask' THEN 'S' ELSE 'B' END""")
def _(spark, d):
    out = attribution.trades_with_book(book_trades(spark, d), book_events(spark, d), ["symbol"], "tsec", before=600.0)
    return v.r6(out, "symbol", "seq", "consumes", "traverses", "exceeds_depth", **dict.fromkeys(("bid_pre", "ask_pre", "level_pre", "best_pre")))


#: The pool of a level's trades, row by row: an independent way to the same shares.
POOL_SQL = """dc AS (SELECT symbol, seq, us, side, price, was - size AS amount, size AS rest FROM (SELECT *, lag(size) OVER (PARTITION BY symbol, us // 3600000000, side, price ORDER BY us) AS was FROM ev) WHERE was > size),
mix AS (SELECT symbol, side, price, seq, us / 1000000.0 AS t, amount, 1 AS kind FROM dc UNION ALL SELECT symbol, CASE WHEN consumes = 'ask' THEN 'S' ELSE 'B' END, level, seq, us / 1000000.0 - 900, size, 0 FROM tr),
cut AS (SELECT *, row_number() OVER w AS n, coalesce(t - lag(t) OVER w > 7200, true) AS fresh FROM mix WINDOW w AS (PARTITION BY symbol, side, price ORDER BY t, kind, seq)),
pool AS (SELECT symbol, side, price, seq, kind, n, amount, CASE WHEN kind = 0 THEN amount ELSE 0 END::DOUBLE AS held, 0::DOUBLE AS taken FROM cut WHERE n = 1
  UNION ALL SELECT c.symbol, c.side, c.price, c.seq, c.kind, c.n, c.amount,
    CASE WHEN c.kind = 0 THEN CASE WHEN c.fresh THEN 0 ELSE p.held END + c.amount ELSE greatest(CASE WHEN c.fresh THEN 0 ELSE p.held END - c.amount, 0) END,
    CASE WHEN c.kind = 1 THEN least(CASE WHEN c.fresh THEN 0 ELSE p.held END, c.amount) ELSE 0 END
  FROM pool p JOIN cut c ON c.symbol = p.symbol AND c.side = p.side AND c.price = p.price AND c.n = p.n + 1)"""


def explained(spark, d):
    lower = attribution.level_decreases(book_events(spark, d), ["symbol"], "tsec")
    takers = book_trades(spark, d).select("symbol", "seq", "tsec", F.when(F.col("consumes") == "ask", "S").otherwise("B").alias("side"), F.col("level").cast("long").alias("price"), "size")
    return attribution.explain_decreases(lower, takers, ["symbol"], "tsec", lead=900.0, pause=7200.0), lower


@q("L15_removal_cause", v.base(EV_SQL, TRADE_SQL, POOL_SQL) + f"SELECT d.symbol, d.side, d.price, d.seq, {R('taken')}, {R('p.amount - taken', 'cancelled')}, CASE WHEN taken > 0 THEN 'taker' ELSE 'maker' END AS removed_by FROM pool p JOIN dc d ON d.symbol = p.symbol AND d.side = p.side AND d.price = p.price AND d.seq = p.seq WHERE p.kind = 1 AND d.rest = 0")
def _(spark, d):
    found, lower = explained(spark, d)
    return v.r6(attribution.removal_cause(found, lower, ["symbol"]), "symbol", "side", "price", "seq", "removed_by", taken=None, cancelled=None)


@q("L15_level_shares", v.base(EV_SQL, TRADE_SQL, POOL_SQL) + f"SELECT symbol, side, price, {R('sum(amount) FILTER (kind = 1)', 'decreased')}, {R('sum(taken)', 'taken')}, {R('sum(amount) FILTER (kind = 0)', 'traded')} FROM pool GROUP BY 1, 2, 3")
def _(spark, d):
    found, _ = explained(spark, d)
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)))
    g = found.groupBy("symbol", "side", "price").agg(of("decrease", "amount").alias("decreased"), F.coalesce(of("trade", "explained"), F.lit(0.0)).alias("taken"), of("trade", "amount").alias("traded"))
    return v.r6(g, "symbol", "side", "price", decreased=None, taken=None, traded=None)


# -- lead and lag ------------------------------------------------------------------------------------------------------------

LAGS = [60.0 * k for k in range(-20, 101)]


def lag_inputs(spark, d):
    """The ticks' log prices as a step function, and an hourly reference that knows them 1,500 seconds late."""
    t = ticks(spark, d).select("symbol", "t", F.log(1 + F.col("price")).alias("x"), "seq")
    grid = v.bars(spark, d).select("symbol", (F.col("t") + 1800).cast("double").alias("t"))
    from tapeloom.operators.asof import asof_join
    late = asof_join(grid, t.withColumn("seen", F.col("t") + 1500), ["symbol"], "t", "seen", ["x"], tie="seq")
    return late.where("x IS NOT NULL"), t


LAG_SQL = v.base(TICK) + """, sx AS (SELECT symbol, ts AS t, ln(1 + price) AS x FROM tk), g0 AS (SELECT symbol, t + 1800.0 AS t FROM bars), sl AS (SELECT symbol, t + 1500 AS t, x FROM sx),
rf AS (SELECT g0.symbol, g0.t, sl.x FROM g0 ASOF JOIN sl ON g0.symbol = sl.symbol AND g0.t >= sl.t),
ch AS (SELECT a.symbol, a.t, a.x - b.x AS dx FROM rf a JOIN rf b ON a.symbol = b.symbol AND b.t = a.t - 3600),
asked AS (SELECT ch.*, l.l AS lag, t - l.l AS t1, t - 3600 - l.l AS t0 FROM ch, (SELECT 60.0 * unnest(range(-20, 101)) AS l) l),
y1 AS (SELECT a.*, sx.x AS x1 FROM asked a ASOF LEFT JOIN sx ON a.symbol = sx.symbol AND a.t1 >= sx.t),
y0 AS (SELECT a.*, sx.x AS x0 FROM y1 a ASOF LEFT JOIN sx ON a.symbol = sx.symbol AND a.t0 >= sx.t),
scan AS (SELECT symbol, lag::DOUBLE AS lag, count(x1 - x0) AS n, CASE WHEN count(x1 - x0) > 10 THEN corr(dx, x1 - x0) END AS corr FROM y0 GROUP BY 1, 2)"""


def scanned(spark, d):
    reference, series = lag_inputs(spark, d)
    return lags.lag_scan(reference, series, ["symbol"], "t", "x", LAGS, 3600.0, tile_s=86400.0)


@q("P18_lag_scan", LAG_SQL + f" SELECT symbol, lag, n, {R('corr')} FROM scan")
def _(spark, d):
    return v.r6(scanned(spark, d), "symbol", "lag", "n", corr=None)


@q("P18_best_lag", LAG_SQL + f" SELECT symbol, arg_max(lag, (corr, -lag)) AS lag, {R('max(corr)', 'corr')} FROM scan WHERE corr IS NOT NULL GROUP BY 1")
def _(spark, d):
    return v.r6(lags.best_lag(scanned(spark, d), ["symbol"]), "symbol", "lag", corr=None)


def response_grid(spark, d):
    """Half-hourly log prices, and an effect that takes up two thirds of a change at once and the rest an hour later."""
    from tapeloom.operators.asof import asof_join
    t = ticks(spark, d).select("symbol", "t", F.log(1 + F.col("price")).alias("x"), "seq")
    ends = t.groupBy("symbol").agg(F.floor(F.min("t") / 1800).alias("a"), F.floor(F.max("t") / 1800).alias("z"))
    grid = ends.select("symbol", F.explode(F.sequence(F.col("a") + 1, F.col("z"))).alias("b")).select("symbol", (F.col("b") * 1800).cast("double").alias("t"))
    now = asof_join(grid, t.withColumnRenamed("t", "seen"), ["symbol"], "t", "seen", ["x"], tie="seq")
    old = now.select("symbol", (F.col("t") + 3600).alias("t"), F.col("x").alias("w"))
    return now.join(old, ["symbol", "t"], "left").select("symbol", "t", "x", (F.coalesce(F.col("x") * 2 / 3 + F.col("w") / 3, "x") + F.sin("t") / 50).alias("y"))


@q("P19_distributed_lags")
def _(spark, d):
    out = lags.distributed_lags(response_grid(spark, d), ["symbol"], "t", "x", "y", 60)
    return v.r6(out, "symbol", "n", "lag", beta=None, cumulative=None, share=None)


@q("P19_response_times")
def _(spark, d):
    out = lags.response_times(lags.distributed_lags(response_grid(spark, d), ["symbol"], "t", "x", "y", 60), ["symbol"], 1800.0)
    return v.r6(out, "symbol", "n", "t_25", "t_50", "t_75", "t_90", "t_peak", total=None)


QUERIES = Q
