"""Order books, resting orders, rule P&L, latency and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog import views as v
from tapeloom.catalog.registry import Query
from tapeloom.functions import prob
from tapeloom.operators import book, orders, stats, tapes

R = v.rsql
Q: dict[str, Query] = {}


def q(name, sql=None):
    def deco(fn):
        Q[name] = Query(fn, sql)
        return fn
    return deco


def book_events(spark, d):
    """Level changes: price level from the value, size from the JSON column, a snapshot at the first event of an hour."""
    from pyspark.sql import Window
    e = v.table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        (F.floor("value") % 100).alias("price"), F.from_json("props", "k INT").getField("k").cast("double").alias("k"), "user_id")
    hour = F.floor(F.col("us") / 3600000000)
    first = F.row_number().over(Window.partitionBy("symbol", hour).orderBy("us")) == 1
    return e.withColumn("is_snapshot", first).withColumn("side", F.when(F.col("user_id") % 2 == 0, "B").otherwise("S")).withColumn(
        "size", F.when(F.col("k") % 7 == 0, 0.0).otherwise(F.col("k"))).withColumn("tsec", F.col("us") / 1000000)


BOOK_SQL = """ev AS (SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) AS us, (floor(value)::BIGINT) % 100 AS price, CASE WHEN user_id % 2 = 0 THEN 'B' ELSE 'S' END AS side,
  CASE WHEN (props->>'k')::INT % 7 = 0 THEN 0 ELSE (props->>'k')::DOUBLE END AS size FROM events),
lv AS (SELECT a.symbol, a.seq, b.side, b.price, arg_max(b.size, b.us) AS size FROM ev a JOIN ev b ON a.symbol = b.symbol AND a.us // 3600000000 = b.us // 3600000000 AND b.us <= a.us GROUP BY 1, 2, 3, 4 HAVING arg_max(b.size, b.us) > 0),
bbo AS (SELECT e.symbol, e.seq, e.us, max(l.price) FILTER (l.side = 'B') AS bid, arg_max(l.size, l.price) FILTER (l.side = 'B') AS bid_size, min(l.price) FILTER (l.side = 'S') AS ask, arg_min(l.size, l.price) FILTER (l.side = 'S') AS ask_size, count(l.price) AS n_levels
  FROM ev e LEFT JOIN lv l USING (symbol, seq) GROUP BY 1, 2, 3)"""


def bbo(spark, d):
    return book.best_levels(book_events(spark, d), ["symbol"], "tsec")


@q("ST05_book_replay", v.with_(BOOK_SQL) + f"SELECT symbol, seq, {R('bid')}, {R('bid_size')}, {R('ask')}, {R('ask_size')}, n_levels FROM bbo")
def _(spark, d):
    return v.r6(bbo(spark, d), "symbol", "seq", "n_levels", bid=None, bid_size=None, ask=None, ask_size=None)


@q("L14_depth_walk", v.with_(v.TICKS_SQL) + f"""SELECT symbol, h, {R('sum(take)', 'filled')}, {R('sum(take * price) / nullif(sum(take), 0)', 'vwap')} FROM (SELECT *, least(size, greatest(30 - coalesce(sum(size) OVER (PARTITION BY symbol, h ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS take FROM (
 SELECT symbol, us // 21600000000 AS h, price, sum(size)::DOUBLE AS size FROM ticks GROUP BY 1, 2, 3)) GROUP BY 1, 2""")
def _(spark, d):
    lv = v.ticks(spark, d).groupBy("symbol", F.floor(F.unix_micros("ts") / 21600000000).alias("h"), "price").agg(F.sum("size").cast("double").alias("size"))
    return v.r6(book.depth_walk(lv, ["symbol", "h"], 30.0), "symbol", "h", filled=None, vwap=None)


@q("F18_consumed_level", v.with_(v.TAPE_SQL) + "SELECT tx, seq, CASE WHEN (outcome = 'Up') = (side = 'BUY') THEN 'ask' ELSE 'bid' END AS book_side, CASE WHEN outcome = 'Up' THEN price ELSE round(1 - price, 3) END AS level FROM tape")
def _(spark, d):
    side, level = book.consumed_level(F.when(F.col("outcome") == "Up", 0).otherwise(1), F.col("side"), F.col("price"))
    return v.tape(spark, d).select("tx", "seq", side.alias("book_side"), level.alias("level"))


# -- resting orders on the tape ------------------------------------------------------------------------------------------------

SPAN = 86400 * 90
BACK = 86400 * 30
ORD_SQL = f"""tk AS (SELECT condition, bid, ts AS t, seq, size, CASE WHEN side = 'SELL' AND outcome = bid THEN price WHEN side = 'BUY' AND outcome <> bid THEN 1 - price END AS cp,
  CASE WHEN side = 'BUY' AND outcome = bid THEN price WHEN side = 'SELL' AND outcome <> bid THEN 1 - price END AS ap FROM tape, (SELECT unnest(['Up', 'Down']) AS bid) WHERE role = 'taker'),
od0 AS (SELECT condition, k.bid, seq * 10 + k.k AS order_id, ts AS t_place, ts + {SPAN} AS t_cancel, k.lv AS level, 20.0 AS q_ahead, 5.0 AS size, resolved_up = (k.bid = 'Up') AS won
  FROM trades, (SELECT unnest([1, 2, 3, 4]) AS k, unnest([0.35, 0.55, 0.35, 0.55]) AS lv, unnest(['Up', 'Up', 'Down', 'Down']) AS bid) k WHERE role = 'maker'),
od AS (SELECT o.*, EXISTS (SELECT 1 FROM tk WHERE tk.condition = o.condition AND tk.bid = o.bid AND tk.ap <= o.level + 1e-9 AND tk.t >= o.t_place + 3600 - {BACK} AND tk.t < o.t_place + 3600) AS crossing FROM od0 o),
lo AS (SELECT od.order_id, tk.t, tk.seq, tk.cp, od.level, od.q_ahead, od.size AS need, sum(CASE WHEN tk.cp <= od.level + 1e-9 THEN tk.size ELSE 0 END) OVER (PARTITION BY od.order_id ORDER BY tk.t, tk.seq ROWS UNBOUNDED PRECEDING) AS cum
  FROM od JOIN tk ON tk.condition = od.condition AND tk.bid = od.bid AND tk.cp IS NOT NULL AND tk.t >= od.t_place + 3600 AND tk.t < od.t_cancel + 3600 WHERE NOT crossing),
fl AS (SELECT order_id, min(CASE WHEN cp < level - 1e-9 THEN (t, seq, cum) END) AS b, min(CASE WHEN cum >= q_ahead + need - 1e-9 THEN (t, seq, cum) END) AS qq, max(cum) AS whole FROM lo GROUP BY 1),
fills AS (SELECT od.*, CASE WHEN b IS NOT NULL AND (qq IS NULL OR b <= qq) THEN b[1] ELSE qq[1] END AS t_fill, CASE WHEN b IS NOT NULL AND (qq IS NULL OR b <= qq) THEN 'traversal' WHEN qq IS NOT NULL THEN 'queue' END AS reason,
  CASE WHEN NOT crossing THEN coalesce(CASE WHEN b IS NOT NULL AND (qq IS NULL OR b <= qq) THEN b[3] ELSE qq[3] END, whole, 0) END AS consumed FROM od LEFT JOIN fl USING (order_id))"""


GRID = ((1, 0.35, "Up"), (2, 0.55, "Up"), (3, 0.35, "Down"), (4, 0.55, "Down"))


def order_inputs(spark, d, won=False):
    """Maker rows, taker trades, and how each becomes one bid per side and level, and the trade as each side's bids see it."""
    from tapeloom.operators.ledger import attach_market_info
    t = v.tape(spark, d)
    makers = t.filter(F.col("role") == "maker")
    makers = (attach_market_info(makers, v.tape_markets(spark, d)) if won else makers).select("condition", "seq", F.col("ts").alias("t_place"), *(["resolved_up"] if won else []))
    takers = t.filter(F.col("role") == "taker").select("condition", F.col("ts").alias("t"), "seq", "size", "price", (F.col("outcome") == "Up").alias("up"), (F.col("side") == "SELL").alias("sells"))
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(lv).alias("level"), F.lit(bid).alias("bid")) for k, lv, bid in GRID])

    def spread(o):
        extra = [(F.col("resolved_up") == (F.col("bid") == "Up")).alias("won")] if won else []
        return o.select("*", F.inline(grid)).select("condition", "bid", "_c", "level", (F.col("seq") * 10 + F.col("k")).alias("order_id"), "t_place",
                                                    (F.col("t_place") + SPAN).alias("t_cancel"), F.lit(20.0).alias("q_ahead"), F.lit(5.0).alias("size"), *extra)

    def see(x):
        own = F.col("up") == (F.col("bid") == "Up")
        seen = lambda same: F.when(same & own, F.col("price")).when(~same & ~own, 1 - F.col("price"))
        return x.withColumn("bid", F.explode(F.array(F.lit("Up"), F.lit("Down")))).select("condition", "bid", "_c", "t", "seq", "size", seen(F.col("sells")).alias("cp"), seen(~F.col("sells")).alias("ap"))

    return makers, takers, {"market": ["condition"], "levels": sorted({lv for _, lv, _ in GRID}), "spread": spread, "see": see}


def fills(spark, d, won=False, consumed=False):
    makers, takers, how = order_inputs(spark, d, won)
    return orders.resting_fills(makers, takers, ["condition", "bid"], delay=3600, lookback=BACK, life=SPAN, consumed=consumed, **how)


O = v.with_(v.TAPE_SQL, ORD_SQL)


@q("L05_resting_fills", O + f"SELECT order_id, t_fill, reason, {R('consumed')}, t_fill IS NOT NULL AS executed FROM fills")
def _(spark, d):
    return v.r6(fills(spark, d, consumed=True), "order_id", "t_fill", "reason", "executed", consumed=None)


@q("L06_crossing", O + "SELECT order_id, crossing FROM od")
def _(spark, d):
    makers, takers, how = order_inputs(spark, d)
    return orders.crossing(makers, takers, ["condition", "bid"], delay=3600, lookback=BACK, **how).select("order_id", "crossing")


@q("L10_cancel_expansion", O + "SELECT order_id, c.c AS cancel, coalesce(t_fill < t_place + c.c + 3600, false) AS executed FROM fills, (SELECT unnest([86400.0::DOUBLE, 2592000.0::DOUBLE]) AS c) c")
def _(spark, d):
    return orders.expand_cancels(fills(spark, d), [86400, 2592000], 3600).select("order_id", "cancel", "executed")


SCORED = O + """, sc0 AS (SELECT *, t_fill IS NOT NULL AS executed, CASE WHEN t_fill IS NOT NULL THEN 0.2 * 0.07 * level * (1 - level) * size ELSE 0 END AS raw FROM fills WHERE won IS NOT NULL),
sc AS (SELECT *, raw * CASE WHEN sum(raw) OVER m > 0.05 THEN 0.05 / sum(raw) OVER m ELSE 1 END AS rebate FROM sc0 WINDOW m AS (PARTITION BY condition)),
scored AS (SELECT *, CASE WHEN executed THEN (won::INT - level) * size ELSE 0 END + rebate AS pnl FROM sc)"""


def settled(spark, d):
    return fills(spark, d, won=True).filter(F.col("won").isNotNull())


def scored(spark, d):
    f = settled(spark, d).withColumn("rebate_cap", F.lit(0.05))
    return orders.score_orders(f, "condition", rebate_rate=0.2, fee_rate=0.07)


@q("L09_order_scores", SCORED + f"SELECT order_id, executed, {R('rebate')}, {R('pnl')} FROM scored")
def _(spark, d):
    return v.r6(scored(spark, d), "order_id", "executed", rebate=None, pnl=None)


@q("D24_order_summary", SCORED + f"""SELECT {R('level')}, count(*) AS n_placed, {R('avg(executed::INT)', 'fill_rate')}, {R("avg(coalesce(executed AND reason = 'traversal', false)::INT)", 'share_traversal')}, {R('quantile_cont(t_fill - t_place, 0.5) FILTER (executed)', 'delay_p50')}, {R('avg(pnl)', 'pnl_per_placed')}, {R('avg(pnl) FILTER (executed)', 'pnl_per_executed')} FROM scored GROUP BY scored.level""")
def _(spark, d):
    return v.r6(orders.order_summary(scored(spark, d), ["level"], settled(spark, d)), "n_placed", level=None, fill_rate=None, share_traversal=None, delay_p50=None, pnl_per_placed=None, pnl_per_executed=None)


@q("D25_pair_summary", SCORED + "SELECT count(*) AS n_pairs, count(*) FILTER (k = 2) AS both, count(*) FILTER (k = 1) AS one, count(*) FILTER (k = 0) AS none FROM (SELECT sum(executed::INT) AS k FROM scored GROUP BY order_id // 10, level HAVING count(*) = 2)")
def _(spark, d):
    # whole division: the ids of large tables are beyond the whole numbers of a double
    return orders.pair_summary(settled(spark, d).withColumn("p", F.expr("order_id div 10")), ["p", "level"])


# -- rules on predictions --------------------------------------------------------------------------------------------------------

P = v.base(v.PRED_SQL)


@q("L12_cooldown", """WITH RECURSIVE ev AS (SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) / 1000000.0 AS t FROM events WHERE event_type IN ('click', 'view', 'error', 'signup', 'purchase')),
k AS (SELECT symbol, min(t) AS t FROM ev GROUP BY 1 UNION ALL SELECT symbol, t FROM (SELECT k.symbol, min(ev.t) AS t FROM k JOIN ev ON ev.symbol = k.symbol AND ev.t >= k.t + 5400 GROUP BY 1))
SELECT ev.symbol, seq FROM ev JOIN k USING (symbol, t)""")
def _(spark, d):
    e = v.ticks(spark, d).select("symbol", "seq", (F.unix_micros("ts") / 1000000).alias("t"))
    return orders.cooldown(e, ["symbol"], "t", 5400.0).filter("kept").select("symbol", "seq")


RULE = "greatest(p - 0.57, 0.43 - p)"
RULE_PNL = "(CASE WHEN p >= 0.5 THEN y ELSE 1 - y END - 0.5 - 0.07 * 0.25)"


@q("L01_taker_rule", P + f"SELECT symbol, count(*) AS n, {R(f'sum({RULE_PNL})', 'pnl')}, {R(f'avg(({RULE_PNL} > 0)::INT)', 'win_rate')} FROM pred WHERE {RULE} > 0 GROUP BY 1")
def _(spark, d):
    x = v.predictions(spark, d).withColumn("side", F.when(F.col("p") >= 0.5, "up").otherwise("down")).filter(F.greatest(F.col("p") - 0.57, 0.43 - F.col("p")) > 0)
    pnl = prob.pnl_per_share(F.col("side"), F.col("y") == 1, F.lit(0.5), prob.taker_fee(F.lit(0.5), 1.0))
    g = x.withColumn("pnl", pnl).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("s"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))
    return v.r6(g, "symbol", "n", pnl=F.col("s"), win_rate=None)


@q("L02_maker_bound", P + f"SELECT symbol, count(*) AS n, {R('sum(CASE WHEN p >= 0.5 THEN y ELSE 1 - y END - 0.49)', 'pnl')} FROM pred GROUP BY 1")
def _(spark, d):
    x = v.predictions(spark, d).withColumn("side", F.when(F.col("p") >= 0.5, "up").otherwise("down"))
    g = x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(prob.pnl_per_share(F.col("side"), F.col("y") == 1, F.lit(0.49), F.lit(0.0))).alias("s"))
    return v.r6(g, "symbol", "n", pnl=F.col("s"))


CURVE = P + f""", c AS (SELECT symbol, m.m AS margin, count(*) AS n, sum({RULE_PNL}) AS total, avg({RULE_PNL}) AS per_trade, avg(({RULE_PNL} > 0)::INT) AS win_rate FROM pred, (SELECT unnest([0.0, 0.05, 0.1, 0.2]) AS m) m WHERE greatest(p - 0.5, 0.5 - p) > m.m GROUP BY 1, 2)"""


def curve(spark, d):
    e = F.greatest(F.col("p") - 0.5, 0.5 - F.col("p"))
    side = F.when(F.col("p") >= 0.5, "up").otherwise("down")
    pnl = prob.pnl_per_share(side, F.col("y") == 1, F.lit(0.5), prob.taker_fee(F.lit(0.5), 1.0))
    return orders.margin_curve(v.predictions(spark, d), ["symbol"], [0.0, 0.05, 0.1, 0.2], e, pnl, 20)


@q("D22_margin_curve", CURVE + f"SELECT symbol, margin::DOUBLE AS margin, n, {R('total')}, {R('per_trade')}, {R('win_rate')} FROM c")
def _(spark, d):
    return v.r6(curve(spark, d), "symbol", "margin", "n", total=None, per_trade=None, win_rate=None)


@q("L03_margin_choice", CURVE + "SELECT symbol, arg_max(margin, (round(total, 9), -margin))::DOUBLE AS margin FROM c WHERE n >= 20 GROUP BY 1")
def _(spark, d):
    return orders.choose_margin(curve(spark, d).withColumn("total", F.round("total", 9)), ["symbol"])


@q("L11_latency_fills", v.base() + f""", op AS (SELECT symbol, t + 1800 AS t, 0.6::DOUBLE AS fair FROM bars), qt AS (SELECT symbol, us / 1000000.0 AS qt, least(0.99, floor(price * 100 / 60) / 100) AS ask, size AS ask_size FROM ticks),
x AS (SELECT op.symbol, op.t, l.l AS latency, fair, op.t + l.l AS at FROM op, (SELECT unnest([0.0, 60.0, 600.0]) AS l) l), f AS (SELECT x.*, ask, ask_size, fair - ask - 0.07::DOUBLE * (ask * (1 - ask)) AS edge FROM x ASOF LEFT JOIN qt ON x.symbol = qt.symbol AND x.at >= qt.qt)
SELECT latency::DOUBLE AS latency, count(*) AS n, {R('avg(coalesce(edge > 0.02, false)::INT)', 'fill_rate')}, {R('sum(CASE WHEN edge > 0.02 THEN least(ask_size, 5) ELSE 0 END)', 'shares')}, {R('sum(CASE WHEN edge > 0.02 THEN edge * least(ask_size, 5) ELSE 0 END)', 'gain')} FROM f GROUP BY 1""")
def _(spark, d):
    op = v.bars(spark, d).select("symbol", (F.col("t") + 1800).cast("double").alias("t"), F.lit(0.6).alias("fair"))
    qt = v.ticks(spark, d).select("symbol", (F.unix_micros("ts") / 1000000).alias("qt"), F.least(F.lit(0.99), F.floor(F.col("price") * 100 / 60) / 100).alias("ask"), F.col("size").cast("double").alias("ask_size"), "seq")
    f = orders.latency_fills(op, qt, ["symbol"], [0.0, 60.0, 600.0], cap=5.0, margin=0.02)
    g = f.groupBy("latency").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("filled").cast("double")).alias("fill_rate"), F.sum("qty").alias("shares"), F.sum(F.when(F.col("filled"), F.col("edge") * F.col("qty")).otherwise(0.0)).alias("gain"))
    return v.r6(g, "latency", "n", fill_rate=None, shares=None, gain=None)


@q("L13_threshold_summary", """WITH RECURSIVE """ + P[len("WITH RECURSIVE "):] + f""", cand AS (SELECT symbol, t, CASE WHEN p >= 0.5 THEN ret ELSE -ret END AS g FROM pred WHERE abs(p - 0.5) > 0.1),
k AS (SELECT symbol, min(t) AS t FROM cand GROUP BY 1 UNION ALL SELECT symbol, t FROM (SELECT k.symbol, min(c.t) AS t FROM k JOIN cand c ON c.symbol = k.symbol AND c.t >= k.t + 18000 GROUP BY 1))
SELECT symbol, count(*) AS n, {R('avg((g > 0)::INT)', 'hit_rate')}, {R('avg(g) * 10000', 'gross_bps')}, {R('avg(g) * 10000 - 10', 'net_bps')}, {R('stddev_samp(g) * 10000 / sqrt(count(*))', 'se_bps')} FROM cand JOIN k USING (symbol, t) GROUP BY 1""")
def _(spark, d):
    c = v.predictions(spark, d).filter(F.abs(F.col("p") - 0.5) > 0.1).select("symbol", "t", F.when(F.col("p") >= 0.5, F.col("ret")).otherwise(-F.col("ret")).alias("g"))
    kept = orders.cooldown(c.withColumn("t", F.col("t").cast("double")), ["symbol"], "t", 18000.0).filter("kept")
    g = kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("g") > 0).cast("double")).alias("hit_rate"), (F.avg("g") * 10000).alias("gross_bps"),
        (F.avg("g") * 10000 - 10).alias("net_bps"), (F.stddev_samp("g") * 10000 / F.sqrt(F.count(F.lit(1)))).alias("se_bps"))
    return v.r6(g, "symbol", "n", hit_rate=None, gross_bps=None, net_bps=None, se_bps=None)


@q("Q02_rule_baselines", P + f""", r AS (SELECT symbol, t, y, day, r.r AS rule, CASE r.r WHEN 'model' THEN (p >= 0.5)::INT WHEN 'reversal' THEN (p < 0.5)::INT ELSE 1 END AS pred FROM pred, (SELECT unnest(['model', 'reversal', 'always_up']) AS r) r)
SELECT rule, count(*) AS n, {R('avg((pred = y)::INT)', 'accuracy')} FROM r GROUP BY 1""")
def _(spark, d):
    rules = F.array(F.struct(F.lit("model").alias("rule"), (F.col("p") >= 0.5).cast("int").alias("pred")), F.struct(F.lit("reversal").alias("rule"), (F.col("p") < 0.5).cast("int").alias("pred")),
                    F.struct(F.lit("always_up").alias("rule"), F.lit(1).alias("pred")))
    x = v.predictions(spark, d).select("day", "y", F.inline(rules)).withColumn("hit", (F.col("pred") == F.col("y")).cast("double"))
    return v.r6(stats.cluster_mean(x, ["rule"], "day", "hit"), "rule", "n", accuracy=F.col("mean"))


QUERIES = Q
