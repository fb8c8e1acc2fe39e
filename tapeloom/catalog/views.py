"""Market-shaped views of the supplied tables, as Spark DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.functions.numeric import round_binary
from tapeloom.operators.asof import align_benchmark, asof_join
from tapeloom.operators.resample import ticks_to_bars
from tapeloom.operators.tapes import spread

HOUR = 3600


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        (1 + F.col("user_id") % 10).alias("size"), F.col("user_id").alias("trader"), F.col("event_id").alias("seq"))


def bars(spark: SparkSession, d: str, seconds: int = HOUR) -> DataFrame:
    return ticks_to_bars(ticks(spark, d), seconds)


DERIV_COLUMNS = ("open_interest", "ls_ratio_top", "ls_ratio_accounts", "taker_ls_ratio")


def derivs(spark: SparkSession, d: str) -> DataFrame:
    """Publication-lagged measures: available five minutes after the tick; some present rows hold no measure."""
    e = table(spark, d, "events").filter(F.col("event_type") == "signup")
    gone = F.col("event_id") % 7 == 0
    m = lambda x, a: F.when(~gone, x).alias(a)
    return e.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000) + 300).alias("available"), F.col("event_id").alias("seq"),
        m(F.col("value") / 100000, "funding_rate"), m(1000 + F.col("value"), "open_interest"),
        m(F.col("value") / 100, "ls_ratio_top"), m(F.col("value") / 50, "ls_ratio_accounts"),
        m(F.col("value") / 25, "taker_ls_ratio"))


def bars_with_derivs(spark: SparkSession, d: str) -> DataFrame:
    b, m = bars(spark, d), derivs(spark, d)
    symbols = F.array(*[F.lit(s) for s in ("click", "view", "purchase", "error", "signup")])
    m = m.withColumn("symbol", F.explode(symbols))
    out = asof_join(b, m, ["symbol"], "t", "available", ["funding_rate"], tolerance=9 * HOUR, tie="seq")
    return asof_join(out, m, ["symbol"], "t", "available", DERIV_COLUMNS, tolerance=HOUR, tie="seq")


def bars_with_bench(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return align_benchmark(b, b.filter(F.col("symbol") == "click"))


TICKS_SQL = """ticks AS (
  SELECT event_type AS symbol, epoch_us(ts) AS us, value AS price, 1 + user_id % 10 AS size, user_id AS trader,
         event_id AS seq FROM events)"""


def bars_sql(seconds: int = HOUR, name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT symbol, (us // {seconds}000000) * {seconds} AS t, arg_min(price, us) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, us) AS close, sum(size)::DOUBLE AS volume, sum(price * size) AS quote_volume,
         count(*)::DOUBLE AS trades, sum(CASE WHEN trader % 2 = 0 THEN size ELSE 0 END)::DOUBLE AS taker_buy_volume
  FROM ticks GROUP BY 1, 2)"""


DERIVS_SQL = """derivs AS (
  SELECT epoch_us(ts) / 1000000.0 + 300 AS available, CASE WHEN event_id % 7 <> 0 THEN value END AS v
  FROM events WHERE event_type = 'signup'),
dbars AS (
  SELECT b.*, CASE WHEN b.t - m.available <= 32400 THEN m.v / 100000 END AS funding_rate,
         CASE WHEN b.t - m.available <= 3600 THEN 1000 + m.v END AS open_interest,
         CASE WHEN b.t - m.available <= 3600 THEN m.v / 100 END AS ls_ratio_top,
         CASE WHEN b.t - m.available <= 3600 THEN m.v / 50 END AS ls_ratio_accounts,
         CASE WHEN b.t - m.available <= 3600 THEN m.v / 25 END AS taker_ls_ratio
  FROM bars b ASOF LEFT JOIN derivs m ON b.t >= m.available)"""

BENCH_SQL = """mbars AS (
  SELECT b.*, last_value(k.close IGNORE NULLS) OVER (
           PARTITION BY b.symbol ORDER BY b.t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS bench_close
  FROM bars b LEFT JOIN (SELECT t, close FROM bars WHERE symbol = 'click') k ON k.t = b.t)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def base(*more: str) -> str:
    return with_(TICKS_SQL, bars_sql(), *more)


# -- trade tape and its markets -----------------------------------------------------------------------------------------

EPOCH_1995 = 788918400


def tape(spark: SparkSession, d: str, *more: str, rows_per_task: int | None = None) -> DataFrame:
    """Fills of all wallets, with further columns of lineitem; ``rows_per_task``: the fills of a tx in one task, so many rows in each."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag",
        "l_linestatus", "l_shipdate")
    if rows_per_task:
        li = spread(li, rows_per_task, "l_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    price = F.least(F.lit(0.99), F.greatest(F.lit(0.01), round_binary(F.col("l_extendedprice") / 105000, 2)))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("wallet"), F.col("l_partkey").alias("condition"),
        F.when(F.col("l_linestatus") == "O", "Up").otherwise("Down").alias("outcome"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.when(F.col("l_returnflag") != "N", "taker").otherwise("maker").alias("role"),
        price.alias("price"), F.col("l_quantity").alias("size"),
        (F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
         + (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 86400).alias("ts"),
        F.col("l_orderkey").alias("tx"),
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("seq"),
        *more)


def tape_markets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("condition"), F.col("p_brand").alias("asset"),
        F.when(F.col("p_size") % 2 == 0, "5m").otherwise("15m").alias("duration"),
        (EPOCH_1995 + (F.col("p_partkey") % 2500) * 86400).alias("window_start"),
        F.when(F.col("p_partkey") % 10 != 9, F.col("p_partkey") % 2 == 0).alias("resolved_up"))


TAPE_SQL = """tape AS (
  SELECT o_custkey AS wallet, l_partkey AS condition, CASE WHEN l_linestatus = 'O' THEN 'Up' ELSE 'Down' END AS outcome,
         CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
         CASE WHEN l_returnflag <> 'N' THEN 'taker' ELSE 'maker' END AS role,
         least(0.99, greatest(0.01, round(l_extendedprice / 105000, 2))) AS price, l_quantity AS size,
         epoch(l_shipdate)::BIGINT + (l_orderkey * 7919 + l_linenumber * 104729) % 86400 AS ts, l_orderkey AS tx,
         ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
markets AS (
  SELECT p_partkey AS condition, p_brand AS asset, CASE WHEN p_size % 2 = 0 THEN '5m' ELSE '15m' END AS duration,
         788918400 + (p_partkey % 2500) * 86400 AS window_start,
         CASE WHEN p_partkey % 10 <> 9 THEN p_partkey % 2 = 0 END AS resolved_up FROM part),
trades AS (SELECT t.*, m.asset, m.duration, m.window_start, m.resolved_up, t.ts - m.window_start AS t_rel
           FROM tape t LEFT JOIN markets m USING (condition))"""

PNL_SQL = """pnl0 AS (
  SELECT wallet, condition,
    round(sum(CASE WHEN outcome = 'Up' THEN CASE WHEN side = 'BUY' THEN size ELSE -size END ELSE 0 END), 6) AS pos_up,
    round(sum(CASE WHEN outcome = 'Down' THEN CASE WHEN side = 'BUY' THEN size ELSE -size END ELSE 0 END), 6) AS pos_down,
    sum(CASE WHEN side = 'BUY' THEN -price * size ELSE price * size END) AS cash,
    sum(CASE WHEN role = 'taker' THEN round_even(0.07::DOUBLE * price * (1 - price) * size * 100000, 0) / 100000 ELSE 0 END) AS fees,
    sum(price * size) AS volume, sum(size) AS shares, count(*) AS n_trades,
    count(*) FILTER (role = 'taker') AS n_taker, count(*) FILTER (role = 'maker') AS n_maker,
    sum(CASE WHEN role = 'taker' THEN price * size ELSE 0 END) AS taker_notional,
    sum(CASE WHEN role = 'maker' THEN 0.07::DOUBLE * price * (1 - price) * size ELSE 0 END) AS maker_fee_equiv,
    min(t_rel) AS first_t_rel, max(t_rel) AS last_t_rel, median(t_rel) AS median_t_rel, max(resolved_up) AS resolved_up,
    max(asset) AS asset, max(window_start) AS window_start
  FROM trades GROUP BY 1, 2),
pools AS (SELECT condition, sum(fees) AS pool, sum(maker_fee_equiv) AS equiv FROM pnl0 GROUP BY 1),
pnl1 AS (SELECT p.*, CASE WHEN resolved_up IS NULL THEN NULL WHEN resolved_up THEN pos_up ELSE pos_down END AS payout,
  CASE WHEN equiv > 0 THEN 0.2 * pool * maker_fee_equiv / equiv ELSE 0 END AS rebate_est
  FROM pnl0 p JOIN pools USING (condition)),
pnl AS (SELECT *, cash - fees + payout AS pnl, cash - fees + payout + rebate_est AS pnl_incl_rebate,
  CASE WHEN volume > 0 THEN taker_notional / volume END AS taker_share, round(pos_up - pos_down, 6) AS net_up,
  CASE WHEN pos_up - pos_down > 0.000001 THEN 'Up' WHEN pos_up - pos_down < -0.000001 THEN 'Down' ELSE 'flat' END AS direction
  FROM pnl1)"""


def r6(df: DataFrame, *plain: str, **rounded) -> DataFrame:
    """Select plain columns and rounded doubles (name=column expression or name=None for the column itself)."""
    from tapeloom.functions.numeric import ndigits

    out = [F.col(c) for c in plain]
    for name, expr in rounded.items():
        out.append(ndigits(F.col(name) if expr is None else expr).alias(name))
    return df.select(*out)


def rsql(expr: str, name: str | None = None) -> str:
    return f"round(({expr})::DOUBLE, 6) + 0.0 AS {name or expr}"


# -- hourly markets on the ticks, and predictions on the bars -------------------------------------------------------------


def markets(spark: SparkSession, d: str, seconds: int = HOUR) -> DataFrame:
    """One window per symbol and hour: level at the start (K), level at the end (F), outcome (a tie is Up)."""
    b = bars(spark, d, seconds)
    return b.select("symbol", F.col("t").cast("long").alias("s"), (F.col("t") + seconds).cast("long").alias("e"),
                    F.col("open").alias("k"), F.col("close").alias("f"), (F.col("close") >= F.col("open")).alias("up"), "trades")


MARKETS_SQL = "mk AS (SELECT symbol, t AS s, t + 3600 AS e, open AS k, close AS f, close >= open AS up, trades FROM bars)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Two planted forecasts of the direction of the next bar: p (strong) and p2 (weak)."""
    from tapeloom.functions.numeric import logistic
    from tapeloom.plans.indicators import compute_indicators
    from tapeloom.plans.targets import make_targets

    b = make_targets(compute_indicators(bars(spark, d), ["ret_1"], keep_rows=True), [1], bar_s=HOUR)
    return b.filter(F.col("ret_1").isNotNull() & F.col("fwd_1").isNotNull() & F.col("dir_1").isNotNull()).select(
        "symbol", F.col("t").cast("long").alias("t"), F.floor(F.col("t") / 86400).alias("day"),
        F.round(logistic(-0.8 * F.col("ret_1")), 9).alias("p"), F.round(logistic(-0.2 * F.col("ret_1")), 9).alias("p2"),
        F.col("dir_1").cast("int").alias("y"), F.col("fwd_1").alias("ret"))


PRED_SQL = """tg AS (SELECT symbol, t, ln(close) - lag(ln(close)) OVER w AS r1,
  CASE WHEN lead(t) OVER w - t = 3600 THEN ln(lead(close) OVER w / close) END AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)),
pred AS (SELECT symbol, t, t // 86400 AS day, round(1 / (1 + exp(0.8 * r1)), 9) AS p, round(1 / (1 + exp(0.2 * r1)), 9) AS p2, (ret > 0)::INT AS y, ret
  FROM tg WHERE r1 IS NOT NULL AND ret IS NOT NULL AND ret <> 0)"""
