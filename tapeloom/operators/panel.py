"""Daily panels of many symbols.  A symbol has one row per day, so plain per-symbol windows stay small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.operators.intervals import spine

DAY = 86400


def _w() -> object:
    return Window.partitionBy("symbol").orderBy("day")


def _run():
    return _w().rowsBetween(Window.unboundedPreceding, 0)


def build_panel(daily: DataFrame) -> DataFrame:
    """Dense day clock for every symbol over the whole table; ``active`` until its last traded day.

    ``daily``: symbol, day (days since the epoch), close, qvol.
    """
    ends = daily.agg(F.min("day").alias("a"), F.max("day").alias("z")).withColumn("_k", F.lit(1))
    names = daily.groupBy("symbol").agg(F.min("day").alias("first"), F.max(F.when(F.col("qvol") > 0, F.col("day"))).alias("last")).withColumn("_k", F.lit(1))
    ranges = names.join(ends, "_k").drop("_k")
    days = spine(ranges.select("symbol", "a", "z"), ["symbol"], "a", "z", 1, "day")
    return (days.join(daily, ["symbol", "day"], "left").join(ranges.select("symbol", "last", F.col("z").alias("end")), "symbol")
            .withColumn("active", (F.col("qvol") > 0) & (F.col("day") <= F.col("last")))
            .withColumn("active", F.coalesce("active", F.lit(False))).withColumn("close", F.when(F.col("active"), F.col("close"))))


def delist_notice(panel: DataFrame, n: int) -> DataFrame:
    """True on the last n traded days of a symbol that stops before the panel does."""
    back = Window.partitionBy("symbol").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    after = F.sum(F.col("active").cast("int")).over(back)
    return panel.withColumn("notice", F.col("active") & (F.col("last") < F.col("end")) & (after <= n))


def community_flag(panel: DataFrame, crash: float = 0.7, rebound: float = 2.0) -> DataFrame:
    """Absorbing flag: fell by ``crash`` from its running peak, then rose ``rebound`` times from its trough."""
    p = panel.withColumn("_peak", F.max("close").over(_run()))
    p = p.withColumn("_crash", F.min(F.when(F.col("close") <= (1 - crash) * F.col("_peak"), F.col("day"))).over(_run()))
    p = p.withColumn("_trough", F.min(F.when(F.col("day") >= F.col("_crash"), F.col("close"))).over(_run()))
    up = F.coalesce((F.col("close") >= rebound * F.col("_trough")) & (F.col("day") >= F.col("_crash")), F.lit(False))
    return p.withColumn("community", F.max(up).over(_run())).drop("_peak", "_crash", "_trough")


def eligibility(panel: DataFrame, *, age: int, volume: float, window: int = 30, notice: int = 5) -> DataFrame:
    p = delist_notice(panel, notice)
    frame = _w().rowsBetween(-(window - 1), 0)
    q = F.when(F.col("active"), F.col("qvol"))
    med = F.when(F.count(q).over(frame) >= window // 2, F.percentile(q, F.lit(0.5)).over(frame))
    old = F.sum(F.col("active").cast("int")).over(_run()) >= age
    return p.withColumn("_med", med).withColumn("_old", old).withColumn(
        "eligible", F.coalesce(F.col("active") & F.col("_old") & (F.col("_med") >= volume) & ~F.col("notice"), F.lit(False))).drop("_med", "_old")


def range_position(panel: DataFrame, n: int, out: str = "position") -> DataFrame:
    frame = _w().rowsBetween(-(n - 1), 0)
    lo, hi = F.min("close").over(frame), F.max("close").over(frame)
    return panel.withColumn(out, F.when((F.count("close").over(frame) == n) & (hi > lo), (F.col("close") - lo) / (hi - lo)))


def forward_stats(panel: DataFrame, h: int) -> DataFrame:
    """Return, highest, lowest and deepest fall over the next h days, with a delisted symbol held at its last close."""
    p = panel.withColumn("_c", F.last("close", ignorenulls=True).over(_run()))
    ahead = _w().rowsBetween(1, h)
    path = F.collect_list("_c").over(_w().rowsBetween(0, h))  # h + 1 values at most
    p = p.withColumns({"_end": F.lead("_c", h).over(_w()), "_hi": F.max("_c").over(ahead), "_lo": F.min("_c").over(ahead), "_path": path})
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))
    fall = F.aggregate("_path", start, lambda a, x: F.struct(
        F.greatest(a["peak"], x).alias("peak"), F.least(a["dd"], x / F.greatest(a["peak"], x) - 1).alias("dd")))["dd"]
    full = (F.col("day") + h <= F.col("end")) & F.col("_c").isNotNull()
    keep = lambda x: F.when(full, x)
    return p.withColumns({"ret": keep(F.col("_end") / F.col("_c") - 1), "max": keep(F.col("_hi") / F.col("_c") - 1),
                          "min": keep(F.col("_lo") / F.col("_c") - 1), "dd": keep(fall)}).drop("_c", "_end", "_hi", "_lo", "_path")


def basket(panel: DataFrame, picked: Column, every: int, cost: float = 0.0) -> DataFrame:
    """Equal weights of the picked symbols, chosen at the first day of each period and held to its end."""
    p = panel.withColumn("_period", F.floor(F.col("day") / every)).withColumn("_c", F.last("close", ignorenulls=True).over(_run()))
    hold = p.groupBy("symbol", "_period").agg(
        F.min_by(picked, "day").alias("_in"), F.min_by("_c", "day").alias("_a"), F.max_by("_c", "day").alias("_z"))
    return hold.filter(F.col("_in") & F.col("_a").isNotNull()).groupBy(F.col("_period").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col("_z") / F.col("_a")) - 1 - cost).alias("ret"))


def performance(returns: DataFrame, group: Sequence[str], order: str, r: str, periods: int) -> DataFrame:
    """Total multiple, yearly growth, volatility, Sharpe and deepest fall of a return series."""
    eq = F.exp(F.sum(F.log1p(F.col(r))).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    e = returns.filter(F.col(r).isNotNull()).withColumn("_eq", eq)
    e = e.withColumn("_dd", F.col("_eq") / F.max("_eq").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - 1)
    g = e.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.exp(F.sum(F.log1p(F.col(r)))).alias("total_x"), (F.stddev_samp(r) * periods**0.5).alias("vol"),
                              F.try_divide(F.avg(r), F.stddev_samp(r)).alias("_s"), F.min("_dd").alias("max_dd"))
    return g.withColumn("cagr", F.pow(F.col("total_x"), periods / F.col("n")) - 1).withColumn("sharpe", F.col("_s") * periods**0.5).drop("_s")


def market_index(panel: DataFrame) -> DataFrame:
    """Equal-weight mean of the daily returns of active symbols."""
    r = F.col("close") / F.lag("close").over(_w()) - 1
    return panel.withColumn("_r", r).filter(F.col("_r").isNotNull()).groupBy("day").agg(F.avg("_r").alias("r"), F.count(F.lit(1)).alias("n"))


def regimes(index: DataFrame, n: int) -> DataFrame:
    """Index returns above and below its lagged moving average of n days."""
    w = Window.partitionBy(F.lit(1)).orderBy("day")  # one row per day
    i = index.withColumn("_l", F.sum(F.log1p("r")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    i = i.withColumn("_ma", F.when(F.count("_l").over(w.rowsBetween(-(n - 1), 0)) == n, F.avg("_l").over(w.rowsBetween(-(n - 1), 0))))
    i = i.withColumn("_up", F.lag(F.col("_l") > F.col("_ma")).over(w)).filter(F.col("_up").isNotNull())
    return i.groupBy(F.when(F.col("_up"), "above").otherwise("below").alias("regime")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))


def rolling_starts(returns: DataFrame, length: int, every: int) -> DataFrame:
    """Multiple over each window of ``length`` days starting every ``every`` days: each day feeds the windows it is in."""
    first = returns.agg(F.min("day").alias("_d0"), F.max("day").alias("_d1")).withColumn("_k", F.lit(1))
    r = returns.withColumn("_k", F.lit(1)).join(F.broadcast(first), "_k").withColumn("_o", F.col("day") - F.col("_d0"))  # one row
    lo = F.greatest(F.ceil((F.col("_o") - length + 1) / every), F.lit(0))
    w = r.withColumn("_s", F.explode(F.sequence(lo, F.floor(F.col("_o") / every)))).withColumn("start", F.col("_s") * every)
    return w.filter(F.col("_d0") + F.col("start") + length - 1 <= F.col("_d1")).groupBy("start").agg(
        F.exp(F.sum(F.log1p("r"))).alias("total_x"), F.count(F.lit(1)).alias("n"))


def event_study(stats: DataFrame, state: str) -> DataFrame:
    """Forward outcome at the entries into a state against all days, by month."""
    edge = F.col(state) & ~F.coalesce(F.lag(state).over(_w()), F.lit(False))
    s = stats.withColumn("_e", F.coalesce(edge, F.lit(False))).filter(F.col("ret").isNotNull())
    return s.groupBy(F.floor(F.col("day") / 30).alias("month")).agg(
        F.count(F.when(F.col("_e"), 1)).alias("n_events"), F.sum(F.when(F.col("_e"), F.col("ret")).otherwise(0.0)).alias("event_sum"),
        F.avg("ret").alias("all_mean"))
