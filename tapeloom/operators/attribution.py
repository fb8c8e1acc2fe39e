"""Who took what left a price level: trades explain decreases share by share, the rest was cancelled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tapeloom.operators.book import snapshot_segments
from tapeloom.operators.intervals import islands
from tapeloom.operators.ladder import book_states


def level_decreases(events: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """keys, seq, time, side, price, amount, left: every change that makes a level smaller.  A snapshot is no change."""
    keys = list(keys)
    cut = snapshot_segments(events, keys, time, "is_snapshot")
    own = Window.partitionBy(*keys, "segment", "side", "price").orderBy(time, "seq")
    amount = F.lag("size").over(own) - F.col("size")
    return cut.select(*keys, "seq", time, "side", "price", amount.alias("amount"), F.col("size").alias("left")).where("amount > 0")


def explain_decreases(decreases: DataFrame, trades: DataFrame, keys: Sequence[str], time: str, *, lead: float, pause: float) -> DataFrame:
    """Decreases and trades of one level, merged: kind (``decrease`` or ``trade``), keys, side, price, seq, time, amount
    and explained.

    A level's trades wait in a pool that its decreases draw from, earliest first, each share once: the explained part
    of a decrease is what the pool held, that of a trade what decreases drew of it. So the explained shares of both
    kinds have the same sum. A trade counts from ``lead`` seconds before its time, as the book may tell of it first;
    a pause of more than ``pause`` seconds in a level's activity empties the pool.

    With inflow and outflow as one running sum X, the pool is X less its least value so far (zero at most), so two
    window sums and a running minimum do the matching.
    """
    on = [*keys, "side", "price"]
    both = decreases.select(*on, "seq", F.col(time).cast("double").alias("_t"), F.col(time).cast("double").alias(time), F.col("amount").cast("double").alias("amount"), F.lit(1).alias("_kind")).unionByName(
        trades.select(*on, "seq", (F.col(time).cast("double") - lead).alias("_t"), F.col(time).cast("double").alias(time), F.col("size").cast("double").alias("amount"), F.lit(0).alias("_kind")))
    runs = islands(both, on, "_t", max_gap=pause)
    upto = Window.partitionBy(*on, "run").orderBy("_t", "_kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    flow = F.when(F.col("_kind") == 0, F.col("amount")).otherwise(-F.col("amount"))
    run = runs.withColumn("_x", F.sum(flow).over(upto))
    floor = run.withColumn("_low", F.least(F.lit(0.0), F.min("_x").over(upto))).withColumn("_low0", F.least(F.lit(0.0), F.coalesce(F.min("_x").over(before), F.lit(0.0))))
    drawn = floor.withColumn("_drawn", F.when(F.col("_kind") == 1, F.col("amount") - (F.col("_low0") - F.col("_low"))).otherwise(0.0))
    every = Window.partitionBy(*on, "run")
    traded = F.coalesce(F.sum(F.when(F.col("_kind") == 0, F.col("amount"))).over(before), F.lit(0.0))
    used = F.greatest(F.least(F.sum("_drawn").over(every) - traded, F.col("amount")), F.lit(0.0))
    out = drawn.withColumn("explained", F.when(F.col("_kind") == 1, F.col("_drawn")).otherwise(used))
    return out.select(*on, F.when(F.col("_kind") == 1, "decrease").otherwise("trade").alias("kind"), "seq", time, "amount", "explained")


def removal_cause(explained: DataFrame, decreases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Levels that went to nothing: taken and cancelled shares of the last change, and who removed it."""
    ended = decreases.where("left = 0").select(*keys, "side", "price", "seq")
    rows = explained.where("kind = 'decrease'").join(ended, [*keys, "side", "price", "seq"])
    by = F.when(F.col("explained") > 0, "taker").otherwise("maker")
    return rows.select(*keys, "side", "price", "seq", F.col("explained").alias("taken"), (F.col("amount") - F.col("explained")).alias("cancelled"), by.alias("removed_by"))


def trades_with_book(trades: DataFrame, events: DataFrame, keys: Sequence[str], time: str, *, before: float, event_time: str | None = None) -> DataFrame:
    """Each trade with the book ``before`` seconds earlier: bid_pre, ask_pre, level_pre (size shown at the level it
    takes), best_pre (size at the best of that side), traverses (beyond the best level) and exceeds_depth.

    ``trades``: keys, seq, time, consumes (``ask`` or ``bid``), level, size.
    """
    keys = list(keys)
    takes_ask = F.col("consumes") == "ask"
    asked = trades.select(*keys, (F.col(time) - before).alias(event_time or time), F.col("seq").alias("query"), F.when(takes_ask, "S").otherwise("B").alias("side"), F.col("level").alias("price"))
    seen = book_states(events, keys, event_time or time, questions=asked).select(*keys, F.col("query").cast("long").alias("seq"), "bid", "ask", "bid_size", "ask_size", "level_size")
    rows = trades.join(seen, [*keys, "seq"])
    best = F.when(takes_ask, F.col("ask_size")).otherwise(F.col("bid_size"))
    beyond = F.when(takes_ask, F.col("level") > F.col("ask") + 1e-9).otherwise(F.col("level") < F.col("bid") - 1e-9)
    return rows.select(*keys, "seq", time, "consumes", "level", "size", F.col("bid").alias("bid_pre"), F.col("ask").alias("ask_pre"), F.col("level_size").alias("level_pre"), best.alias("best_pre"),
                       F.coalesce(beyond, F.lit(False)).alias("traverses"), F.coalesce(F.col("size") > best + 1e-9, F.lit(False)).alias("exceeds_depth"))
