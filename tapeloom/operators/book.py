"""Order books rebuilt from snapshots and level changes.

A snapshot replaces the whole book; ``snapshot_segments`` numbers the stretches between snapshots.  The book at any
instant comes from ``ladder``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.operators.ladder import book_states
from tapeloom.operators.tiling import TILE, tile, tile_window, untile

SCALE = 1000  # prices are integer thousandths


def mirror(asset: Column, side: Column, price: Column) -> tuple[Column, Column]:
    """Level change in the frame of the first asset: a bid of the second at p is an ask of the first at 1 - p."""
    flip = F.when(side == "B", "S").otherwise("B")
    return F.when(asset == 0, side).otherwise(flip), F.when(asset == 0, price).otherwise(SCALE - price)


def consumed_level(asset: Column, side: Column, price: Column) -> tuple[Column, Column]:
    """Side and level of the first asset's book that a taker trade consumes."""
    direct = F.when(side == "BUY", "ask").otherwise("bid")
    other = F.when(side == "BUY", "bid").otherwise("ask")
    return F.when(asset == 0, direct).otherwise(other), F.when(asset == 0, price).otherwise(F.round(1 - price, 3))


def snapshot_segments(events: DataFrame, keys: Sequence[str], order: str, snapshot: str) -> DataFrame:
    """Add ``segment``: how many snapshots the key has had so far (counted in tiles, joined by tile totals)."""
    keys = list(keys)
    rows = tile(events, keys, order, behind=0)
    run = tile_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    local = untile(rows.withColumn("_in", F.sum(F.col(snapshot).cast("long")).over(run)).withColumn("_tl", F.col(TILE)))
    totals = local.groupBy(*keys, "_tl").agg(F.max("_in").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_tl").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_tl", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return local.join(offsets, [*keys, "_tl"]).withColumn("segment", F.col("_off") + F.col("_in")).drop("_in", "_off", "_tl")


def best_levels(events: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Best bid and ask (price, size) after every event, and how many levels stand.  Needs is_snapshot, side, price, size, seq."""
    states = book_states(events, keys, time)
    return states.select(*keys, F.col("query").cast("long").alias("seq"), "bid", "bid_size", "ask", "ask_size", "n_levels")


def depth_walk(levels: DataFrame, group: Sequence[str], quantity: float, limit: float | None = None) -> DataFrame:
    """Average price paid for a quantity by eating levels from the cheapest, and the quantity found."""
    rows = levels if limit is None else levels.filter(F.col("price") <= limit)
    before = Window.partitionBy(*group).orderBy("price").rowsBetween(Window.unboundedPreceding, -1)
    had = F.coalesce(F.sum("size").over(before), F.lit(0.0))
    take = rows.withColumn("_take", F.least(F.col("size"), F.greatest(F.lit(quantity) - had, F.lit(0.0))))
    return take.groupBy(*group).agg(F.sum("_take").alias("filled"), F.try_divide(F.sum(F.col("_take") * F.col("price")), F.sum("_take")).alias("vwap"))
