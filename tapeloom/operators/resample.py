"""Ticks to bars, and bars to coarser bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ticks_to_bars(ticks: DataFrame, seconds: int) -> DataFrame:
    """OHLCV bars from ticks(symbol, ts, price, size, trader, seq).  Partial aggregates combine before the shuffle."""
    start = F.floor(F.unix_micros("ts") / F.lit(1_000_000 * seconds)) * seconds
    order = F.struct("ts", "seq")
    return (
        ticks.groupBy("symbol", start.alias("t"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("size").cast("double").alias("volume"),
            F.sum(F.col("price") * F.col("size")).alias("quote_volume"),
            F.count(F.lit(1)).cast("double").alias("trades"),
            F.sum(F.when(F.col("trader") % 2 == 0, F.col("size")).otherwise(0)).cast("double").alias("taker_buy_volume"),
        )
        .withColumn("open_time", F.timestamp_seconds("t"))
        .withColumn("session", F.to_date("open_time"))
    )


def coarser_bars(bars: DataFrame, seconds: int, least: int = 1) -> DataFrame:
    """Bars of a longer step; a step with fewer than ``least`` source bars is dropped."""
    start = F.floor(F.unix_seconds("open_time") / F.lit(seconds)) * seconds
    total = lambda c: F.sum(c).alias(c)
    return (
        bars.groupBy("symbol", start.alias("t"))
        .agg(
            F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "open_time").alias("close"), total("volume"), total("quote_volume"), total("trades"),
            total("taker_buy_volume"), F.count(F.lit(1)).alias("n_rows"),
        )
        .filter(F.col("n_rows") >= least)
        .withColumn("open_time", F.timestamp_seconds("t"))
        .withColumn("session", F.to_date("open_time"))
    )
