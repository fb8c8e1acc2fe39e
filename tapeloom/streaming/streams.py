"""Structured Streaming twins: bars, sessions, cooldown, running volatility, transport delay."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeloom.session import ensure_checkpoint_dir


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything now available, then return the sink as a table."""
    spark, folder = stream.sparkSession, scratch(stream.sparkSession)
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def tick_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks from new parquet files named events*, event time as TIMESTAMP (watermarks need it)."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 16).parquet(folder)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
                      (1 + F.col("user_id") % 10).alias("size"), F.col("event_id").alias("seq"))


def streaming_bars(ticks: DataFrame, width: str, late: str) -> DataFrame:
    """Bars that are emitted once, when the watermark has closed them."""
    order = F.struct("ts", "seq")
    return ticks.withWatermark("ts", late).groupBy(F.window("ts", width), "symbol").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("size").alias("volume")).select(
        "symbol", F.unix_seconds("window.start").alias("t"), "open", "high", "low", "close", "volume")


def streaming_sessions(ticks: DataFrame, gap: str, late: str) -> DataFrame:
    return ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "symbol").agg(F.count(F.lit(1)).alias("n")).select(
        "symbol", F.unix_micros("session_window.start").alias("first_us"), "n")


def deduplicated(ticks: DataFrame, keys: list[str], late: str) -> DataFrame:
    """A repeat of a key that arrives within the watermark is dropped."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def streaming_cooldown(ticks: DataFrame, gap_s: float, late: str) -> DataFrame:
    """Keep an event when ``gap_s`` has passed since the last kept event of its key; the state is that one time.

    Events are applied in event-time order within a micro-batch.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -np.inf
        pdf = pd.concat(list(batches)).sort_values(["t", "seq"])
        kept = []
        for t, seq in zip(pdf["t"], pdf["seq"]):
            if t - last >= gap_s:
                kept.append((key[0], int(seq), float(t)))
                last = t
        state.update((float(last),))
        yield pd.DataFrame(kept, columns=["symbol", "seq", "t"])

    timed = ticks.withWatermark("ts", late).select("symbol", "seq", (F.unix_micros("ts") / 1000000).alias("t"))
    return timed.groupBy("symbol").applyInPandasWithState(step, "symbol STRING, seq BIGINT, t DOUBLE", "last DOUBLE", "append", GroupStateTimeout.NoTimeout)


def streaming_ewma_variance(ticks: DataFrame, alpha: float, late: str) -> DataFrame:
    """Exponential variance of tick returns; the state is the last log price and the variance."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, var, n = state.get if state.exists else (float("nan"), float("nan"), 0)
        pdf = pd.concat(list(batches)).sort_values(["t", "seq"])
        # columns, and a slice of rows at a time: no Python object lasts for each row of the batch
        for at in range(0, len(pdf), 65536):
            part = pdf.iloc[at : at + 65536]
            variances, counts = np.full(len(part), np.nan), np.zeros(len(part), np.int64)
            with np.errstate(divide="ignore", invalid="ignore"):
                logs = np.log(part["price"].to_numpy(float))
            for k, lp in enumerate(logs.tolist()):
                if np.isfinite(last):
                    sq = (lp - last) ** 2
                    var = sq if not np.isfinite(var) else (1 - alpha) * var + alpha * sq
                    n += 1
                last = lp
                variances[k], counts[k] = var, n
            yield pd.DataFrame({"symbol": key[0], "seq": part["seq"].to_numpy(), "var": variances, "n": counts})
        state.update((float(last), float(var), int(n)))

    timed = ticks.withWatermark("ts", late).select("symbol", "seq", "price", (F.unix_micros("ts") / 1000000).alias("t"))
    return timed.groupBy("symbol").applyInPandasWithState(step, "symbol STRING, seq BIGINT, var DOUBLE, n BIGINT", "last DOUBLE, var DOUBLE, n BIGINT", "append", GroupStateTimeout.NoTimeout)


def transport_delay(ticks: DataFrame, width: str, late: str) -> DataFrame:
    """Quantiles of receive time minus event time per window and source."""
    return ticks.withWatermark("ts", late).groupBy(F.window("ts", width), "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.max("delay").alias("worst"), F.percentile_approx("delay", 0.5).alias("p50")).select(
        "symbol", F.unix_seconds("window.start").alias("t"), "n", "worst", "p50")
