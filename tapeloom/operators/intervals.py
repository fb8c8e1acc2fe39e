"""Interval joins, dense time spines, and gaps-and-islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.operators import tiling


def interval_join(
    points: DataFrame, windows: DataFrame, keys: Sequence[str], time: str, start: str, end: str, *,
    width: float, closed: str = "left", how: str = "inner",
) -> DataFrame:
    """Points with their windows of the same key, joined by equality on (key, bucket) plus the exact bounds.

    ``width`` is the bucket width in the unit of the time columns; at or above the usual window length every window
    falls in one or two buckets.  ``closed`` is ``left`` for [start, end), ``right`` for (start, end], ``both``.
    """
    keys = list(keys)
    cell = lambda c: F.floor(c / F.lit(float(width)))
    w = windows.withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    p = points.withColumn("_cell", cell(F.col(time)))
    lo = F.col(time) >= F.col(start) if closed in ("left", "both") else F.col(time) > F.col(start)
    hi = F.col(time) < F.col(end) if closed == "left" else F.col(time) <= F.col(end)
    on = [p[k] == w[k] for k in [*keys, "_cell"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = p.join(w, cond & lo & hi, how)
    for k in [*keys, "_cell"]:
        joined = joined.drop(w[k])
    return joined.drop("_cell")


def spine(ranges: DataFrame, keys: Sequence[str], start: str, end: str, step: int, out: str, *,
          chunk: int = 4096) -> DataFrame:
    """One row per key and step from start to end (inclusive, integer seconds).

    A long range is cut into chunks that are shuffled before they expand, so one key does not expand in one task.
    """
    keys = list(keys)
    span = step * chunk
    parts = ranges.select(*keys, F.col(start).alias("_a"), F.col(end).alias("_z"),
                          F.explode(F.sequence(F.col(start), F.col(end), F.lit(span))).alias("_c"))
    parts = parts.repartition(*[F.col(k) for k in keys], "_c")
    return parts.select(*keys, F.explode(
        F.sequence("_c", F.least(F.col("_c") + span - step, F.col("_z")), F.lit(step))).alias(out))


def islands(
    df: DataFrame, keys: Sequence[str], time: str, *, max_gap: float | None = None, split_on: Sequence[str] = (),
    aggs: Sequence[Column] = (), bucket_s: float = 86400.0,
) -> DataFrame:
    """Runs of consecutive rows: a new run starts after a gap over ``max_gap`` or where a ``split_on`` column changes.

    Runs are numbered inside row tiles and joined across tile borders by comparing each row with the one before it, so
    a run may span any number of tiles.
    """
    keys = list(keys)
    tiled = tiling.tile(df, keys, time, behind=1, bucket_s=bucket_s)
    w = tiling.tile_window(keys)
    t = tiling.epoch_seconds(df, time)
    fresh = F.lag(tiling.ROW).over(w).isNull()
    if max_gap is not None:
        fresh = fresh | (t - F.lag(t).over(w) > F.lit(float(max_gap)))
    for c in split_on:
        fresh = fresh | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    flagged = tiled.withColumn("_new", fresh)
    flagged = flagged.filter(~F.col(tiling.HALO))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    local = flagged.withColumn("_in", F.sum(F.col("_new").cast("long")).over(run))
    per_tile = local.groupBy(*keys, tiling.TILE).agg(F.max("_in").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(tiling.TILE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_tile.select(*keys, tiling.TILE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    runs = local.join(offsets, [*keys, tiling.TILE]).withColumn("run", F.col("_off") + F.col("_in"))
    if not aggs:
        return runs.drop("_new", "_in", "_off", *tiling.INTERNAL)
    return runs.groupBy(*keys, "run").agg(*aggs)


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Union of half-open intervals per key (coverage tables: one row per fetched interval)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.filter(F.col(end) > F.col(start)).withColumn(
        "_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    return (
        marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")
    )


def missing_intervals(target: DataFrame, covered: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Parts of the target intervals that no covered interval holds (target minus covered)."""
    keys = list(keys)
    cov = merge_intervals(covered, keys, start, end).select(
        *keys, F.col(start).alias("_cs"), F.col(end).alias("_ce"))
    tgt = target.select(*keys, F.col(start).alias("_ts"), F.col(end).alias("_te"))
    hits = tgt.join(cov, keys, "left").filter(
        F.col("_cs").isNull() | ((F.col("_cs") < F.col("_te")) & (F.col("_ce") > F.col("_ts"))))
    keep = tgt.join(hits.select(*keys, "_ts", "_te", "_cs", "_ce"), [*keys, "_ts", "_te"], "left")
    w = Window.partitionBy(*keys, "_ts", "_te").orderBy("_cs")
    holes = keep.select(
        *keys, "_ts", "_te",
        F.greatest(F.coalesce(F.lag("_ce").over(w), F.col("_ts")), F.col("_ts")).alias("_a"),
        F.coalesce(F.col("_cs"), F.col("_te")).alias("_b"),
        F.col("_ce").alias("_ce"), F.lead("_cs").over(w).isNull().alias("_last"))
    before = holes.select(*keys, F.col("_a").alias(start), F.least("_b", "_te").alias(end))
    after = holes.filter(F.col("_last") & F.col("_ce").isNotNull()).select(
        *keys, F.col("_ce").alias(start), F.col("_te").alias(end))
    return before.unionByName(after).filter(F.col(start) < F.col(end))
