"""As-of joins (backward and forward) without a range join and without one task per key.

Both sides are unioned and ordered inside (key, time bucket); the last known right row is carried forward by a window.
A bucket starts from the last right row of the buckets before it, taken from a table of one row per key and bucket.
The right row travels as one struct, so a present row whose measure is NULL is returned as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.operators.tiling import epoch_seconds


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str | Column,
    right_time: str,
    columns: Sequence[str],
    *,
    tolerance: float | None = None,
    forward: bool = False,
    tie: str | None = None,
    strict: bool = False,
    bucket_s: float = 86400.0,
    age: str | None = None,
) -> DataFrame:
    """Left rows plus ``columns`` of the last right row at or before them (forward: first at or after).

    ``tolerance`` (seconds, inclusive) drops matches that are too old; ``tie`` orders right rows of equal time;
    ``strict`` excludes equal times; ``age`` names an output column with the distance in seconds.
    """
    keys, columns = list(keys), list(columns)
    sign = -1.0 if forward else 1.0
    lt = epoch_seconds(left, left_time) if isinstance(left_time, str) else left_time
    rt = epoch_seconds(right, right_time)
    tie_col = (F.col(tie).cast("double") * sign) if tie else F.lit(0.0)
    l = left.select(*keys, (lt * sign).cast("double").alias("_t"), F.lit(0 if strict else 1).alias("_side"),
                    F.lit(0.0).alias("_tie"), F.struct(*left.columns).alias("_l"))
    r = right.select(*keys, (rt * sign).cast("double").alias("_t"), F.lit(1 if strict else 0).alias("_side"),
                     tie_col.alias("_tie"), F.struct((rt * sign).cast("double").alias("_rt"), *columns).alias("_r"))
    bucket = F.floor(F.col("_t") / F.lit(float(bucket_s)))
    l, r = l.withColumn("_b", bucket), r.withColumn("_b", bucket)
    ends = r.groupBy(*keys, "_b").agg(F.max_by("_r", F.struct("_t", "_tie")).alias("_end"))
    wanted = l.groupBy(*keys, "_b").agg(F.lit(True).alias("_need"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        ends.join(wanted, [*keys, "_b"], "full")
        .withColumn("_r", F.last("_end", ignorenulls=True).over(earlier))
        .filter(F.col("_need") & F.col("_r").isNotNull())
        .select(*keys, F.lit(float("-inf")).alias("_t"), F.lit(-1).alias("_side"), F.lit(0.0).alias("_tie"), "_r", "_b")
    )
    rows = l.unionByName(r, allowMissingColumns=True).unionByName(carry, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_hit", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_l").isNotNull())
    gap = F.col("_t") - F.col("_hit._rt")
    ok = F.lit(True) if tolerance is None else (gap <= F.lit(float(tolerance)))
    picked = [F.when(ok, F.col(f"_hit.{c}")).alias(c) for c in columns]
    extra = [] if age is None else [F.when(ok, gap).alias(age)]
    return out.select("_l.*", *picked, *extra)


def exact_lookup(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Values at exactly the same key and time; no fill."""
    return left.join(right.select(*on, *columns), list(on), "left")


def limited_fill(df: DataFrame, keys: Sequence[str], order: str, column: str, limit: int) -> DataFrame:
    """Carry the last known value over at most ``limit`` rows, on row tiles."""
    from tapeloom.operators import tiling

    tiled = tiling.tile(df, keys, order, behind=limit)
    frame = tiling.tile_window(keys).rowsBetween(-limit, 0)
    return tiling.untile(tiled.withColumn(column, F.last(column, ignorenulls=True).over(frame)))


def align_benchmark(bars: DataFrame, bench: DataFrame, *, limit: int = 5) -> DataFrame:
    """``bench_close`` on the bar clock of every symbol, held over at most ``limit`` missing bars."""
    joined = bars.join(bench.select("open_time", F.col("close").alias("bench_close")), "open_time", "left")
    return limited_fill(joined, ["symbol"], "open_time", "bench_close", limit)
