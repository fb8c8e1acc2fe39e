"""Future returns and directions of bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tapeloom.functions.numeric import div, ln
from tapeloom.operators import tiling


def make_targets(bars: DataFrame, horizons: Sequence[int], *, bar_s: int, eps: float = 0.0,
                 keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``fwd_h`` = ln(C[t+h] / C[t]), NULL unless the h-th next bar is exactly h bars later; ``dir_h`` = 1 / 0, NULL
    inside the neutral band."""
    tiled = tiling.tile(bars, keys, "open_time", behind=0, ahead=max(horizons))
    w = tiling.tile_window(keys)
    second = F.unix_seconds("open_time")
    cols = {}
    for h in horizons:
        exact = F.lead(second, h).over(w) - second == h * bar_s
        cols[f"fwd_{h}"] = F.when(exact, ln(div(F.lead("close", h).over(w), F.col("close"))))
    out = tiling.untile(tiled.withColumns(cols))
    for h in horizons:
        r = F.col(f"fwd_{h}")
        out = out.withColumn(f"dir_{h}", F.when(r > eps, 1.0).when(r < -eps, 0.0))
    return out


def bar_seconds(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Most frequent gap between bars per key (the smallest of equally frequent gaps)."""
    tiled = tiling.tile(bars, keys, "open_time", behind=1)
    gap = F.unix_seconds("open_time") - F.lag(F.unix_seconds("open_time")).over(tiling.tile_window(keys))
    return tiling.untile(tiled.withColumn("gap", gap)).filter(F.col("gap").isNotNull()).groupBy(*keys, "gap").agg(
        F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.min_by("gap", F.struct(-F.col("n"), F.col("gap"))).alias("bar_s"))


def forward_variance(bars: DataFrame, h: int, *, bar_s: int, out: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Sum of squared one-bar returns over the next h bars, NULL if any is missing or a gap lies between."""
    tiled = tiling.tile(bars, keys, "open_time", behind=1, ahead=h)
    w = tiling.tile_window(keys)
    second = F.unix_seconds("open_time")
    r = F.when(second - F.lag(second).over(w) == bar_s, ln(F.col("close")) - ln(F.lag("close").over(w)))
    step = tiled.withColumn("_r2", r * r)
    ahead = w.rowsBetween(1, h)
    full = (F.count("_r2").over(ahead) == h) & (F.lead(second, h).over(w) - second == h * bar_s)
    return tiling.untile(step.withColumn(out, F.when(full, F.sum("_r2").over(ahead)))).drop("_r2")
