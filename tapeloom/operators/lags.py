"""How one series follows another: correlations at many lags, and the response spread over many lags.

Both work on tiles of time or rows and reduce each tile to a vector of sums, for all lags at once; the vectors are
added, and only they travel. No lag is a join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tapeloom.operators import tiling
from tapeloom.operators.asof import asof_join

MOMENTS = ("n", "x", "y", "xx", "yy", "xy")


def _step(times: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The value of a step function at each instant: that of the last row at or before it."""
    if not len(times):
        return np.full(at.shape, np.nan)
    place = np.searchsorted(times, at, side="right") - 1
    return np.where(place >= 0, values[np.maximum(place, 0)], np.nan)


def lag_moments(reference: DataFrame, series: DataFrame, keys: Sequence[str], time: str, value: str, lags: Sequence[float], horizon: float, *, tile_s: float) -> DataFrame:
    """keys, lag (number in ``lags``), n, x, y, xx, yy, xy: sums over the reference's rows of its change over ``horizon`` (from
    the row exactly that much earlier) and of the series' change over the same span moved back by the lag.

    A task holds one key's rows of ``tile_s`` seconds, and the series' rows that some lag can ask for from there: those
    from the tile's begin less the longest lag and the horizon on, and the last one before.
    """
    keys, lags = list(keys), [float(x) for x in lags]
    back, ahead = max(0.0, max(lags)) + horizon, max(0.0, -min(lags))
    seconds = lambda df: tiling.epoch_seconds(df, time).cast("double")
    rows = reference.select(*keys, seconds(reference).alias("_t"), F.col(value).cast("double").alias("_v"))
    before = rows.select(*keys, F.round(F.col("_t") + horizon, 3).alias("_at"), F.col("_v").alias("_was"))
    changes = rows.withColumn("_at", F.round("_t", 3)).join(before, [*keys, "_at"]).select(*keys, "_t", (F.col("_v") - F.col("_was")).alias("_v"), F.floor(F.col("_t") / tile_s).alias("_b"))
    other = series.select(*keys, seconds(series).alias("_t"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    tiles = changes.select(*keys, "_b").distinct()
    copies = other.select("*", F.explode(F.sequence(F.floor((F.col("_t") - ahead) / tile_s), F.floor((F.col("_t") + back) / tile_s))).alias("_b"))
    starts = asof_join(tiles.withColumn("_from", F.col("_b") * tile_s - back), other.withColumnRenamed("_t", "_seen"), keys, "_from", "_seen", ["_seen", "_v"])
    starts = starts.where("_seen IS NOT NULL").select(*keys, F.col("_seen").alias("_t"), "_v", "_b")
    held = copies.join(tiles, [*keys, "_b"], "left_semi").select(*keys, "_t", "_v", "_b").unionByName(starts).distinct()

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("_t")
        st, sv = right["_t"].to_numpy(float), right["_v"].to_numpy(float)
        t, x = left["_t"].to_numpy(float), left["_v"].to_numpy(float)
        total = np.zeros((len(lags), len(MOMENTS)))
        # rows times lags, a block of rows at a time
        for at in range(0, len(t), 4096):
            then = t[at : at + 4096, None] - np.array(lags)
            y = _step(st, sv, then) - _step(st, sv, then - horizon)
            own = np.broadcast_to(x[at : at + 4096, None], y.shape)
            good = np.isfinite(y) & np.isfinite(own)
            a, b = np.where(good, own, 0.0), np.where(good, y, 0.0)
            total += np.stack([good.sum(0), a.sum(0), b.sum(0), (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)], axis=1)
        out = pd.DataFrame(total, columns=list(MOMENTS)).assign(lag=np.arange(len(lags), dtype=np.int32))
        return out.assign(**{k: left[k].iloc[0] for k in keys}) if len(left) else out.iloc[:0].assign(**{k: [] for k in keys})

    fields = [f for f in changes.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("lag", T.IntegerType()), *[T.StructField(m, T.DoubleType()) for m in MOMENTS]])
    named = held.withColumnsRenamed({k: f"_k_{k}" for k in keys}).withColumnRenamed("_b", "_kb")
    parts = changes.groupBy(*keys, "_b").cogroup(named.groupBy(*[f"_k_{k}" for k in keys], "_kb")).applyInPandas(sums, schema)
    return parts.groupBy(*keys, "lag").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def lag_scan(reference: DataFrame, series: DataFrame, keys: Sequence[str], time: str, value: str, lags: Sequence[float], horizon: float, *, tile_s: float, least: int = 10) -> DataFrame:
    """keys, lag (seconds), n, corr: NULL with ``least`` pairs or fewer, or where the series does not change."""
    m = lag_moments(reference, series, keys, time, value, lags, horizon, tile_s=tile_s)
    var = lambda s, q: F.col(q) - F.col(s) * F.col(s) / F.col("n")
    vx, vy = var("x", "xx"), var("y", "yy")
    corr = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(vx * vy)
    seconds = F.element_at(F.array(*[F.lit(float(x)) for x in lags]), F.col("lag") + 1)
    return m.select(*keys, seconds.alias("lag"), F.col("n").cast("long").alias("n"), F.when((F.col("n") > least) & (vx > 0) & (vy > 1e-18), corr).alias("corr"))


def best_lag(scan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lag of the largest correlation (the smallest of equal ones)."""
    return scan.where("corr IS NOT NULL").groupBy(*keys).agg(F.max_by("lag", F.struct("corr", -F.col("lag"))).alias("lag"), F.max("corr").alias("corr"))


def distributed_lags(grid: DataFrame, keys: Sequence[str], time: str, cause: str, effect: str, lags: int, *, rows: int = 16_384) -> DataFrame:
    """keys, n, lag (0 .. lags), beta, cumulative, share: least squares of the change of ``effect`` on the last ``lags`` + 1
    changes of ``cause``, without a constant; ``share`` is the cumulative response over the whole.

    ``grid`` is even in time; a row without a value breaks the changes next to it, and rows with a gap in their
    window are left out. Each row tile gives its normal equations; they are added and solved once for each key.
    """
    keys, k = list(keys), lags + 1
    tiled = tiling.tile(grid.select(*keys, time, F.col(cause).cast("double").alias("_c"), F.col(effect).cast("double").alias("_e")), keys, time, behind=k, rows=rows)

    def equations(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(tiling.ROW)
        dc, de = np.diff(group["_c"].to_numpy(float), prepend=np.nan), np.diff(group["_e"].to_numpy(float), prepend=np.nan)
        total = np.zeros(k * k + k + 2)
        if len(group) > lags:
            x = np.lib.stride_tricks.sliding_window_view(dc, k)[:, ::-1]
            y, own = de[lags:], ~group[tiling.HALO].to_numpy(bool)[lags:]
            good = own & np.isfinite(x).all(axis=1) & np.isfinite(y)
            x, y = x[good], y[good]
            total = np.concatenate([(x.T @ x).ravel(), x.T @ y, [len(y), y @ y]])
        return pd.DataFrame({**{c: [group[c].iloc[0]] for c in keys}, "sums": [total]})

    fields = [f for f in grid.schema.fields if f.name in keys]
    parts = tiled.groupBy(*keys, tiling.TILE).applyInPandas(equations, T.StructType([*fields, T.StructField("sums", T.ArrayType(T.DoubleType()))]))
    added = parts.select(*keys, F.posexplode("sums").alias("at", "v")).groupBy(*keys, "at").agg(F.sum("v").alias("v"))
    whole = added.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("s")).select(*keys, F.col("s.v").alias("sums"))

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                s = np.asarray(r["sums"], float)
                beta, *_ = np.linalg.lstsq(s[: k * k].reshape(k, k), s[k * k : k * k + k], rcond=None)
                total = np.cumsum(beta)
                share = total / total[-1] if total[-1] != 0 else np.full(k, math.nan)
                out.append(pd.DataFrame({**{c: r[c] for c in keys}, "n": int(s[-2]), "lag": np.arange(k, dtype=np.int32), "beta": beta, "cumulative": total, "share": share}))
            if out:
                yield pd.concat(out)

    kinds = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("lag", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("beta", "cumulative", "share")]])
    return whole.mapInPandas(solve, kinds)


def response_times(response: DataFrame, keys: Sequence[str], step: float, shares: Sequence[float] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """When the cumulative response first comes to each share of the whole, in seconds, and the lag of the largest coefficient."""
    first = [F.min(F.when(F.col("share") >= s, F.col("lag") * step)).alias(f"t_{round(100 * s)}") for s in shares]
    return response.groupBy(*keys).agg(F.max("n").alias("n"), *first, (F.max_by("lag", F.struct("beta", -F.col("lag"))) * step).alias("t_peak"), F.sum("beta").alias("total"))
