"""Supertrend: a ratchet band with reset, exact across tiles.

The lower band is the running maximum of (mid - m ATR) until a close falls to it, then restarts; the upper band is its
mirror image; the trend flips when a close crosses the previous opposite band.  A tile does not know the band it starts
from, but the band matters only until the first reset.  Pass 1 summarises each tile as a step function: for every
possible first reset inside the tile, the threshold that causes it and the state at the end of the tile.  The summaries
(a few rows per tile) are chained per key, and pass 2 replays every tile from its true entry state.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tapeloom.operators.tiling import ROW, TILE, TOTAL


def _walk(values: np.ndarray, closes: np.ndarray, start: int, band: float) -> tuple[np.ndarray, float]:
    """Bands from ``start`` on, given the live band before it (-inf: none).  Returns the band to hand over."""
    out = np.empty(len(values) - start)
    for i in range(start, len(values)):
        v = values[i]
        band = v if not band > v else band
        out[i - start] = band
        if closes[i] <= band:
            band = -np.inf
    return out, band


def _exits(values: np.ndarray, closes: np.ndarray) -> tuple[list[float], list[float]]:
    """Step function entry band -> exit band of one tile.

    An entry band m survives until the first close at or below max(m, running max of values).  Only prefix minima of
    the closes before the first reset without entry band can come earlier, each for m at or above that close.
    """
    n = len(values)
    base, base_exit = _walk(values, closes, 0, -np.inf)
    hits = np.nonzero(closes <= np.maximum.accumulate(values))[0]
    first = int(hits[0]) if len(hits) else n
    lows = np.minimum.accumulate(closes[:first]) if first else np.empty(0)
    records = [k for k in range(first) if k == 0 or lows[k] < lows[k - 1]]
    thresholds, exits = [], []
    for k in records:
        band, stop = -np.inf, None
        for i in range(k + 1, n):
            band = values[i] if not band > values[i] else band
            if band == base[i]:
                stop = base_exit
                break
            if closes[i] <= band:
                band = -np.inf
        thresholds.append(float(closes[k]))
        exits.append(float(band if stop is None else stop))
    # below the lowest record the entry band lives until ``first``; with no reset at all the larger band is kept
    low_exit = base_exit if first < n else float("nan")
    thresholds.append(-np.inf)
    exits.append(float(low_exit))
    if first == n:
        thresholds.append(float("nan"))
        exits.append(float(np.max(values)))
    return thresholds, exits


def _apply_exits(thresholds: Sequence[float], exits: Sequence[float], m: float) -> float:
    """Exit band for entry band m: the earliest record whose close is at or below m."""
    top = -np.inf
    for t, e in zip(thresholds, exits):
        if np.isnan(t):
            top = e
    for t, e in zip(thresholds, exits):
        if np.isnan(t):
            continue
        if m >= t and t > -np.inf:
            return e
        if t == -np.inf:
            return max(m, top) if np.isnan(e) else e
    return -np.inf


def _series(pdf: pd.DataFrame, mult: float):
    c, a = pdf["close"].to_numpy(float), pdf["_atr"].to_numpy(float)
    mid = (pdf["high"].to_numpy(float) + pdf["low"].to_numpy(float)) / 2.0
    ok = np.isfinite(c) & np.isfinite(a) & np.isfinite(mid)
    clean = lambda x: np.where(np.isfinite(x), x, -np.inf)
    low = clean(np.where(ok, mid - mult * a, -np.inf))
    high = clean(np.where(ok, -(mid + mult * a), -np.inf))
    return c, a, low, high, np.where(np.isfinite(c), c, np.inf), np.where(np.isfinite(c), -c, np.inf), ok


def supertrend(
    df: DataFrame, keys: Sequence[str], *, atr: str, mult: float = 3.0, tile_rows: int = 32768,
    dist: str = "supertrend_dist", direction: str = "supertrend_dir",
) -> DataFrame:
    """Add the signed distance to the Supertrend line in ATR and its direction.  ``df`` carries ``_row``."""
    keys = list(keys)
    src = df.withColumn(TILE, F.floor(F.col(ROW) / tile_rows).cast("long")).withColumn("_atr", F.col(atr).cast("double"))
    slim = src.filter(F.col("_atr").isNotNull()).select(*keys, TILE, ROW, "high", "low", "close", "_atr")
    key_fields = [f for f in df.schema.fields if f.name in keys]
    summary_schema = T.StructType(key_fields + [
        T.StructField(TILE, T.LongType()),
        T.StructField("lt", T.ArrayType(T.DoubleType())), T.StructField("le", T.ArrayType(T.DoubleType())),
        T.StructField("ut", T.ArrayType(T.DoubleType())), T.StructField("ue", T.ArrayType(T.DoubleType())),
    ])

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ROW)
        _, _, low, high, lc, hc, _ = _series(pdf, mult)
        lt, le = _exits(low, lc)
        ut, ue = _exits(high, hc)
        return pd.DataFrame([[*pdf.iloc[0][keys].tolist(), int(pdf[TILE].iloc[0]), lt, le, ut, ue]],
                            columns=summary_schema.names)

    entry_schema = T.StructType(key_fields + [
        T.StructField(TILE, T.LongType()), T.StructField("_low_in", T.DoubleType()), T.StructField("_high_in", T.DoubleType())])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TILE)
        lo = hi = -np.inf
        rows = []
        for r in pdf.itertuples(index=False):
            rows.append([*[getattr(r, k) for k in keys], getattr(r, "tile_"), lo, hi])
            lo, hi = _apply_exits(r.lt, r.le, lo), _apply_exits(r.ut, r.ue, hi)
        return pd.DataFrame(rows, columns=entry_schema.names)

    summaries = slim.groupBy(*keys, TILE).applyInPandas(summarise, summary_schema)
    chain_in = summaries.withColumnRenamed(TILE, "tile_")

    def chain_named(pdf: pd.DataFrame) -> pd.DataFrame:
        return chain(pdf.assign(**{TILE: pdf["tile_"]}))

    entries = chain_in.groupBy(*keys).applyInPandas(chain_named, entry_schema)

    band_schema = T.StructType(key_fields + [
        T.StructField(ROW, T.LongType()), T.StructField("_lower", T.DoubleType()), T.StructField("_upper", T.DoubleType())])

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ROW)
        _, _, low, high, lc, hc, _ = _series(pdf, mult)
        lower, _ = _walk(low, lc, 0, float(pdf["_low_in"].iloc[0]))
        upper, _ = _walk(high, hc, 0, float(pdf["_high_in"].iloc[0]))
        out = pdf[[*keys, ROW]].copy()
        out["_lower"] = np.where(np.isfinite(lower), lower, np.nan)
        out["_upper"] = np.where(np.isfinite(upper), -upper, np.nan)
        return out

    bands = slim.join(entries, [*keys, TILE]).groupBy(*keys, TILE).applyInPandas(replay, band_schema)
    return _trend(src.join(bands, [*keys, ROW], "left"), keys, dist, direction)


def _trend(df: DataFrame, keys: Sequence[str], dist: str, direction: str) -> DataFrame:
    """Trend state from the band crossings: the last one-sided crossing, flipped by every later double crossing.

    The state before a tile is carried through a table with one row per key and tile.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*keys, TILE).orderBy(ROW)
    nn = lambda c: F.when(~F.isnan(c), F.col(c))
    df = df.withColumn("_lower", nn("_lower")).withColumn("_upper", nn("_upper"))
    # the first row of a tile needs the band of the row before it
    ends = df.groupBy(*keys, TILE).agg(
        F.max_by(F.struct("_lower", "_upper"), ROW).alias("_end")).withColumn(TILE, F.col(TILE) + 1)
    df = df.join(ends, [*keys, TILE], "left")
    prev = lambda c: F.coalesce(F.lag(c).over(order), F.when(F.row_number().over(order) == 1, F.col(f"_end.{c}")))
    df = df.withColumn("_pl", prev("_lower")).withColumn("_pu", prev("_upper"))
    up = F.coalesce(F.col("close") > F.col("_pu"), F.lit(False))
    down = F.coalesce(F.col("close") < F.col("_pl"), F.lit(False))
    df = df.withColumn("_set", F.when(up & ~down, F.lit(1.0)).when(down & ~up, F.lit(-1.0))).withColumn(
        "_flip", (up & down).cast("long"))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_flips", F.sum("_flip").over(run))
    mark = F.when(F.col("_set").isNotNull(), F.struct(F.col("_set").alias("s"), F.col("_flips").alias("f")))
    df = df.withColumn("_mark", F.last(mark, ignorenulls=True).over(run))
    tiles = df.groupBy(*keys, TILE).agg(F.max_by("_mark", ROW).alias("m"), F.max("_flips").alias("f"))
    # state at the end of each tile, as a sign to apply to (or replace) the entry state
    sign = lambda k: F.when(k % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    by_tile = Window.partitionBy(*keys).orderBy(TILE)
    tiles = tiles.withColumn("cum", F.sum("f").over(by_tile.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("m").isNotNull(), F.struct(
        F.col("m.s").alias("s"), (F.col("cum") - F.col("f") + F.col("m.f")).alias("c"))), ignorenulls=True).over(
        by_tile.rowsBetween(Window.unboundedPreceding, -1))
    tiles = tiles.withColumn("_last", last).select(
        *keys, TILE,
        F.coalesce(F.col("_last.s") * sign(F.col("cum") - F.col("f") - F.col("_last.c")), sign(F.col("cum") - F.col("f"))).alias("_entry"))
    df = df.join(tiles, [*keys, TILE], "left")
    state = F.when(F.col("_mark").isNotNull(), F.col("_mark.s") * sign(F.col("_flips") - F.col("_mark.f"))).otherwise(
        F.coalesce(F.col("_entry"), F.lit(1.0)) * sign(F.col("_flips")))
    line = F.when(F.col("_state") > 0, F.col("_lower")).otherwise(F.col("_upper"))
    return (
        df.withColumn("_state", state)
        .withColumn(direction, F.when(F.col("_atr").isNotNull(), F.col("_state")))
        .withColumn(dist, F.when(F.col("_atr").isNotNull(), F.try_divide(F.col("close") - line, F.col("_atr"))))
        .drop("_lower", "_upper", "_end", "_pl", "_pu", "_set", "_flip", "_flips", "_mark", "_entry", "_state", "_atr", TILE, ROW, TOTAL)
    )
