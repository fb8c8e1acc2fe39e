"""Row tiles: bounded window partitions for long keyed series.

``Window.partitionBy(symbol)`` puts a whole symbol in one task, which fails when one symbol holds a large part of the
table.  Here every key is cut into tiles of a fixed number of rows.  A tile also receives a copy of the last ``behind``
rows of the tiles before it (and the first ``ahead`` rows after it), so any frame of at most that length gives exactly
the value it would give on the uncut series.  The copies are dropped at the end.

Row numbers come from bucket counts and their running total (a table of one row per key and bucket), so no task ever
sorts a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

ROW, TOTAL, TILE, HALO, COARSE, FINE = "_row", "_total", "_tile", "_halo", "_coarse", "_fine"
INTERNAL = (ROW, TOTAL, TILE, HALO, COARSE, FINE)

FINE_ROWS = 512
COARSE_ROWS = 8192


def epoch_seconds(df: DataFrame, ts: str) -> Column:
    kind = dict(df.dtypes)[ts]
    if kind == "timestamp":
        return F.unix_micros(F.col(ts)) / F.lit(1_000_000)
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000)
    if kind == "date":
        return F.unix_date(F.col(ts)) * F.lit(86400)
    return F.col(ts)


def number_rows(
    df: DataFrame, keys: Sequence[str], ts: str, *, bucket_s: float = 86400.0, tie: Sequence[str] = ()
) -> DataFrame:
    """Add ``_row`` (0, 1, 2 … per key in time order) and ``_total`` (rows per key)."""
    keys = list(keys)
    tagged = df.withColumn("_bucket", F.floor(epoch_seconds(df, ts) / F.lit(float(bucket_s))))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_in_bucket"))
        .select(
            *keys,
            "_bucket",
            F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_before"),
            F.sum("_in_bucket").over(Window.partitionBy(*keys)).alias(TOTAL),
        )
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts, *tie)
    return (
        tagged.join(offsets, [*keys, "_bucket"])
        .withColumn(ROW, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_before")
    )


def tile(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    *,
    behind: int,
    ahead: int = 0,
    rows: int = 4 * COARSE_ROWS,
    bucket_s: float = 86400.0,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Numbered rows copied into every tile that needs them; ``_halo`` marks the copies."""
    numbered = df if ROW in df.columns else number_rows(df, keys, ts, bucket_s=bucket_s, tie=tie)
    own = F.floor(F.col(ROW) / rows)
    first = F.floor(F.greatest(F.col(ROW) - ahead, F.lit(0)) / rows)
    last = F.floor(F.least(F.col(ROW) + behind, F.col(TOTAL) - 1) / rows)
    return (
        numbered.withColumn(TILE, F.explode(F.sequence(first, last)))
        .withColumn(HALO, F.col(TILE) != own)
        .withColumn(COARSE, F.floor(F.col(ROW) / COARSE_ROWS))
        .withColumn(FINE, F.floor(F.col(ROW) / FINE_ROWS))
    )


def tile_window(keys: Sequence[str]):
    """The one window specification of a tile.  Its sort order nests the recursion blocks (see ``layers.ema``)."""
    return Window.partitionBy(*keys, TILE).orderBy(COARSE, FINE, ROW)


def untile(df: DataFrame, keep_row: bool = False) -> DataFrame:
    drop = [c for c in INTERNAL if not (keep_row and c in (ROW, TOTAL))]
    return df.filter(~F.col(HALO)).drop(*drop)
