"""Values that last from an event on, over any number of rows: carried from tile to tile by one row per tile.

A tile of rows sees the events inside it.  What it inherits from before its first row comes from a table with one row
per key and tile: the last event of each tile, carried over the tiles without events.  So a session or a run of equal
prices may be longer than any tile or overlap, and no task sorts a whole key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.operators import tiling


def since_event(
    numbered: DataFrame,
    keys: Sequence[str],
    ts: str,
    event: Column,
    *,
    held: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    tile_rows: int = 2 * tiling.COARSE_ROWS,
) -> DataFrame:
    """Add, for every row, ``held`` columns (values at the last event so far, that row's included) and ``sums``
    columns (totals since that event, missing counts as zero); NULL before the first event.

    ``event`` is a condition over a row and the row before it (``F.lag(...).over(tiling.tile_window(keys))``); ``held``
    are expressions of the event's row.  ``numbered`` has the row numbers of ``tiling.number_rows``.
    """
    keys, held, sums = list(keys), dict(held or {}), dict(sums or {})
    w = tiling.tile_window(keys)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    own = ~F.col(tiling.HALO)
    tiled = tiling.tile(numbered, keys, ts, behind=1, rows=tile_rows)
    tiled = tiled.withColumn("_event", event & own)
    tiled = tiled.withColumns({f"_run_{k}": F.sum(F.when(own, F.coalesce(x, F.lit(0.0)))).over(upto) for k, x in sums.items()})
    at_event = F.struct(
        F.lit(True).alias("is"),
        *[x.alias(f"held_{k}") for k, x in held.items()],
        *[(F.col(f"_run_{k}") - F.coalesce(x, F.lit(0.0))).alias(f"base_{k}") for k, x in sums.items()],
    )
    tiled = tiled.withColumn("_last", F.last(F.when(F.col("_event"), at_event), ignorenulls=True).over(upto))
    # one row per tile: its last event, and what its sums come to
    ends = tiled.filter(own).groupBy(*keys, tiling.TILE).agg(
        F.max_by(F.struct("_last", *[f"_run_{k}" for k in sums]), tiling.ROW).alias("_end"))
    before = Window.partitionBy(*keys).orderBy(tiling.TILE).rowsBetween(Window.unboundedPreceding, -1)
    over_tiles = before.rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumns({f"_all_{k}": F.sum(f"_end._run_{k}").over(over_tiles) for k in sums})
    carried = ends.select(
        *keys,
        tiling.TILE,
        F.last(F.when(F.col("_end._last").isNotNull(), F.struct(
            *[F.col(f"_end._last.held_{k}").alias(f"held_{k}") for k in held],
            *[(F.col(f"_all_{k}") - F.col(f"_end._run_{k}") + F.col(f"_end._last.base_{k}")).alias(f"base_{k}") for k in sums],
            F.lit(True).alias("is"),
        )), ignorenulls=True).over(before).alias("_in"),
        *[(F.col(f"_all_{k}") - F.col(f"_end._run_{k}")).alias(f"_before_{k}") for k in sums],
    )
    joined = tiled.filter(own).join(carried, [*keys, tiling.TILE], "left")
    here = F.col("_last").isNotNull()
    out = {k: F.when(here, F.col(f"_last.held_{k}")).otherwise(F.col(f"_in.held_{k}")) for k in held}
    out |= {
        k: F.when(here, F.col(f"_run_{k}") - F.col(f"_last.base_{k}")).otherwise(
            F.col(f"_before_{k}") - F.col(f"_in.base_{k}") + F.col(f"_run_{k}"))
        for k in sums
    }
    done = joined.withColumns(out).drop("_event", "_last", "_in", *[f"_run_{k}" for k in sums], *[f"_before_{k}" for k in sums])
    return tiling.untile(done, keep_row=True)
