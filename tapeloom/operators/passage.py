"""First passage: the first row after a moment at which a series reaches a level, without joining windows.

The rows of a key are numbered and cut into tiles of ``rows``; each tile knows the largest and smallest value of every
column, tiles are nodes of coarser tiles, and so on until one node spans the longest key. A query looks in the tile it
starts in, from its own row on; if nothing there reaches its level it goes on among the following nodes one step coarser, and
from the first node whose extreme reaches the level it comes down again, to one tile. So a query costs two looks for
each step of the tree however far away its answer is, and a task holds one tile and the queries that look into it.

Inside a tile, all queries look at once: the running extremes over 1, 2, 4 … rows take the longest stretch that stays
below the level, in falling powers of two.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tapeloom.operators import tiling
from tapeloom.operators.asof import asof_join
from tapeloom.session import ensure_checkpoint_dir

TILE_ROWS, FAN = 4096, 4096


def first_reaching(values: np.ndarray, start: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first place from ``start`` on whose value is at least the level; the number of values if there is none."""
    n = len(values)
    steps = max(n, 1).bit_length()
    runs = [np.concatenate([np.where(np.isnan(values), -np.inf, values), np.full((1 << steps) + 1, -np.inf)])]
    for k in range(steps - 1):
        runs.append(np.maximum(runs[-1], np.append(runs[-1][1 << k :], np.full(1 << k, -np.inf))))
    at = np.minimum(start, n)
    for k in reversed(range(steps)):
        at = np.where((at < n) & (runs[k][at] < level), at + (1 << k), at)
    # the padding behind the last value never reaches a level, so whatever went past it found nothing
    return np.minimum(at, n)


def _look(keys: list[str], columns: list[str]):
    def look(queries: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("_at")
        base = int(nodes["_at"].iloc[0]) if len(nodes) else 0
        found = np.full(len(queries), len(nodes))
        start = np.maximum(queries["_from"].to_numpy(np.int64) - base, 0)
        which, rising = queries["column"].to_numpy(), queries["rising"].to_numpy(bool)
        level = queries["level"].to_numpy(float)
        for c in np.unique(which) if len(nodes) else ():
            for up in (True, False):
                mine = np.flatnonzero((which == c) & (rising == up))
                if len(mine):
                    sign = 1.0 if up else -1.0
                    found[mine] = first_reaching(sign * nodes[f"_{'high' if up else 'low'}_{c}"].to_numpy(float), start[mine], sign * level[mine])
        hit = found < len(nodes)
        safe = np.minimum(found, max(len(nodes) - 1, 0))
        times = nodes["_t"].to_numpy(float)
        out = queries[[*keys, "query", "column", "rising", "level", "stop"]].copy()
        out["_node"] = np.where(hit, base + safe, -1)
        out["_when"] = np.where(hit, times[safe] if len(nodes) else np.nan, np.nan)
        # nothing up to the last of these nodes: look no further when that is past the stop
        out["_over"] = ~hit & (queries["stop"].to_numpy(float) <= (times[-1] if len(nodes) else np.inf))
        return out

    return look


def first_passage(queries: DataFrame, series: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], *, rows: int = TILE_ROWS, fan: int = FAN, tie: Sequence[str] = ()) -> DataFrame:
    """keys, query, passage: the time of the first series row after ``start`` and up to ``stop`` at which the column
    reaches the level; NULL when none does.

    ``queries`` has the keys, query (a name of its own for each), column (place in ``columns``), start, stop, level and
    rising (at least the level, or else at most). Rows whose value is NULL reach nothing; a query whose level, start
    or stop is NULL gets NULL.
    """
    keys = list(keys)
    ensure_checkpoint_dir(series.sparkSession)
    seconds = tiling.epoch_seconds(series, time).cast("double")
    plain = series.select(*keys, seconds.alias("_t"), *tie, *[F.col(c).cast("double").alias(f"_v_{k}") for k, c in enumerate(columns)])
    numbered = tiling.number_rows(plain, keys, "_t", tie=tie).drop(*tie)
    both = [x for k in range(len(columns)) for x in (F.col(f"_v_{k}").alias(f"_high_{k}"), F.col(f"_v_{k}").alias(f"_low_{k}"))]
    leaves = numbered.select(*keys, F.col(tiling.ROW).alias("_at"), "_t", tiling.TOTAL, *both).checkpoint()
    longest = leaves.agg(F.max(tiling.TOTAL)).first()[0] or 0

    sizes, nodes = [rows], [leaves.drop(tiling.TOTAL)]
    span = rows
    while span < longest:
        coarse = F.floor(F.col("_at") / sizes[-1]).alias("_at")
        ends = [x for k in range(len(columns)) for x in (F.max(f"_high_{k}").alias(f"_high_{k}"), F.min(f"_low_{k}").alias(f"_low_{k}"))]
        nodes.append(nodes[-1].groupBy(*keys, coarse).agg(F.max("_t").alias("_t"), *ends).checkpoint())
        sizes.append(fan)
        span *= fan

    known = F.col("level").isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull()
    asked = queries.where(known).select(*keys, "query", F.col("column").cast("int").alias("column"), F.col("rising").cast("boolean").alias("rising"), F.col("level").cast("double").alias("level"), F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"))
    placed = asof_join(asked, leaves.withColumnRenamed("_t", "_seen"), keys, "start", "_seen", ["_at"], tie="_at")
    waiting = placed.select(*keys, "query", "column", "rising", "level", "stop", F.coalesce(F.col("_at") + 1, F.lit(0)).alias("_from"))

    kinds = {f.name: f.dataType for f in waiting.schema.fields}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in (*keys, "query", "column", "rising", "level", "stop")] + [
        T.StructField("_node", T.LongType()), T.StructField("_when", T.DoubleType()), T.StructField("_over", T.BooleanType())])

    def look(some: DataFrame, step: int) -> DataFrame:
        names = [f"_k{k}" for k in range(len(keys))]
        cell = lambda c: F.floor(F.col(c) / sizes[step])
        left = some.withColumn("_cell", cell("_from"))
        right = nodes[step].withColumn("_cell", cell("_at")).withColumnsRenamed(dict(zip(keys, names))).withColumnRenamed("_cell", "_of")
        # tiles that no query looks into stay at home
        wanted = left.select(*[F.col(a).alias(b) for a, b in zip(keys, names)], F.col("_cell").alias("_of")).distinct()
        right = right.join(wanted, [*names, "_of"], "left_semi")
        return left.groupBy(*keys, "_cell").cogroup(right.groupBy(*names, "_of")).applyInPandas(_look(keys, list(columns)), schema).checkpoint()

    carried = ["query", "column", "rising", "level", "stop"]
    answers, down = [], {}
    for step in range(len(nodes)):
        seen = look(waiting, step)
        hit = seen.where("_node >= 0")
        if step:
            down[step] = hit
        else:
            answers.append(hit)
        if step + 1 < len(nodes):
            # the place looked from is lost on the way: what follows the own node is one step coarser
            rest = seen.where("_node < 0 AND NOT _over").select(*keys, "query")
            waiting = waiting.join(rest, [*keys, "query"], "left_semi").withColumn("_from", F.floor(F.col("_from") / sizes[step]) + 1)
    below = None
    for step in reversed(range(1, len(nodes))):
        at_node = down[step] if below is None else down[step].unionByName(below)
        below = look(at_node.select(*keys, *carried, (F.col("_node") * sizes[step - 1]).alias("_from")), step - 1)
    if below is not None:
        answers.append(below)
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    passed = every.where(F.col("_when") <= F.col("stop")).select(*keys, "query", F.col("_when").alias("passage"))
    return queries.select(*keys, "query").join(passed, [*keys, "query"], "left")
