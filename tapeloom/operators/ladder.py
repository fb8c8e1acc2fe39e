"""Books at any instant: a base ladder for each tile of rows plus the level changes inside it.

Events and questions of a key are numbered together and cut into tiles. What stands in the book when a tile begins comes from a
table of the tiles' last word on each level: a level holds its size until the next tile that mentions it or that has
a snapshot, and is copied into the tiles in between. So every question is answered inside its tile; nothing before the
tile is replayed, and a market without snapshots spreads over many tasks like any other.

Inside a tile the sizes of all levels after all rows are one matrix, filled forward with numpy, a block of rows at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tapeloom.operators import tiling
from tapeloom.session import ensure_checkpoint_dir

TILE_ROWS = 4096
#: Cells (rows times levels) filled at once.
CELLS = 1 << 21
EVENT, QUESTION, BASE, FRESH = 0, 1, 2, 3
NUMBERS = ("bid", "bid_size", "ask", "ask_size", "depth_bid", "depth_ask", "level_size")


def _sizes(rows: pd.DataFrame, levels: np.ndarray, which: np.ndarray, standing: np.ndarray) -> np.ndarray:
    """Sizes of all levels after each row: ``which`` is the row's level or -1, ``standing`` the sizes before the first."""
    n = len(rows)
    said = np.full((n + 1, len(levels)), -1, np.int64)
    said[0] = 0
    snapshot = np.flatnonzero(rows["is_snapshot"].to_numpy(bool)) + 1
    said[snapshot] = snapshot[:, None]
    change = np.flatnonzero(which >= 0)
    said[change + 1, which[change]] = change + 1
    # the last row that spoke of each level; a snapshot speaks of all
    last = np.maximum.accumulate(said, axis=0)[1:]
    values = np.zeros((n + 1, len(levels)))
    values[0] = standing
    values[change + 1, which[change]] = rows["size"].to_numpy(float)[change]
    return np.take_along_axis(values, last, axis=0)


def _answer(keys: list[str], reach: float, depth: int):
    def answer(group: pd.DataFrame) -> pd.DataFrame:
        kind = group["_kind"].to_numpy()
        base, fresh = group[kind == BASE], bool(group["is_snapshot"].to_numpy(bool)[kind == FRESH].any())
        rows = group[kind <= QUESTION].sort_values(tiling.ROW, ignore_index=True)
        side, price = (pd.concat([base[c], rows[c][rows["_kind"] == EVENT]]) for c in ("side", "price"))
        found = pd.DataFrame({"side": side, "price": price}).drop_duplicates().sort_values(["side", "price"], ignore_index=True)
        index = pd.MultiIndex.from_frame(found)
        is_bid, level = (found["side"] == "B").to_numpy(), found["price"].to_numpy(float)
        place = lambda df: index.get_indexer(pd.MultiIndex.from_arrays([df["side"], df["price"]])) if len(found) else np.full(len(df), -1)
        event = rows["_kind"].to_numpy() == EVENT
        named = place(rows)
        which = np.where(event, named, -1)
        standing = np.zeros(len(found))
        standing[place(base)] = base["size"].to_numpy(float)
        seen = np.maximum.accumulate(rows["is_snapshot"].to_numpy(bool)) | fresh if len(rows) else np.zeros(0, bool)
        out = []
        step = max(1, CELLS // max(len(found), 1))
        for at in range(0, len(rows), step):
            part = rows.iloc[at : at + step]
            size = _sizes(part, level, which[at : at + step], standing)
            standing = size[-1]
            asked = np.flatnonzero(part["_asked"].to_numpy(bool))
            size = size[asked]
            held = size > 0
            bid = np.where(held & is_bid, level, -np.inf).max(axis=1, initial=-np.inf)
            ask = np.where(held & ~is_bid, level, np.inf).min(axis=1, initial=np.inf)
            of = lambda best, own: (size * ((level == best[:, None]) & own)).sum(axis=1)  # noqa: B023, E731
            own = named[at : at + step][asked]
            res = part.iloc[asked][[*keys, "query"]].copy()
            middle = np.where(np.isfinite(bid) & np.isfinite(ask), (bid + np.where(np.isfinite(ask), ask, 0)) / 2, np.nan)[:, None]
            columns = {
                "bid": np.where(np.isfinite(bid), bid, np.nan), "bid_size": np.where(np.isfinite(bid), of(bid, is_bid), np.nan),
                "ask": np.where(np.isfinite(ask), ask, np.nan), "ask_size": np.where(np.isfinite(ask), of(ask, ~is_bid), np.nan),
                "depth_bid": np.where(np.isfinite(middle[:, 0]), (size * (is_bid & (level >= middle - reach))).sum(axis=1), np.nan),
                "depth_ask": np.where(np.isfinite(middle[:, 0]), (size * (~is_bid & (level <= middle + reach))).sum(axis=1), np.nan),
                "level_size": np.where(own >= 0, size[np.arange(len(own)), own] if len(found) else 0.0, 0.0),
            }
            for c, values in columns.items():
                res[c] = values
            res["n_levels"] = held.sum(axis=1)
            res["fresh"] = seen[at : at + step][asked]
            if depth:
                order = np.argsort(np.where(is_bid, -level, level), kind="stable")
                for name, side_levels in (("bids", order[is_bid[order]]), ("asks", order[~is_bid[order]])):
                    res[name] = pd.Series([[{"price": p, "size": s} for p, s in zip(level[side_levels][h][:depth], z[side_levels][h][:depth])] for z, h in zip(size, held[:, side_levels])], res.index, dtype=object)
            out.append(res)
        empty = group.iloc[:0][[*keys, "query"]].assign(**{c: pd.Series([], dtype=object if c in ("bids", "asks") else float) for c in (*NUMBERS, "n_levels", "fresh", *(("bids", "asks") if depth else ()))})
        return pd.concat(out) if out else empty

    return answer


def book_states(events: DataFrame, keys: Sequence[str], time: str, *, tie: Sequence[str] = ("seq",), questions: DataFrame | None = None, reach: float = 10.0, depth: int = 0, rows: int = TILE_ROWS) -> DataFrame:
    """The book after every event, or at every question: keys, query, bid, bid_size, ask, ask_size, depth_bid and
    depth_ask (sizes within ``reach`` of the middle), level_size, n_levels, fresh (a snapshot has been seen), and with
    ``depth`` the first so many bids and asks as arrays of price and size.

    ``events``: keys, time, tie columns, side (B or S), price, size (the level's new size, 0 for none) and is_snapshot, which
    clears the book before its own level counts. ``questions``: keys, time, query, and side and price of the level whose
    size is asked (NULL: none); they see the events up to their own time. Without questions each event is one, named
    by the first tie column, and asks for its own level.
    """
    keys, tie = list(keys), list(tie)
    ensure_checkpoint_dir(events.sparkSession)
    plain = [F.col("side"), F.col("price").cast("double").alias("price")]
    told = events.select(
        *keys, tiling.epoch_seconds(events, time).cast("double").alias("_t"), *[F.col(c).alias(f"_tie_{c}") for c in tie], *plain, F.col("size").cast("double").alias("size"),
        F.coalesce("is_snapshot", F.lit(False)).alias("is_snapshot"), F.lit(EVENT).alias("_kind"), F.lit(questions is None).alias("_asked"), F.col(tie[0]).cast("string").alias("query"))
    if questions is not None:
        asked = questions.select(
            *keys, tiling.epoch_seconds(questions, time).cast("double").alias("_t"), *plain, F.lit(False).alias("is_snapshot"), F.lit(QUESTION).alias("_kind"), F.lit(True).alias("_asked"), F.col("query").cast("string").alias("query"))
        told = told.unionByName(asked, allowMissingColumns=True)
    numbered = tiling.number_rows(told, keys, "_t", tie=["_kind", *[f"_tie_{c}" for c in tie], "query"])
    placed = numbered.withColumn(tiling.TILE, F.floor(F.col(tiling.ROW) / rows)).drop("_t", *[f"_tie_{c}" for c in tie]).checkpoint()

    # the last word of each tile on each level, after the tile's last snapshot
    changes = placed.where(F.col("_kind") == EVENT)
    resets = changes.groupBy(*keys, tiling.TILE).agg(F.max(F.when(F.col("is_snapshot"), F.col(tiling.ROW))).alias("_reset"))
    after = F.col("_reset").isNull() | (F.col(tiling.ROW) >= F.col("_reset"))
    words = changes.join(resets, [*keys, tiling.TILE]).where(after).groupBy(*keys, tiling.TILE, "side", "price").agg(F.max_by("size", tiling.ROW).alias("size"))
    tiles = placed.groupBy(*keys, tiling.TILE).agg(F.max(F.when(F.col("is_snapshot"), F.lit(True))).alias("_has"))
    in_order = Window.partitionBy(*keys).orderBy(tiling.TILE)
    later = in_order.rowsBetween(1, Window.unboundedFollowing)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    tiles = tiles.select(
        *keys, tiling.TILE, F.first(F.when(F.col("_has"), F.col(tiling.TILE)), ignorenulls=True).over(later).alias("_next_reset"), F.max(tiling.TILE).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_end"),
        F.coalesce(F.max("_has").over(earlier), F.lit(False)).alias("_fresh")).checkpoint()
    level = Window.partitionBy(*keys, "side", "price").orderBy(tiling.TILE)
    spans = words.withColumn("_next", F.lead(tiling.TILE).over(level)).join(tiles, [*keys, tiling.TILE]).where("size > 0")
    until = F.least("_next", "_next_reset", "_end")
    base = spans.where(until > F.col(tiling.TILE)).select(*keys, F.explode(F.sequence(F.col(tiling.TILE) + 1, until)).alias(tiling.TILE), "side", "price", "size", F.lit(BASE).alias("_kind"), F.lit(False).alias("is_snapshot"))
    header = tiles.select(*keys, tiling.TILE, F.lit(FRESH).alias("_kind"), F.col("_fresh").alias("is_snapshot"))
    whole = placed.drop(tiling.TOTAL).unionByName(base, allowMissingColumns=True).unionByName(header, allowMissingColumns=True)

    fields = [f for f in events.schema.fields if f.name in keys]
    pair = T.ArrayType(T.StructType([T.StructField("price", T.DoubleType()), T.StructField("size", T.DoubleType())]))
    schema = T.StructType([*fields, T.StructField("query", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in NUMBERS], T.StructField("n_levels", T.LongType()), T.StructField("fresh", T.BooleanType()), *([T.StructField(c, pair) for c in ("bids", "asks")] if depth else [])])
    out = whole.groupBy(*keys, tiling.TILE).applyInPandas(_answer(keys, reach, depth), schema)
    return out.select(*keys, "query", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in NUMBERS], *[f.name for f in schema.fields if f.name in ("n_levels", "fresh", "bids", "asks")])
