"""Jumps of one series and how soon another one follows: half moves, full moves, first touches, a placebo before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.operators import tiling
from tapeloom.operators.asof import asof_join
from tapeloom.operators.orders import cooldown
from tapeloom.operators.passage import first_passage
from tapeloom.session import ensure_checkpoint_dir

#: A price that differs by less has not moved.
MOVED = 1e-9


def jumps(grid: DataFrame, keys: Sequence[str], time: str, value: str, *, steps: int, jump: float, refractory: float) -> DataFrame:
    """keys, t_prev, t_event, p_prev, p_event, move: changes over ``steps`` grid rows of at least ``jump``; after a kept one,
    nothing counts for ``refractory`` seconds."""
    keys = list(keys)
    w = tiling.tile_window(keys)
    rows = tiling.tile(grid.select(*keys, tiling.epoch_seconds(grid, time).cast("double").alias("t_event"), F.col(value).alias("p_event")), keys, "t_event", behind=steps)
    back = rows.withColumns({"t_prev": F.lag("t_event", steps).over(w), "p_prev": F.lag("p_event", steps).over(w)})
    moved = tiling.untile(back).withColumn("move", F.col("p_event") - F.col("p_prev")).where(F.abs("move") >= jump)
    return cooldown(moved, keys, "t_event", refractory).where("kept").drop("kept")


def _ask(events: DataFrame, keys: list[str], name: str, column: int, start: Column, stop: Column, level: Column) -> DataFrame:
    return events.select(*keys, F.concat_ws("|", F.lit(name), "event").alias("query"), F.lit(column).alias("column"), start.alias("start"), stop.alias("stop"), level.alias("level"), (F.col("move") > 0).alias("rising"))


def reaction_events(grid: DataFrame, updates: DataFrame, book: DataFrame, keys: Sequence[str], *, time: str = "t", value: str = "p", book_time: str = "t", steps: int, jump: float, refractory: float, horizon: float, placebo: float, shares: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """One row for each jump of ``grid``: keys, t_event, t_prev, t0, move, p_prev, p_event, mid0, delay_first, delay_ask,
    delay_bid, delay_placebo, and delay_<share> with censored_<share> for each share in hundredths (seconds from t0).

    ``updates`` holds every change of the jumping series (grid rows count too). t0 is the first of them after t_prev that has
    made half of the move, or t_event. The book's middle reaches a share of the move from its value at t_prev, within
    ``horizon`` of t_prev; its first touch is the first ask or bid after t0 that moved the same way; the placebo is the
    same from ``placebo`` seconds before t0 up to t0 itself. What does not happen in time is NULL, and censored.
    """
    keys = list(keys)
    ensure_checkpoint_dir(grid.sparkSession)
    sign = F.signum("move")
    found = jumps(grid, keys, time, value, steps=steps, jump=jump, refractory=refractory)
    found = found.withColumn("event", F.col("t_event").cast("string")).checkpoint()
    seconds = lambda df, c: tiling.epoch_seconds(df, c).cast("double").alias("t")
    path = grid.select(*keys, seconds(grid, time), F.col(value).alias("p")).unionByName(updates.select(*keys, seconds(updates, time), F.col(value).alias("p")))
    half = first_passage(_ask(found, keys, "half", 0, F.col("t_prev"), F.col("t_event"), F.col("p_prev") + F.col("move") / 2), path, keys, "t", ["p"])
    half = half.select(*keys, F.substring_index("query", "|", -1).alias("event"), F.col("passage").alias("_half"))
    events = found.join(half, [*keys, "event"], "left").withColumn("t0", F.coalesce("_half", "t_event")).drop("_half")

    quotes = book.select(*keys, seconds(book, book_time), "bid", "ask", ((F.col("bid") + F.col("ask")) / 2).alias("mid"))
    for at, columns in (("t_prev", {"mid": "mid0"}), ("t0", {"ask": "_ask0", "bid": "_bid0"}), (None, {"ask": "_ask1", "bid": "_bid1"})):
        events = events if at else events.withColumn("_before", F.col("t0") - placebo)
        seen = quotes.select(*keys, "t", *[F.col(a).alias(b) for a, b in columns.items()])
        events = asof_join(events, seen, keys, at or "_before", "t", list(columns.values()))
    events = events.checkpoint()

    later, touch = F.col("t_prev") + horizon, F.col("t0") + horizon
    beyond = lambda c: F.col(c) + sign * MOVED
    asked = [_ask(events, keys, f"s{round(100 * s)}", 0, F.col("t_prev"), later, F.col("mid0") + sign * (s * F.abs("move") - 1e-12)) for s in shares]
    # without a middle before the jump, nothing is measured against the book after it
    ready = F.col("mid0").isNotNull()
    for name, column, start, stop, level in (
        ("ask", 1, F.col("t0"), touch, beyond("_ask0")), ("bid", 2, F.col("t0"), touch, beyond("_bid0")),
        ("pask", 1, F.col("_before"), F.col("t0"), beyond("_ask1")), ("pbid", 2, F.col("_before"), F.col("t0"), beyond("_bid1")),
    ):
        asked.append(_ask(events.where(ready), keys, name, column, start, stop, level))
    queries = asked[0]
    for more in asked[1:]:
        queries = queries.unionByName(more)
    hits = first_passage(queries, quotes, keys, "t", ["mid", "ask", "bid"])
    kinds = [f"s{round(100 * s)}" for s in shares] + ["ask", "bid", "pask", "pbid"]
    kind, event = F.substring_index("query", "|", 1), F.substring_index("query", "|", -1).alias("event")
    # one row for each event and kind: a conditional minimum is that value
    wide = hits.withColumn("_kind", kind).groupBy(*keys, event).agg(*[F.min(F.when(F.col("_kind") == k, F.col("passage"))).alias(f"_{k}") for k in kinds])
    out = events.join(wide, [*keys, "event"], "left")
    before_t0 = lambda c: F.when(F.col(c) < F.col("t0"), F.col(c))
    made = [F.col(f"_s{round(100 * s)}") for s in shares]
    return out.select(
        *keys, "t_event", "t_prev", "t0", "move", "p_prev", "p_event", "mid0",
        (F.least("_ask", "_bid") - F.col("t0")).alias("delay_first"), (F.col("_ask") - F.col("t0")).alias("delay_ask"), (F.col("_bid") - F.col("t0")).alias("delay_bid"),
        (F.least(before_t0("_pask"), before_t0("_pbid")) - F.col("_before")).alias("delay_placebo"),
        *[(m - F.col("t0")).alias(f"delay_{round(100 * s)}") for s, m in zip(shares, made, strict=True)],
        *[m.isNull().alias(f"censored_{round(100 * s)}") for s, m in zip(shares, made, strict=True)])
