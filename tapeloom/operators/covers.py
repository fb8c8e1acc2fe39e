"""Linked markets: the cheapest guaranteed cover after every change of any leg, its episodes, and the time spent at each margin.

A cover is a set of tokens that pays at least one unit whatever happens. Its cost is a weighted sum of asks, so it
changes by weight times the change of one ask: costs are running sums of such steps (totals of time buckets plus sums
inside them), with a running count of the legs that have an ask. Nothing is replayed, and no task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.operators import tiling
from tapeloom.operators.asof import asof_join
from tapeloom.operators.intervals import islands
from tapeloom.operators.ranks import materialise


def running_total(rows: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], sums: Sequence[str], *, bucket_s: float = 86400.0) -> DataFrame:
    """Each of ``sums`` becomes its total per key so far, in order of time and ``order``."""
    keys = list(keys)
    cut = rows.withColumn("_b", F.floor(F.col(time) / F.lit(bucket_s)))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = cut.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    offsets = per.select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "_b").orderBy(time, *order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({c: F.sum(c).over(inside) for c in sums}).join(offsets, [*keys, "_b"])
    return out.withColumns({c: F.col(c) + F.col(f"_o_{c}") for c in sums}).drop("_b", *[f"_o_{c}" for c in sums])


def cover_margins(asks: DataFrame, vertices: DataFrame, group: Sequence[str], time: str, *, tie: str = "seq") -> DataFrame:
    """group, time, until, vertex, cost, margin: from each change of an ask to the next one, the cheapest cover that has all asks
    (the smallest vertex of equal ones; NULL without any) and one less its cost. The last change of a group lasts to NULL.

    ``asks``: group, token, time, tie, ask (NULL: none is offered). ``vertices``: group, vertex, token, weight; a cover
    names a token once. Of changes at one time the last counts.
    """
    group = list(group)
    t = tiling.epoch_seconds(asks, time).cast("double")
    rows = asks.select(*group, "token", t.alias("_t"), F.col(tie).alias("_tie"), F.col("ask").cast("double").alias("ask"))
    tiled = tiling.tile(rows, [*group, "token"], "_t", behind=1, tie=["_tie"])
    w = tiling.tile_window([*group, "token"])
    was = F.lag("ask").over(w)
    offered = lambda c: c.isNotNull().cast("long")
    steps = tiling.untile(tiled.withColumn("_d", F.coalesce("ask", F.lit(0.0)) - F.coalesce(was, F.lit(0.0))).withColumn("_n", offered(F.col("ask")) - offered(was)))
    legs = Window.partitionBy(*group, "vertex")
    covers = vertices.withColumn("_legs", F.count(F.lit(1)).over(legs))
    moves = steps.join(covers, [*group, "token"]).select(*group, "vertex", "_legs", "_t", "_tie", (F.col("weight") * F.col("_d")).alias("cost"), F.col("_n").alias("held"))
    costs = materialise(running_total(moves, [*group, "vertex"], "_t", ["_tie"], ["cost", "held"]))
    instants = rows.select(*group, "_t").distinct()
    asked = instants.join(vertices.select(*group, "vertex").distinct(), group)
    seen = asof_join(asked, costs.withColumnRenamed("_t", "_seen").withColumn("_at", F.col("_tie").cast("double")), [*group, "vertex"], "_t", "_seen", ["cost", "held", "_legs"], tie="_at")
    whole = F.col("held") == F.col("_legs")
    # sums of steps may differ in the last places: covers of equal cost are told apart at nine
    best = seen.groupBy(*group, "_t").agg(F.min(F.when(whole, F.struct(F.round("cost", 9).alias("cost"), "vertex"))).alias("_m"))
    nxt = tiling.tile(best, group, "_t", behind=0, ahead=1)
    spans = tiling.untile(nxt.withColumn("until", F.lead("_t").over(tiling.tile_window(group))))
    return spans.select(*group, F.col("_t").alias("t"), "until", F.col("_m.vertex").alias("vertex"), F.col("_m.cost").alias("cost"), (1 - F.col("_m.cost")).alias("margin"))


def time_histogram(spans: DataFrame, group: Sequence[str], value: str, width: float, *, cell_s: float = 3600.0) -> DataFrame:
    """group, hour (number of the cell of ``cell_s`` seconds), bin, seconds: the time spent in each bin of the value, spans cut at the
    cells' borders. A NULL value has a bin of its own, NULL; all seconds add up to the length of the spans."""
    ended = spans.where("until > t")
    cells = F.sequence(F.floor(F.col("t") / cell_s), F.ceil(F.col("until") / cell_s) - 1)
    cut = ended.withColumn("hour", F.explode(cells))
    seconds = F.least(F.col("until"), (F.col("hour") + 1) * cell_s) - F.greatest(F.col("t"), F.col("hour") * cell_s)
    place = F.floor(F.round(F.col(value) / width, 6)).alias("bin")
    return cut.groupBy(*group, "hour", place).agg(F.sum(seconds).alias("seconds"))


def episodes(spans: DataFrame, group: Sequence[str], above: Column) -> DataFrame:
    """group, start, end, best: runs of spans for which ``above`` holds; a run that has not ended is left out."""
    flagged = spans.withColumn("_on", F.coalesce(above, F.lit(False)))
    runs = islands(flagged, group, "t", split_on=["_on"]).where("_on")
    out = runs.groupBy(*group, "run").agg(F.min("t").alias("start"), F.max("until").alias("end"), F.max("margin").alias("best"), F.count_if(F.col("until").isNull()).alias("_open"))
    return out.where("_open = 0").drop("run", "_open")


def survival(found: DataFrame, group: Sequence[str], latencies: Sequence[float]) -> DataFrame:
    """group, latency, n, share: how many episodes are still there after a latency."""
    rows = found.withColumn("latency", F.explode(F.array(*[F.lit(float(x)) for x in latencies])))
    return rows.groupBy(*group, "latency").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("end") - F.col("start") >= F.col("latency")).cast("double")).alias("share"))
