"""Exact quantiles, quintiles and empirical distributions of groups of any size.

Rows are reduced to distinct values; approximate edges cut a group into cells, the counts of the cells say which cell
holds a rank, and only the cells that hold a wanted rank are sorted. A task holds one cell. For a handful of large groups
two passes over the rows do, without a table of their distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.operators.ranks import cumulative_by_value, materialise, value_cells

#: Approximate quantiles this far below and above a wanted place bracket it: their own error is at most 1 / ACCURACY.
BRACKET, ACCURACY = 1 / 2048, 10_000


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], out: str = "q") -> DataFrame:
    """group, n, and an array of the quantiles, between neighbours by straight lines; rows whose value is NULL or NaN stay out."""
    whole = not group
    group = ["_all"] if whole else list(group)
    rows = df.withColumn("_all", F.lit(1)) if whole else df
    rows = rows.select(*group, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    flat = materialise(rows.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c")))
    celled = value_cells(flat, group, "_v")
    every = Window.partitionBy(*group)
    before = every.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = celled.groupBy(*group, "_cell").agg(F.sum("_c").alias("_in"))
    cells = cells.select(*group, "_cell", "_in", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_from"), F.sum("_in").over(every).alias("n"))
    holding = cells.withColumn("_places", F.filter(_places(probs), lambda k: (k >= F.col("_from")) & (k < F.col("_from") + F.col("_in")))).where(F.size("_places") > 0)
    inside = Window.partitionBy(*group, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    sorted_cells = celled.join(holding, [*group, "_cell"]).withColumn("_at", F.col("_from") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    hit = F.filter("_places", lambda k: (k >= F.col("_at")) & (k < F.col("_at") + F.col("_c")))
    made = _quantiles(sorted_cells.select(*group, "n", "_v", F.explode(hit).alias("_place")), group, probs, out)
    return made.drop("_all") if whole else made


def few_groups_quantiles(df: DataFrame, group: Sequence[str], values: Sequence[str], probs: Sequence[float], out: str = "q") -> DataFrame:
    """``exact_quantiles`` of several columns, named in ``_name``, for a handful of groups: two passes over the rows, which are not stored.

    Values outside the brackets around the wanted places are counted only, those inside value by value; a task sorts a
    bracket's distinct values.
    """
    key = [*group, "_name"]
    rows = df.select(*group, F.inline(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_v")) for c in values])))
    rows = rows.where("_v IS NOT NULL AND NOT isnan(_v)")
    around = lambda shift: F.percentile_approx("_v", [min(max(p + shift, 0.0), 1.0) for p in probs], ACCURACY)
    edges = materialise(rows.groupBy(*key).agg(around(-BRACKET).alias("_low"), around(BRACKET).alias("_high")))
    # both counts never fall as the value rises, and differ inside a bracket only
    begun, over = F.size(F.filter("_low", lambda e: e <= F.col("_v"))), F.size(F.filter("_high", lambda e: e < F.col("_v")))
    celled = rows.join(F.broadcast(edges), key).select(*key, (begun + over).alias("_cell"), F.when(begun > over, F.col("_v")).alias("_v"))
    counted = materialise(celled.groupBy(*key, "_cell", "_v").agg(F.count(F.lit(1)).alias("_c")))
    every = Window.partitionBy(*key)
    before = F.coalesce(F.sum("_c").over(every.orderBy("_cell", "_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumns({"_at": before, "n": F.sum("_c").over(every)})
    hit = F.filter(_places(probs), lambda k: (k >= F.col("_at")) & (k < F.col("_at") + F.col("_c")))
    found = materialise(placed.select(*key, "n", "_v", F.explode(hit).alias("_place")))
    if not found.where("_v IS NULL").isEmpty():  # a bracket missed its place: the way for groups of every kind
        each = [exact_quantiles(df, group, c, probs, out).withColumn("_name", F.lit(c)) for c in values]
        return reduce(DataFrame.unionByName, each)
    return _quantiles(found, key, probs, out)


def _places(probs: Sequence[float]) -> Column:
    """Both neighbours of each wanted place among ``n`` rows, counted from 0."""
    return F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * p).cast("long"), F.ceil((F.col("n") - 1) * p).cast("long")) for p in probs])))


def _quantiles(found: DataFrame, group: Sequence[str], probs: Sequence[float], out: str) -> DataFrame:
    """The quantiles from the values found at the wanted places."""
    told = found.groupBy(*group, "n").agg(F.map_from_entries(F.collect_list(F.struct("_place", "_v"))).alias("_m"))
    low, high = (lambda p: F.floor((F.col("n") - 1) * p).cast("long")), (lambda p: F.ceil((F.col("n") - 1) * p).cast("long"))
    between = lambda p: F.col("_m")[low(p)] + ((F.col("n") - 1) * p - low(p)) * (F.col("_m")[high(p)] - F.col("_m")[low(p)])
    return told.select(*group, "n", F.array(*[between(float(p)) for p in probs]).alias(out))


def regime(df: DataFrame, group: Sequence[str], value: str, train: Column, n: int = 5, out: str = "quintile") -> DataFrame:
    """Rows with their class 1 .. n by edges that the training rows alone set; NULL without a value or with fewer than n training rows."""
    group = list(group)
    edges = exact_quantiles(df.where(train), group, value, [k / n for k in range(1, n)], "_edges").where(F.col("n") >= n).select(*group, "_edges")
    # an edge itself belongs to the class above it
    number = F.size(F.filter("_edges", lambda e: e <= F.col(value))) + 1
    return df.join(edges, group, "left").withColumn(out, F.when(F.col(value).isNotNull() & F.col("_edges").isNotNull(), number)).drop("_edges")


def train_distribution(df: DataFrame, group: Sequence[str], value: str, train: Column, out: str = "ecdf") -> DataFrame:
    """Rows with the share of the training rows that are at most their value."""
    group = list(group)
    sums = cumulative_by_value(df.where(F.col(value).isNotNull()), group, value, {"_t": F.when(train, 1).otherwise(0)})
    upto = sums.select(*group, value, F.try_divide(F.col("_t_before") + F.col("_t"), F.col("_t_all")).alias(out))
    return df.join(upto, [*group, value], "left")


def extremes_gap(rows: DataFrame, group: Sequence[str], quintile: str, measure: str, n: int = 5) -> DataFrame:
    """Mean of the measure in the last class less that in the first, with its standard error."""
    of = lambda k, f: f(F.when(F.col(quintile) == k, F.col(measure)))
    g = rows.groupBy(*group).agg(*[f(k).alias(f"_{a}{k}") for k in (1, n) for a, f in (("m", lambda k: of(k, F.avg)), ("v", lambda k: of(k, F.var_samp)), ("n", lambda k: of(k, F.count)))])
    gap = F.col(f"_m{n}") - F.col("_m1")
    return g.select(*group, gap.alias("gap"), F.sqrt(F.try_divide(F.col(f"_v{n}"), F.col(f"_n{n}")) + F.try_divide(F.col("_v1"), F.col("_n1"))).alias("se"))
