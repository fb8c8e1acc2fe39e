"""Ranks and cumulative sums over a whole group, without sorting a large group in one task.

Rows are first reduced to distinct values and the reduced table is checkpointed, so what comes before it runs once.
Quantile edges cut each group into cells, cell totals give the offset of a cell, and a window inside the cell gives
the rest: one way for groups of every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.session import ensure_checkpoint_dir

CELLS = 256
#: A group gets no more cells than parts of this many rows: every row is held against every edge of its group.
CELL_ROWS = 16384


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through the checkpoint folder that the session names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def value_cells(df: DataFrame, group: Sequence[str], value: str, cells: int = CELLS) -> DataFrame:
    """Add ``_cell``: how many quantile edges of the group lie at or below the value.

    The edges (one short array per group) are checkpointed: every later use sees the same cells.
    """
    group = list(group)
    probs = [(i + 1) / cells for i in range(cells - 1)]
    found = df.groupBy(*group).agg(F.percentile_approx(value, probs, 1000).alias("_edges"), F.ceil(F.lit(cells) / F.ceil(F.count(F.lit(1)) / CELL_ROWS)).alias("_step"))
    edges = materialise(found.select(*group, F.filter("_edges", lambda e, i: (i + 1) % F.col("_step") == 0).alias("_edges")))
    return df.join(edges, group).withColumn("_cell", F.size(F.filter("_edges", lambda e: e <= F.col(value)))).drop("_edges")


def cumulative_by_value(
    df: DataFrame, group: Sequence[str], value: str, sums: Mapping[str, Column], *, cells: int = CELLS,
) -> DataFrame:
    """One row per group and distinct value: each sum, ``{name}_before`` (all smaller values) and ``{name}_all``."""
    group = list(group)
    flat = materialise(df.groupBy(*group, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()]))
    whole = Window.partitionBy(*group)
    celled = value_cells(flat, group, value, cells)
    prefix = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = celled.groupBy(*group, "_cell").agg(*[F.sum(n).alias(f"_s_{n}") for n in sums])
    offsets = per_cell.select(
        *group, "_cell",
        *[F.coalesce(F.sum(f"_s_{n}").over(prefix), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_all") for n in sums])
    inside = Window.partitionBy(*group, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = celled.join(offsets, [*group, "_cell"])
    for n in sums:
        out = out.withColumn(f"{n}_before", F.col(f"_o_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return out.drop("_cell", *[f"_o_{n}" for n in sums])


def average_rank(df: DataFrame, group: Sequence[str], value: str, out: str, **limits) -> DataFrame:
    """Rank from 1 with ties averaged; rows with a NULL value get NULL."""
    group = list(group)
    table = cumulative_by_value(df.filter(F.col(value).isNotNull()), group, value, {"_n": F.lit(1)}, **limits)
    ranks = table.select(*group, value, (F.col("_n_before") + (F.col("_n") + 1) / 2.0).alias(out))
    return df.join(ranks, [*group, value], "left")


def small_group_rank(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank by plain windows, for groups of one key's day."""
    w = Window.partitionBy(*group).orderBy(value)
    ties = Window.partitionBy(*group, value)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0))


def rank_columns(rows: DataFrame, group: Sequence[str], columns: Mapping[str, str], *, by_day: bool = False) -> DataFrame:
    """Average ranks of several columns (source -> output).  ``rows`` should be a table or a checkpoint.

    ``by_day`` states that ``group`` names one key's day, which holds no more rows than the day has bars.
    """
    for value, out in columns.items():
        rows = small_group_rank(rows, group, value, out) if by_day else average_rank(rows, group, value, out)
    return rows


def auc(df: DataFrame, group: Sequence[str], score: str, label: str, weight: Column | None = None, **limits) -> DataFrame:
    """Area under the ROC curve per group (ties count one half), optionally weighted, with its class totals."""
    whole = not group
    if whole:
        group, df = ["_all"], df.withColumn("_all", F.lit(1))
    group = list(group)
    w = F.lit(1.0) if weight is None else weight
    table = cumulative_by_value(
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()), group, score,
        {"pos": F.when(F.col(label) == 1, w).otherwise(0.0), "neg": F.when(F.col(label) == 0, w).otherwise(0.0)}, **limits)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    out = table.groupBy(*group).agg(
        F.try_divide(wins, F.max("pos_all") * F.max("neg_all")).alias("auc"),
        F.max("pos_all").alias("n_pos"), F.max("neg_all").alias("n_neg"))
    return out.drop("_all") if whole else out


def ordinal_rank(df: DataFrame, group: Sequence[str], value: str, tie: Sequence[str], out: str, *,
                 descending: bool = True, cells: int = CELLS) -> DataFrame:
    """Rank from 1, ties broken by the ``tie`` columns; groups are cut into value cells."""
    group = list(group)
    keyed = materialise(df.withColumn("_v", F.col(value) * (-1 if descending else 1)))
    celled = value_cells(keyed, group, "_v", cells)
    prefix = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = celled.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_k")).select(
        *group, "_cell", F.coalesce(F.sum("_k").over(prefix), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*group, "_cell").orderBy("_v", *tie)
    return (celled.join(offsets, [*group, "_cell"])
            .withColumn(out, F.col("_o") + F.row_number().over(inside)).drop("_v", "_cell", "_o"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group; Spark prunes each input partition to k rows per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
