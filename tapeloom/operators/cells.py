"""Grouping cells, loss-based choices and family summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def grouping_cells(df: DataFrame, sets: Sequence[Sequence[str]], aggs: Sequence[Column], total: str = "all") -> DataFrame:
    """Aggregates for several grouping sets in one pass; a column that is not grouped reads ``all``."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(
        *aggs, *[F.grouping(c).alias(f"_g_{c}") for c in columns])
    for c in columns:
        out = out.withColumn(c, F.when(F.col(f"_g_{c}") == 1, total).otherwise(F.col(c)))
    return out.drop(*[f"_g_{c}" for c in columns])


def choose_by_loss(df: DataFrame, group: Sequence[str], candidate: str, loss: Column) -> DataFrame:
    """Candidate with the smallest mean loss per group (a tie goes to the smallest candidate)."""
    means = df.groupBy(*group, candidate).agg(F.avg(loss).alias("_loss"))
    return means.groupBy(*group).agg(F.min_by(candidate, F.struct("_loss", candidate)).alias(candidate), F.min("_loss").alias("loss"))


def family_summary(scores: DataFrame, families: Mapping[str, str]) -> DataFrame:
    """Count, median and largest |IC| and the best indicator of every family."""
    family = F.lit(None).cast("string")
    for name, fam in families.items():
        family = F.when(F.col("indicator") == name, fam).otherwise(family)
    size = F.abs("ic")
    return scores.withColumn("family", family).groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.percentile(size, F.lit(0.5)).alias("ic_p50"), F.max(size).alias("ic_max"),
        F.max_by("indicator", size).alias("best"))
