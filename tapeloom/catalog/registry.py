"""All registered queries: a Spark callable and, where SQL can express it, the oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    spark: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


MODULES = ("indicators", "tape", "joins", "stats", "trading", "streams", "panels", "latency", "studies")


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in MODULES:
        found = importlib.import_module(f"tapeloom.catalog.{m}").QUERIES
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(found)
    return out
