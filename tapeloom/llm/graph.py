"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import stored


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, label): the smallest node that each node of a link reaches.

    ``links`` has two columns a and b. In a round each node takes the smallest label among its neighbours and its own,
    then the label of its label; labels are stored after every round, and the rounds end when none changes. Only the
    number of changes comes to the driver.
    """
    pairs = links.select("a", "b")
    edges = stored(pairs.union(pairs.select("b", "a")).distinct(), folder, f"{name}-edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), folder, f"{name}-0")
    turn = 0
    while True:
        turn += 1
        heard = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        taken = labels.join(heard, labels["node"] == heard["a"]).select("node", "label", F.least("label", "heard").alias("taken"))
        far = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        moved = taken.join(far, taken["taken"] == far["at"]).select("node", F.least("taken", "far").alias("label"), F.col("label").alias("former"))
        new = stored(moved, folder, f"{name}-{turn}")
        if new.where("label <> former").limit(1).count() == 0:
            return new.select("node", "label")
        labels = new.select("node", "label")
