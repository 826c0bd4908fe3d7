"""Connected components of a link table by spreading the smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (a, b): the smallest node reachable. Each round ends in a written table."""
    both = links.where("a <> b").select("a", "b")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component"))
    labels = written(labels, "labels")
    while True:
        known = labels.select(F.col("node").alias("b"), "component")
        near = both.join(known, "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.select("node", "component").join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        step = step.join(jump, "mid", "left").select("node", "old", F.least("mid", "far").alias("component"))
        step = written(step, "labels")
        discard(labels)
        if step.where("component <> old").isEmpty():
            discard(both)
            return step.select("node", "component")
        labels = step
