"""Connected components of a table of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, kept


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) of all nodes in `links` (a, b).

    Each round every node takes the least label among its own, its neighbours' and its
    label's label, until a round changes none. Rounds end in a written table, so a lost
    executor costs no more than the round at hand; the table of the round before is deleted.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    edges = kept(both)
    written = labels = kept(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        step = (
            labels.join(near, F.col("node") == F.col("a"))
            .join(jump, F.col("component") == F.col("label"), "left")
            .select("node", F.least("component", "near", "further").alias("new"), F.col("component").alias("old"))
        )
        before, step = written, kept(step)
        dropped(before)
        written = step
        labels = step.select("node", F.col("new").alias("component"))
        if step.filter("new <> old").isEmpty():
            return labels
