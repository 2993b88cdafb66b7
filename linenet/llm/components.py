"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linenet.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). vertex, root for every vertex of an edge; the root is the component's smallest vertex.

    Each round takes the least label among neighbours and then the label's label, so rounds grow with the logarithm of
    the longest path. Every round is written to the shared folder; only a count reaches the driver.
    """
    both = edges.where("a <> b").select("a", "b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    labels = materialize(both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("near")).select("vertex", F.least("vertex", "near").alias("root")), "component-labels")
    while True:
        near = both.join(labels.withColumnRenamed("vertex", "b"), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("root").alias("near"))
        once = labels.join(near, "vertex").select("vertex", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("vertex").alias("at"), F.col("root").alias("further"))
        after = once.join(jump, once["root"] == jump["at"], "left").select("vertex", "old", F.least("root", F.coalesce("further", "root")).alias("root"))
        after = materialize(after, "component-labels")
        if after.where("root <> old").isEmpty():
            return after.select("vertex", "root")
        labels = after.select("vertex", "root")
