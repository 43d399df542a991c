"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label of that label, so the number of rounds grows
    with the logarithm of the longest chain.  Every round's labels are written to the shared folder.
    """
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    edges = materialize(both, "links")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        own = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        above = labels.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        fresh = materialize(own.join(above, "comp").select("node", F.least("comp", "top").alias("comp"), "old"), "labels")
        if not fresh.filter("comp <> old").head(1):
            return fresh.select("node", "comp")
        labels = fresh.select("node", "comp")
