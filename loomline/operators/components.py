"""Connected components of an undirected graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import cut_lineage


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in the links ``(a, b)``; the root is the least node of its component.

    Each node's least neighbour is passed on and labels jump over labels, so rounds grow with the logarithm of a component's
    diameter. A round is aggregates and joins on the links; its result is written and read again, which cuts its lineage.
    """
    both = links.where("a <> b").select("a", "b").unionAll(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    label = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        # a root learns of smaller roots through any of its members
        told = label.join(seen, label["node"] == seen["a"]).groupBy("root").agg(F.min("near").alias("near"))
        up = label.join(told, "root").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = up.join(label.select(F.col("node").alias("mid"), F.col("root").alias("far")), "mid", "left")
        after = cut_lineage(jump.select("node", F.least("mid", F.coalesce("far", "mid")).alias("root"), F.col("old")))
        changed = after.where("root <> old").limit(1).count()
        label = after.select("node", "root")
        if not changed:
            return label
