"""Connected components of links, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and component (the smallest node reachable) for every node of a link.

    Nodes are long numbers, links have no direction; repeated links, loops and NULL
    ends are harmless.  Every round each node takes the smallest grandparent among
    its neighbours, offers it to its parent as well, and skips to its own
    grandparent, so chains shrink by a factor per round.  Rounds end when no parent
    changes.  Minima are pre-aggregated, so a hot parent gets one row per task;
    each round is a table in the shared folder, so lost executors cost one round.
    """
    ends = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = written(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    parents = written(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("parent")), "parents")
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        known = written(parents.select("node", "parent").join(above, "parent"), "grandparents")
        near = edges.join(known.select(F.col("node").alias("v"), "grand"), "v").groupBy(F.col("u").alias("node")).agg(
            F.min("grand").alias("least"))
        met = known.join(near, "node")
        nothing = F.lit(None).cast("long")
        offers = (met.select("node", F.least("grand", "least").alias("offer"), F.col("parent").alias("old"))
                  .unionByName(met.select(F.col("parent").alias("node"), F.col("least").alias("offer"), nothing.alias("old"))))
        parents = written(offers.groupBy("node").agg(F.min("offer").alias("offer"), F.max("old").alias("old"))
                          .select("node", F.least("offer", "old").alias("parent"), "old"), "parents")
        if parents.where("parent < old").isEmpty():
            return parents.select("node", F.col("parent").alias("component"))
