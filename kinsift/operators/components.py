"""Connected components of an edge table by minimum labels and pointer jumping; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.plans.lineage import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Null ends are left out, loops and repeated edges do no harm, an empty table gives an empty table.
    Labels are pre-aggregated before each shuffle, so a node of very many edges is no hot group.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    both = materialize(pairs.union(pairs.select(F.col("v"), F.col("u"))).distinct(), "edges")
    own = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).filter("node is not null").distinct()
    near = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near"))
    labels = materialize(own.join(near, "node", "left").select("node", F.least("node", "near").alias("component")), "labels")
    while True:
        around = both.join(labels, both["v"] == labels["node"]).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(around, "node", "left").select("node", "component", F.least("component", "near").alias("least"))
        # the label's node learns the smallest label that any of its members has met
        roots = hooked.groupBy(F.col("component").alias("root")).agg(F.min("least").alias("least_of_root"))
        step = hooked.join(roots, F.col("component") == F.col("root")).select("node", F.col("component").alias("before"), F.least("least", "least_of_root").alias("component"))
        step = materialize(step, "labels")
        if not step.filter("component <> before").limit(1).count():
            return step.select("node", "component")
        top = step.select(F.col("node").alias("root"), F.col("component").alias("above"))
        labels = materialize(step.join(top, F.col("component") == F.col("root"), "left").select("node", F.least("component", "above").alias("component")), "labels")
