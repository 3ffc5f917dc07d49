"""Connected components of an edge table, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlight.llm.common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node of an undirected edge table.

    Returns ``node, root`` for every node that some edge names. Null ends and loops are
    ignored; repeated edges do no harm; an empty table gives an empty result.

    Each round hooks every node onto the smallest label among its neighbours and then jumps to
    the label of that label, so a chain of length n takes about log n rounds. A round is two
    aggregations and two equi-joins over tables as large as the edges; it ends in a written
    table, which keeps lineage short. A node with very many edges is pre-aggregated by the
    partial ``min`` and split by Spark's skew join.
    """
    link = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.col(a).alias("u"), F.col(b).alias("v"))
    link = materialize(link.union(link.select(F.col("v"), F.col("u"))).distinct())
    label = materialize(link.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("root")))
    while True:
        near = (
            link.join(label, link.v == label.node)
            .groupBy("u")
            .agg(F.min("root").alias("near"))
        )
        hooked = label.join(near, label.node == near.u).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = label.select(F.col("node").alias("at"), F.col("root").alias("above"))
        jumped = materialize(
            hooked.join(up, hooked.root == up["at"]).select("node", "old", F.least("root", "above").alias("root"))
        )
        label = jumped.select("node", "root")
        if jumped.where("old <> root").isEmpty():
            return label
