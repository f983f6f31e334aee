"""Connected components by hooking, pointer doubling and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.tables import materialize


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root).

    root is the least node of the component. Every node hooks to its least neighbour,
    the pointers are doubled until each names a root, and the edges are contracted to
    roots; this repeats on the contracted graph, so the rounds grow with the logarithm
    of the longest chain. Only nodes that have an edge to another node are returned;
    null ends and loops are ignored. Every round is written to the shared folder.
    """
    e = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    found = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "up")
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            step = materialize(up.join(over, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jump")
            up = step.select("node", "root")
            if step.where("moved").isEmpty():
                break
        if found is None:
            found = up
        else:
            last = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = found.join(last, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        to_a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = materialize(
            e.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    if found is None:
        kind = dict(edges.dtypes)["a"]
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return found
