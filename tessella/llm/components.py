"""Connected components of a graph given by its edges, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs -> (node, root): the smallest node of each one's component, for all nodes that an edge names.

    Each round hangs every node under the smallest of its neighbours and itself and contracts the graph to those; minima are
    combined before each shuffle, so a node of very many edges is no more work for one task. Rounds end when no edge is left, about the
    logarithm of the longest path."""
    edges = edges.where("u <> v")
    live = settle(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots = None
    while not live.isEmpty():
        up = settle(live.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("low")).select("at", F.least("at", "low").alias("up")))
        if roots is None:
            roots = up.select(F.col("at").alias("node"), F.col("up").alias("root"))
        else:
            joined = roots.join(up, roots.root == up.at, "left")
            roots = settle(joined.select("node", F.coalesce("up", "root").alias("root")))
        half = live.join(up, live.u == up.at).select(F.col("up").alias("u"), "v")
        both = settle(half).join(up, F.col("v") == F.col("at")).select("u", F.col("up").alias("v"))
        live = settle(both.where("u <> v").distinct())
    return roots if roots is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
