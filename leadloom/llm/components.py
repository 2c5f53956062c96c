"""Connected components of a table of links, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node that it can reach, for every node with a link.

    ``links`` has two columns of long ids.  Each round points every node to its
    smallest neighbour, follows the pointers to their roots by doubling and
    contracts the links to links between roots; the number of nodes at least
    halves, so there are about log2 rounds.  Only minima and single rows cross
    shuffles, and every round is a table in the shared folder.  Null ids, links
    of a node to itself and repeated links count for nothing; without links the
    result is empty.
    """
    return spanning(links)[0]


def spanning(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components, and those links (``a``, ``b``, a > b) that make a spanning forest of the graph.

    Pointers lead from larger to smaller nodes only, so the links behind them
    close no circle; each is carried along when links are contracted.
    """
    spark = links.sparkSession
    a, b = links.columns
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = _links(pairs.select("a", "b", F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")))
    hops: list[DataFrame] = []
    forest: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "x", "y"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("b", "x", "y")).alias("s"))
        pointed = materialize(least.select("node", F.least("node", "s.b").alias("p"), "s.x", "s.y"), "parents")
        forest.append(pointed.where("node <> p").select(F.col("x").alias("a"), F.col("y").alias("b")))
        parent = pointed.select("node", "p")
        while True:
            up = parent.where("node <> p").select(F.col("node").alias("p"), F.col("p").alias("q"))  # of nodes that are no roots
            jumped = materialize(parent.join(up, "p", "left").select("node", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "parents")
            parent = jumped.select("node", "p")
            if jumped.where("moved").isEmpty():
                break
        hops.append(parent)
        at = edges.join(parent.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a").join(parent.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
        edges = _links(at.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "x", "y"))
    if not hops:
        return spark.createDataFrame([], "node long, component long"), spark.createDataFrame([], "a long, b long")
    out = hops[0].select("node", F.col("p").alias("component"))
    for hop in hops[1:]:
        step = hop.select(F.col("node").alias("component"), F.col("p").alias("root"))
        out = out.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    tree = forest[0]
    for more in forest[1:]:
        tree = tree.unionByName(more)
    return materialize(out, "components"), tree


def _links(pairs: DataFrame) -> DataFrame:
    """Links once each, with the smallest of the links (``x``, ``y``) that they stand for."""
    ordered = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "x", "y")
    once = ordered.groupBy("a", "b").agg(F.min(F.struct("x", "y")).alias("s"))
    return materialize(once.select("a", "b", "s.x", "s.y"), "links")
