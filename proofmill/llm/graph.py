"""Connected components over link tables, by randomised contraction: no link or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): nodes joined by links, directly or not, have one label; it is one of the nodes.

    Each round every node points at the neighbour (or itself) with the smallest salted hash and links are contracted
    along these pointers. A constant share of nodes vanishes per round, so rounds grow with the logarithm of the
    largest component. Every round is a table in the shared folder. Null ends are dropped, self links keep the node.
    """
    edges = stored(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct(), "links")
    nodes = edges.select("a").union(edges.select("b")).distinct().withColumnRenamed("a", "node")
    edges, maps = edges.where("a <> b"), []
    while not edges.isEmpty():
        seed = len(maps)
        both = edges.select("a", "b").union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("n"))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        to = stored(near.select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["n"].alias("to")), "pointers")
        maps.append(to)
        edges = (
            edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        edges = stored(edges, "links")
    label = nodes.select("node", F.col("node").alias("label"))
    for to in maps:
        label = (
            label.join(to.select(F.col("node").alias("label"), "to"), "label", "left")
            .select("node", F.coalesce("to", "label").alias("label"))
        )
    return stored(label, "labels")
