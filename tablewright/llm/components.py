"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import join_hot
from tablewright.session import cut_lineage


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``): the smallest node of its
    component. Large-star and small-star turns (Kiveris et al., 2014), each written to the shared
    folder, until every node has one parent that has none itself; links of a node to itself and
    repeated links do no harm."""
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # a star forest: no node with two parents, none that is a child and a parent
        roles = edges.select(F.explode(F.array(
            F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
            F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
        )).alias("r"))
        tangled = roles.groupBy("r.node").agg(F.sum("r.up").alias("up"), F.max("r.down").alias("down"))
        if tangled.filter("up > 1 or up = 1 and down = 1").isEmpty():
            break
        # large star: all larger neighbours of a node point to the smallest of its neighbourhood
        near = _both(edges)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = join_hot(near.filter("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours point to the smallest of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = join_hot(edges, least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = cut_lineage(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
