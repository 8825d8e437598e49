"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _large(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest of the node and its neighbours."""
    both = links.union(links.select("v", "u"))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = written(down.groupBy("u").agg(F.min("v").alias("m")))
    return down.join(least, "u").select("v", "m").filter("v <> m").union(least.select("u", "m"))\
        .toDF("u", "v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``u, v``, both bigint): ``root`` is the smallest
    node that can be reached, the node itself included.

    Each step is written to the shared folder. Minima combine before the shuffle and both sides of
    a join are stored tables, so that a node with a third of all links can be split. No links, no
    rows; a link of a node to itself gives that node alone.
    """
    links = links.select(F.col("u").cast("bigint"), F.col("v").cast("bigint"))
    nodes = written(links.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    stars, seen = written(links.filter("u <> v").distinct()), None
    while True:
        stars = written(_small(written(_large(stars).distinct())))
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return nodes.join(stars.toDF("node", "root"), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))
