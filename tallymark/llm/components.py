"""Connected components of any number of links, by alternating stars.

Two steps take turns on the table of links: every node hands its larger
neighbours to its least neighbour (large star), then its smaller ones and itself
(small star).  Both keep components as they are, and after a number of turns that
grows with the logarithm of the longest chain every node hangs on the least node
of its component.  No step gathers a node's neighbours: each is a pre-aggregated
minimum and a join, both over shares of a node's links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import written

MAX_TURNS = 64  # chains of 2**64 nodes
SHARES = 256  # that the links of one node are dealt into


def _least(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``links`` with the least ``b`` of their ``a`` as ``low``, and ``a, low`` of every node.

    A node with very many links is dealt out by a hash of their other ends: each
    share has its own minimum, the minimum of those goes back to the shares, and
    links meet their share only.
    """
    dealt = links.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(SHARES)))
    shares = dealt.groupBy("a", "share").agg(F.min("b").alias("low"))
    least = shares.groupBy("a").agg(F.min("low").alias("low"))
    told = shares.select("a", "share").join(least, "a")
    return dealt.join(told, ["a", "share"]).drop("share"), least


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met, _ = _least(both)
    return met.where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` point from the larger node ``a`` to the smaller ``b``."""
    met, least = _least(links)
    smaller = met.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return smaller.unionByName(least.select("a", F.col("low").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its least node) of every node that a link ``a, b`` names.

    Links of a node with itself name no other node and are left out; repeated
    links count once; an empty table has no components.
    """
    now = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = None
    for _ in range(MAX_TURNS):
        now = written(_small_star(written(_large_star(now), "links")).distinct(), "links")
        # rows and a sum of their hashes change as long as any link does
        last, mark = mark, now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
