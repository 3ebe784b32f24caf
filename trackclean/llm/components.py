"""Connected components of a table of links, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, own_tables

#: Links that one task handles: rounds on few links run in few tasks, whatever the number of shuffle partitions.
TASK_LINKS = 1_000_000


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node reachable, for every node that is in a link. It is stored.

    Alternates large stars and small stars (every node links its larger neighbours, then its smaller ones, to the
    smallest it knows), which ends after a logarithmic number of rounds for any graph; nothing is gathered but a count.
    """
    with own_tables(links.sparkSession):
        edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        tasks = edges.count() // TASK_LINKS + 1
        before = None
        for _ in range(rounds):
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            # stored, so that the join's larger side may be split where one node has a great share of the links
            least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            edges = cut(small.filter("u <> v").distinct().coalesce(tasks))
            # a star forest: no node is both a centre and a leaf
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before, tasks = now, now[0] // TASK_LINKS + 1
        else:
            raise RuntimeError(f"the components are not settled after {rounds} rounds")
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")))
        return cut(ends.groupBy("node").agg(F.min("component").alias("component")).coalesce(tasks), outer=True)
