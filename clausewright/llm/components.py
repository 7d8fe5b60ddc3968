"""Connected components of a link table by alternating large-star and small-star steps.

Every step is an aggregation of minima and a join on the node, so a hub's links are never gathered: the
minimum is combined before the shuffle, and the join deals a hub's links to several tasks. Lineage is cut after
each round in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, salted_join


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return salted_join(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = salted_join(down, least, "u", "v").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of `links` that is not the least of its component; root is the least."""
    e = cut_lineage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct())
    before = _state(e)
    while before[0]:
        e = cut_lineage(_small_star(_large_star(e)))
        now = _state(e)
        if now == before:
            break
        before = now
    return e.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
