"""Connected components of a link table, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.frames import tabled


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (whole-number columns ``a``, ``b``).

    The label is the smallest node that can be reached. Alternating large-star and small-star
    steps hang every node's larger (then smaller) neighbours on its smallest neighbour until
    nothing changes; the number of rounds grows with the logarithm of the component size. Each
    step is a map-side combined minimum and a join, so a node with very many links is no
    single task's burden. No links give no rows.
    """
    links = tabled(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .where("a > b").distinct())
    before, now = None, _digest(links)
    while before != now:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a > b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = tabled(hung.union(least.select("a", F.col("m").alias("b"))).distinct())
        before, now = now, _digest(links)
    return (links.select(F.col("a").alias("node"), F.col("b").alias("label"))
            .union(links.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct())


def _digest(links: DataFrame) -> tuple:
    """Count and hash sum of a set of links: equal for equal sets."""
    each = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(each)).first())
