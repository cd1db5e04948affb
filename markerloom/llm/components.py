"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.session import checkpointed


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in `links` (a, b); the root is the smallest node of the component.

    One round of Kiveris et al. (2014): every node hands its larger neighbours to its smallest one, then its smaller
    neighbours. All steps are joins and minima, so a node with very many links needs no task of its own, and the rounds grow with
    the logarithm of the longest chain. The links are cut from their lineage after every step.
    """
    links = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _signature(links)) != before:
        before = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        wide = checkpointed(wide.where("a <> b"))
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        handed = wide.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = checkpointed(handed.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
