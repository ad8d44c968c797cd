"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import saved


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """links (a long, b long) -> (node, root): every linked node but the roots, and the smallest node it can reach.

    Alternating large and small stars: each round points nodes at the smallest of their neighbours, until nothing
    changes. Minima are aggregated before the shuffle and joined back from a written table, so a node with very many
    links is split by adaptive execution. Rounds grow with the logarithm of the longest path.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    raise RuntimeError(f"no end after {max_rounds} rounds")
