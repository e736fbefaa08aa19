"""Connected components of links between 64-bit keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed


SALTS = 8


def _to_least(links: DataFrame) -> DataFrame:
    """links (a, b) with m, the least b of each a. A key's links meet its minimum in SALTS places, so that a hub isn't one task's."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", "m", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    return links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(least, ["a", "salt"]).select("a", "b", "m")


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """links: a, b (long). Gives (key, root) for every key with a link, root being the smallest key of its component. Large-star and small-star
    steps in turn: each key's smaller neighbours are linked to the smallest one, so the links shrink to stars in a logarithmic number of
    rounds; every round is written to the checkpoint folder. A hub's links are joined to the minimum of its group in salted parts, not collected."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpointed(edges)
    before = None
    for _ in range(most):
        # large star: every larger neighbour is linked to the least of its neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # small star: every smaller neighbour, and the key itself, is linked to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _to_least(large).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: links still change after {most} rounds")
    return edges.select(F.col("a").alias("key"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct())
