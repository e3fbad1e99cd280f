"""Order along closed chains of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def ranked_chains(followers: DataFrame, m: list[str]) -> DataFrame:
    """[model_id,] id, ring, seq: closed chains of `id, next`, each named by its least id, which has seq 0.

    By pointer doubling each link finds the least id on its chain and how far ahead that is, in a number of
    joins that grows with the logarithm of the longest chain: nobody walks it.
    """
    step, hops = cut(followers.select(*m, "id", "next", F.col("id").alias("low"), F.lit(0).cast("long").alias("ahead"))), 1
    while True:
        other = step.select(*m, F.col("id").alias("next"), F.col("next").alias("after"), F.col("low").alias("far"), F.col("ahead").alias("further"))
        moved = F.col("far") < F.col("low")
        new = cut(step.join(other, [*m, "next"]).select(*m, "id", F.col("after").alias("next"), F.least("low", "far").alias("low"), F.when(moved, F.col("further") + hops).otherwise(F.col("ahead")).alias("ahead"), moved.alias("moved")))
        step, hops = new.drop("moved"), hops * 2
        if new.filter("moved").isEmpty():
            break
    ring = step.select(*m, "id", F.col("low").alias("ring"), "ahead")
    size = ring.groupBy(*m, "ring").agg(F.count("*").alias("size"))
    return ring.join(size, [*m, "ring"]).select(*m, "id", "ring", ((F.col("size") - F.col("ahead")) % F.col("size")).alias("seq"))
