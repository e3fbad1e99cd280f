"""Which models a table holds (operators work on all of them at once and keep them apart), and how tables of them are joined and dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # numbers that are counted out at a time


def model(df: DataFrame) -> list[str]:
    """["model_id"] where the table has that column; without it, all rows belong to one model."""
    return ["model_id"] if "model_id" in df.columns else []


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that must not be a broadcast: Spark takes a table for as small as what it was exploded or read from, also after a checkpoint."""
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over twice as many tasks as there are cores, for work that its size doesn't show: Spark would give few bytes to one task."""
    spark = df.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, F.xxhash64(*keys))


def counted(df: DataFrame, n: Column, name: str) -> DataFrame:
    """df once for each number below n, as column `name`: rows are dealt over tasks in blocks of numbers, however few there are."""
    last = F.floor((n - 1) / BLOCK).cast("long")
    blocks = dealt(df.filter(n > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_block")), *df.columns, "_block")
    first = F.col("_block") * BLOCK
    return blocks.select(*df.columns, F.explode(F.sequence(first, F.least(first + BLOCK, n.cast("long")) - 1)).alias(name))
