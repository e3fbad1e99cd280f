"""Operator 10: sharding by vector bin packing.

Documents of equal text form a group. A group is a vector of bytes, words and rows; groups are
placed, largest first, into the shard where the dot product of the group with the shard's residual
capacity is highest. The `bytes` law holds: shard sizes are nearly equal (words and rows too).

The placement itself is sequential, so the number of things placed is bounded whatever the input. A
group of more than 1/FINE of a shard in any measure is placed as it is; there are at most
3 * shards * FINE of them. One above 1/GRAIN of a shard is cut into pieces of about that share by a
hash of doc_id and of the row's own number in the written table, so that rows without doc_id, or of one
doc_id, are cut too. Only the tail, groups that small that no shard's balance depends on one of them, is
gathered by hash into BINS bins, which are placed like groups, after the larger ones. The driver sees
one row for each group placed, piece or bin.

Rows: a null text has size 1, no words and checksum 0, like an empty one, and forms a group of its
own with it. Rows without doc_id, and repeated rows, are placed like others; rows of equal doc_id and
text take neighbouring slots unless their group is cut. A very long text is a group like any other. Of shards with equal dot
products the first is taken. An empty table gives no rows. Columns other than doc_id and text are
ignored by the plan, whatever their names, and kept by a join on doc_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 16
BINS = 4096
FINE = 512
GRAIN = 64
#: Fixed value: what words are made of.
WORD = r"[^\x20\x09-\x0D]+"


def packed(loads: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of `loads` (one column for each measure)."""
    totals = loads.sum(axis=0)
    share = loads / np.where(totals > 0, totals, 1)
    left = np.full((shards, loads.shape[1]), 1 / shards)
    out = np.zeros(len(loads), np.int64)
    for i in sorted(range(len(loads)), key=lambda i: -share[i].max()):
        out[i] = at = int(np.argmax(left @ share[i]))
        left[at] -= share[i]
    return out


def placed(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    light = written(documents.select(F.col("doc_id").cast("long"), size.alias("size"), words.alias("words"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2")).withColumn("row", F.monotonically_increasing_id()), "sizes")
    measures = [F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("rows")]
    groups = light.groupBy("g1", "g2").agg(*measures)
    total = light.agg(*measures).first()
    share = F.greatest(*(F.col(c) * shards / F.lit(max(1.0, float(t or 0))) for c, t in zip(("size", "words", "rows"), total)))  # of a shard
    large = groups.withColumn("share", share).filter(F.col("share") > 1 / FINE)
    pieces = F.when(F.col("rows") > 1, F.greatest(F.ceil(F.col("share") * GRAIN), F.lit(1))).otherwise(1)
    large = large.select("g1", "g2", pieces.alias("pieces")).orderBy("g1", "g2").collect()  # at most 3 * shards * FINE
    cuts, at = [], BINS
    for g in large:
        cuts.append((g.g1, g.g2, at, int(g.pieces)))
        at += int(g.pieces)
    table = spark.createDataFrame(cuts, "c1 long, c2 long, first long, pieces long")
    dealt = light.join(F.broadcast(table), (F.col("g1") == F.col("c1")) & (F.col("g2") == F.col("c2")), "left")
    item = F.when(F.col("first").isNotNull(), F.col("first") + F.pmod(F.xxhash64("doc_id", "row"), F.col("pieces"))).otherwise(F.pmod("g1", F.lit(BINS)))
    dealt = dealt.withColumn("item", item).drop("c1", "c2", "first", "pieces")
    loads = dealt.groupBy("item").agg(*measures).orderBy("item").collect()  # one row for each bin or piece
    vectors = np.array([[x["size"], x["words"], x["rows"]] for x in loads], float).reshape(-1, 3)
    where = packed(vectors, shards)
    begun, places = [0] * shards, []
    for x, s in zip(loads, where.tolist()):
        places.append((x["item"], s, begun[s]))
        begun[s] += x["rows"]
    places = spark.createDataFrame(places, "item long, shard int, base long")
    order = Window.partitionBy("item").orderBy("doc_id", "g1", "g2", "row")
    numbered = dealt.withColumn("at", F.row_number().over(order) - 1)
    out = numbered.join(F.broadcast(places), "item")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
