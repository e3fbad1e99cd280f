"""Corpus preparation: five stages, each on all that its predecessor kept.

Language identification, line dedup, near-duplicates, benchmark decontamination, BPE encoding. Every
stage but the last returns the columns of `documents`, in their order and with the user's names and values, whatever
the names are (also those that an operator uses itself, or with dots); each result is written as Parquet in
the shared folder and read again.

Rows: documents without doc_id pass the stages that judge by it. Null texts, and texts without letters, go
in the first stage. Very long texts pass all stages whole. Repeated rows (equal doc_id and text) are one document
to line dedup and near-duplicates: all of them stay, or all go; rows of equal doc_id and other texts are judged
by their own text, but for near-duplicates, where they are one group by their doc_id. Ties: the document with the
largest doc_id keeps a repeated line, the one with the smallest stays of near-duplicates. An empty table gives
no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefloom.llm import bpe, decontaminate, langid, linededup, neardup
from reliefloom.llm.common import placed_columns, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without letters, and null texts, go. An ambiguous language is a known one."""
    rows, at = placed_columns(docs)
    model = langid.learned(rows.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), F.col(at["lang"]).alias("lang")))
    judged = langid.identified(rows, model, at["text"])
    return judged.filter(F.col("lang_pred") != langid.UND).select(*rows.columns).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that recur in later ones; n_chars follows the text."""
    out = linededup.without_repeats(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id."""
    gone = neardup.near_duplicates(docs.select("doc_id", "text")).filter("NOT kept").select("doc_id").toDF("gone")
    rows, at = placed_columns(docs)
    return rows.join(gone, F.col(at["doc_id"]) == F.col("gone"), "left_anti").toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than the tolerated share of benchmark passages."""
    found = decontaminate.judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated")
    bad = found.select("doc_id", "text_hash").toDF("bad_id", "bad_hash")
    rows, at = placed_columns(docs)
    same = F.col(at["doc_id"]).eqNullSafe(F.col("bad_id")) & (F.xxhash64(at["text"]) == F.col("bad_hash"))
    return rows.join(bad, same, "left_anti").toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the digest of what the ids decode to."""
    coded = bpe.coded(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language identification", identify_language),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("BPE encoding", encode),
]

#: Language identification and BPE are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
