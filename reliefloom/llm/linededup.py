"""Operator 4: line dedup over levelled sorted runs of line hashes.

A run is a table, bucketed and sorted by line hash: the hash of a line's key, in how many documents it
was seen, and the largest doc_id among them. Documents come in batches, largest doc_ids first. A batch
is shuffled once, into its own hashes; these are merge-anti-joined with the hashes that a run has
settled (seen in enough documents already, so that neither count nor doc_id can change what follows),
and what is left becomes a new run of level 0. Whenever a level holds FANOUT runs, they are merged into
one of the next level, bucket by bucket: bucketed runs join without a shuffle. Runs outlive the call
and the session: `state` names them and their folder, `LineRuns.of` opens them again for later batches.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
`least_chars` code points in at least `least_docs` documents lose their lines everywhere but in the
largest doc_id that holds them.

Rows: a null or empty text is one empty line. Documents without doc_id are not counted and keep all
lines. Rows of equal doc_id are one document, counted once and judged each for its own lines; repeated
rows are all kept. Lines repeated inside a document count once, and stay or go together. A very long
text is an array of its lines in one row. Ties cannot arise: the largest doc_id is one document. Other
columns are kept by `without_repeats` and ignored by `line_digests`, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, parallelism, placed_columns, shared_dir, written

LEAST_CHARS = 20
LEAST_DOCS = 3
BATCHES = 4
FANOUT = 2
SALTS = 16  # tasks, at least, that share one very common line


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def key_hash(key: Column) -> Column:
    """128 bits: two seeds of a 64-bit hash."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """Levelled runs of line hashes: h1, h2, n, top."""

    KEY = ("h1", "h2")

    def __init__(self, spark: SparkSession, least_docs: int, fanout: int = FANOUT):
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.buckets, self.folder = parallelism(spark), shared_dir(spark)
        self.levels: list[list[str]] = []

    @classmethod
    def of(cls, spark: SparkSession, state: dict) -> LineRuns:
        """The runs that `state` names, in any session: a catalog that lacks their tables gets them, buckets and order too, from their folder."""
        runs = cls(spark, state["least_docs"], state["fanout"])
        runs.buckets, runs.folder, runs.levels = state["buckets"], state["folder"], [list(level) for level in state["levels"]]
        key = ", ".join(cls.KEY)
        for name in (name for level in runs.levels for name in level):
            if not spark.catalog.tableExists(name):
                place = runs._path(name).replace("\\", "\\\\").replace("'", "\\'")
                spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, n BIGINT, top BIGINT) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {runs.buckets} BUCKETS LOCATION '{place}'")
        return runs

    def state(self) -> dict:
        return {"least_docs": self.least_docs, "fanout": self.fanout, "buckets": self.buckets, "folder": self.folder, "levels": [list(level) for level in self.levels]}

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _all(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            other = r.select(*self.KEY, F.col("n").alias("m"), F.col("top").alias("t"))
            out = out.join(other, list(self.KEY), "full_outer").select(*self.KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("top", "t").alias("top"))
        return out

    def add(self, seen: DataFrame) -> None:
        """`seen`: h1, h2, doc_id, once for each document and hash; no doc_id larger than in earlier batches."""
        own = seen.repartition(self.buckets, *self.KEY) if self.buckets != parallelism(self.spark) else seen
        own = own.groupBy(*self.KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        for run in self._all():
            own = own.join(run.filter(F.col("n") >= self.least_docs).select(*self.KEY), list(self.KEY), "left_anti")
        self._put(0, own)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        name = f"line_run{level}_{uuid.uuid4().hex}"
        run.write.format("parquet").bucketBy(self.buckets, *self.KEY).sortBy(*self.KEY).option("path", self._path(name)).saveAsTable(name)
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged([self.spark.table(n) for n in full]))

    def repeated(self) -> DataFrame:
        """h1, h2, top of the hashes seen in enough documents."""
        return self._merged(self._all()).filter(F.col("n") >= self.least_docs).select(*self.KEY, "top")


def dropped_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id and the hashes of the lines that each document loses."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.char_length(k) >= least_chars))
    seen = docs.filter("doc_id IS NOT NULL").select("doc_id", F.explode(keys).alias("key")).select("doc_id", key_hash(F.col("key")).alias("h"))
    seen = written(seen.select("doc_id", "h.h1", "h.h2"), "line-hashes")
    twice = written(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    if not twice.isEmpty():  # only documents of several rows can hold a hash twice
        seen = seen.join(twice, "doc_id", "left_anti").unionByName(seen.join(twice, "doc_id", "left_semi").distinct())
    bounds = sorted({*seen.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)})
    runs = LineRuns(docs.sparkSession, least_docs)
    edges = [None, *bounds, None]
    for low, high in reversed(list(zip(edges, edges[1:]))):
        batch = seen
        if low is not None:
            batch = batch.filter(F.col("doc_id") > int(low))
        if high is not None:
            batch = batch.filter(F.col("doc_id") <= int(high))
        runs.add(batch)
    # a common line's rows are dealt over SALTS tasks, its hash is sent to each
    salted = runs.repeated().withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    lost = seen.withColumn("salt", F.pmod("doc_id", F.lit(SALTS))).join(salted, ["h1", "h2", "salt"]).filter("doc_id != top")
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))


def _kept_lines(text: Column, lost: Column, least_chars: int) -> Column:
    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.char_length(key) < least_chars) | ~F.array_contains(lost, key_hash(key))

    return F.when(lost.isNull(), lines_of(text)).otherwise(F.filter(lines_of(text), stays))


def without_repeats(docs: DataFrame, **limits: int) -> DataFrame:
    """docs with the repeated lines taken out of `text`; all columns are kept."""
    mine = dropped_hashes(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), **limits).toDF("lost_id", "lost")
    rows, at = placed_columns(docs)
    text = F.col(at["text"])
    kept = _kept_lines(text, F.col("lost"), limits.get("least_chars", LEAST_CHARS))
    joined = rows.join(mine, F.col(at["doc_id"]) == F.col("lost_id"), "left")
    text = F.when(F.col("lost").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(*(text.alias(c) if c == at["text"] else F.col(c) for c in rows.columns)).toDF(*docs.columns)


def line_digests(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    mine = dropped_hashes(docs, **limits).withColumnRenamed("doc_id", "_id")
    joined = docs.join(mine, F.col("doc_id") == F.col("_id"), "left")
    kept = joined.select("doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), _kept_lines(F.col("text"), F.col("lost"), limits.get("least_chars", LEAST_CHARS)).alias("kept"))
    return kept.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))
