"""Operator 6: benchmark decontamination by a prefix-filtered containment join.

Items become windows of consecutive words. A window is contained in a document only if all its words
are, so one word of it is a necessary prefix: the rarest, by counts over all documents. Documents'
words are joined with these prefix words; the word's offset in the window then fixes where the
window would lie (positional bound), the document must be long enough there (length bound), and the
window's words are compared with the document's own at that place (exact check).

The windows are broadcast only if there are at most `MOST_BROADCAST` of them, which is counted; with
more, each word that could be a prefix word carries its neighbourhood through a shuffle.

Words: A-Z are lower-cased; letters and digits of ASCII and everything beyond ASCII belong to words.

Rows: null or empty texts have no words and are never contaminated. Benchmark rows without item_id
or words are left out; rows of one item_id are one item. Documents without doc_id are judged like
others; rows of equal doc_id and different text are judged each for itself, repeated rows alike. A very
long text is one array of words, with a row for each word that a window could begin at. Of equally rare
words the first by name is a window's prefix. Columns other than the ids and texts are ignored, whatever
their names. An empty benchmark leaves all documents clean; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

WINDOW = 13
MOST_BROADCAST = 100_000
#: Fixed value: what separates words, after lower-casing.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATOR), "")


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, w: the distinct windows of each item; an item of fewer words is one window."""
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", words_of(F.col("text")).alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("w")).distinct()


def _prefixed(found: DataFrame, docs: DataFrame, few: bool) -> DataFrame:
    """w, n, token, off: each distinct window with its rarest word and where that word stands first."""
    each = found.select("w").distinct().select("w", F.posexplode("w").alias("off", "token"))
    vocabulary = each.select("token").distinct()
    seen = docs.select(F.explode_outer(words_of(F.col("text"))).alias("token"))
    counts = seen.join(F.broadcast(vocabulary) if few else vocabulary, "token").groupBy("token").agg(F.count("*").alias("seen"))
    rarest = each.join(written(counts, "word-counts"), "token", "left").groupBy("w").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "off")).alias("r"))
    return rarest.select("w", F.size("w").alias("n"), "r.token", "r.off")


def _hits(docs: DataFrame, prefixed: DataFrame, width: int, few: bool) -> DataFrame:
    """doc_id, text_hash, from, to, w for each place where a window lies."""
    listed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    each = listed.select("doc_id", "text_hash", "words", F.posexplode_outer("words").alias("pos", "token"))
    if few:
        met = each.join(F.broadcast(prefixed), "token").withColumn("from", F.col("pos") - F.col("off"))
        met = met.filter("from >= 0 AND from + n <= size(words)").filter("slice(words, from + 1, n) = w")
    else:
        first = F.greatest(F.col("pos") - width + 1, F.lit(0))
        near = each.select("doc_id", "text_hash", "pos", "token", first.alias("first"), F.slice("words", first + 1, 2 * width - 1).alias("near"))
        met = near.join(prefixed, "token").withColumn("from", F.col("pos") - F.col("off"))
        met = met.filter("from >= 0 AND from - first + n <= size(near)").filter("slice(near, from - first + 1, n) = w")
    return met.select("doc_id", "text_hash", "from", (F.col("from") + F.col("n")).alias("to"), "w")


def judged(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; and text_hash, to tell rows of equal doc_id apart."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = written(windows(benchmark, width), "windows")
    few = found.count() <= MOST_BROADCAST
    prefixed = written(_prefixed(found, docs, few), "prefix-words")
    hits = written(_hits(docs.filter("text IS NOT NULL"), prefixed, width, few), "hits")
    by_doc = ["doc_id", "text_hash"]
    # covered words: sorted spans, each counted beyond the furthest end so far
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["to"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(a["end"], s["from"]))).alias("n")),
    )["n"]
    spans = hits.groupBy(*by_doc).agg(F.collect_set(F.struct("from", "to")).alias("spans")).select(*by_doc, covered.cast("long").alias("n_hit"))
    items = hits.select(*by_doc, "w").distinct().join(F.broadcast(found) if few else found, "w").groupBy(*by_doc).agg(F.collect_set("item_id").alias("items"))
    hit = spans.join(items, (spans["doc_id"].eqNullSafe(items["doc_id"])) & (spans["text_hash"] == items["text_hash"])).select(spans["doc_id"].alias("_id"), spans["text_hash"].alias("_hash"), "n_hit", "items")
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), n_words.alias("n_words"))
    out = base.join(hit, base["doc_id"].eqNullSafe(hit["_id"]) & (base["text_hash"] == hit["_hash"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    listed = F.array_join(F.array_sort(F.transform(F.coalesce("items", F.array()), lambda i: i.cast("string"))), ",")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "text_hash",
    )
