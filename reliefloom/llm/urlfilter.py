"""Operator 3: URL filters by a cascade of Bloom filters.

The first level of a cascade encodes the listed keys; every key of the corpus is tested against it,
and the second level encodes those that pass without being listed; the third encodes the listed keys
that pass the second; and so on until no key passes wrongly. As the key universe is the whole
corpus, membership is exact for it, and pages are judged by bit tests alone, without a join.

The first level is sized by both numbers, the listed keys n and the candidate keys u of the corpus: it
has about 3 * n * (u / n) ** (1/3) bits, so that about n of the u pass wrongly and the next level is no
larger. A level that would have more than MOST_BITS bits is not held in the plan: the keys that pass
the levels before it are compared with the listed keys themselves, by a join on the key (`rest`).

A rule is a verdict, a host and a path prefix. A page's candidate keys are its host's label suffixes
joined to its path's prefixes, of no more labels and of the same lengths as rules have. There is a
cascade for each verdict; of the keys found, the longest decides (of equal lengths, the longest
host; of a key listed under both verdicts, `block`). Pages that no rule fits are allowed.

Rows: a null url, or one without `://`, has empty host and path and fits no rule with a host. Of a very
long url the whole host and path are returned; its keys are no longer than the rules allow. Repeated
rows are kept; a null page_id is returned as it is. Columns other than page_id and url are ignored,
whatever their names. An empty table gives no rows; without rules every page is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

Rule = tuple[str, str, str]
BITS_PER_KEY = 8
HASHES = 3
#: Filters are constants of the plan, of at most so many bits (1 MB) a level.
MOST_BITS = 1 << 23


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, labels: int, prefixes: list[int]) -> Column:
    """Keys of a page, longest host first, then longest path prefix."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.least(n, F.lit(labels)), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    starts = F.filter(F.array(*(F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in sorted(prefixes, reverse=True))), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))


class Cascade:
    """Levels of (bits, words); a key is listed if the first level that it fails is an even one, or the number of levels is odd."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, str]] = []
        self.rest: DataFrame | None = None  # listed keys, where the levels alone do not decide

    @staticmethod
    def _places(key: Column, level: int, bits: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(h)), F.lit(bits)) for h in range(HASHES)]

    def _passes(self, key: Column, level: int) -> Column:
        bits, words = self.levels[level]
        held = F.split(F.lit(words), ",").cast("array<bigint>")  # folded to a constant
        out = F.lit(True)
        for p in self._places(key, level, bits):
            word = F.element_at(held, (F.floor(p / 64) + 1).cast("int"))
            out = out & (F.getbit(word, (p % 64).cast("int")) == 1)
        return out

    def add_level(self, keys: DataFrame, least_bits: float) -> bool:
        """Encode the `key` rows: Spark ORs the bits of each word, the driver receives the words; False if they are too many."""
        bits = 64
        while bits < least_bits:
            bits *= 2
        if bits > MOST_BITS:
            return False
        level = len(self.levels)
        places = keys.select(F.explode(F.array(*self._places(F.col("key"), level, bits))).alias("p"))
        mask = F.element_at(F.array(*(F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64))), (F.col("p") % 64 + 1).cast("int"))
        got = dict(places.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(mask).alias("v")).collect())
        self.levels.append((bits, ",".join(str(got.get(w, 0)) for w in range(bits // 64))))
        return True

    def build(self, listed: DataFrame, universe: DataFrame) -> Cascade:
        """`listed` holds distinct `key` rows, `universe` every `key` of the corpus, repeated ones too."""
        n = listed.count()
        if not n:
            return self
        if not self.add_level(listed, max(BITS_PER_KEY * n, 3 * n * (universe.count() / n) ** (1 / 3))):
            self.rest = listed
            return self
        wrong = written(universe.filter(self._passes(F.col("key"), 0)).distinct().join(listed, "key", "left_anti"), "false-positives")
        inside, outside, n = wrong, listed, wrong.count()
        while n:
            level = len(self.levels)
            if not self.add_level(inside, BITS_PER_KEY * n):
                self.rest = listed
                return self
            passed = written(outside.filter(self._passes(F.col("key"), level)), "false-positives")
            inside, outside, n = passed, inside, passed.count()
        return self

    def holds(self, key: Column) -> Column:
        """Whether a key is listed; with `rest`, whether it may be: then the first level that it fails is an even one, or there is none."""
        out = F.lit(len(self.levels) % 2 == 1 or self.rest is not None)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def judged(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict of `page_id, url`."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    prefixes = sorted({len(p) for _, _, p in rules})
    none = F.lit(None).cast("string")
    if not rules:
        return parts.select("page_id", "host", "path", none.alias("rule"), F.lit("allow").alias("verdict"))
    keys = candidate_keys(F.col("host"), F.col("path"), labels, prefixes)
    universe = written(parts.select("host", "path").distinct().select(F.explode(keys).alias("key")), "candidate-keys")
    cascades = {}
    for verdict in ("block", "allow"):
        listed = sorted({h + p for v, h, p in rules if v == verdict})
        cascades[verdict] = Cascade().build(spark.createDataFrame([(k,) for k in listed], "key string"), universe)
    found = F.filter(keys, lambda k: cascades["block"].holds(k) | cascades["allow"].holds(k))
    if any(c.rest is not None for c in cascades.values()):
        return _joined(parts, found, cascades)
    longest = F.aggregate(found, none, lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))
    out = parts.select("page_id", "host", "path", longest.alias("rule"))
    verdict = F.when(cascades["block"].holds(F.col("rule")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNull(), "allow").otherwise(verdict).alias("verdict"))


def _joined(parts: DataFrame, found: Column, cascades: dict[str, Cascade]) -> DataFrame:
    """The same where a list is too long for the plan: what may be listed, by the filters, meets the lists on the key."""
    maybe = written(parts.select("host", "path").distinct().select("host", "path", F.posexplode(found).alias("at", "key")), "maybe-listed")
    listed = None
    for verdict, cascade in cascades.items():
        mine = cascade.rest if cascade.rest is not None else maybe.select("key").distinct().filter(cascade.holds(F.col("key")))
        mine = mine.select(F.col("key").alias("k"), F.lit(verdict == "block").alias("block"))
        listed = mine if listed is None else listed.unionByName(mine)
    listed = listed.groupBy("k").agg(F.max("block").alias("block"))
    best = F.min_by(F.struct("key", "block"), F.struct(-F.length("key"), "at"))
    sure = maybe.join(listed, F.col("key") == F.col("k")).groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(best.alias("b"))
    out = parts.join(sure, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return out.select("page_id", "host", "path", F.col("b.key").alias("rule"), F.when(F.col("b.block"), "block").otherwise("allow").alias("verdict"))
