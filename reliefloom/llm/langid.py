"""Operator 7: language identification with error-correcting output codes.

Each language has a codeword. For each bit a binary n-gram classifier is learned that tells the
languages with a 1 from those with a 0: the log-odds of hashed byte trigrams, every language weighing
alike. A text's margins (mean log-odds of all its trigrams) are decoded by loss: the codeword with the
smallest sum of logistic losses wins, each bit weighted by how well it separates the training texts.
A text whose two best codewords are nearly as close is flagged as ambiguous.

Learning takes labelled rows outside the held-out fold, at most about `most_rows` of them, spread over
the table by a hash of doc_id. Predictions see whole texts and nothing else.

Rows: a null text, or one without any letter, is `und` with score 0, as is every text if nothing could
be learned. Null labels are not learned from. Rows without doc_id are predicted, not learned from, and
in no fold. Repeated rows are predicted alike. A very long text is read whole, its trigrams in steps of
bounded size. Of equally near codewords the language first by name is taken, and flagged. Other columns are
kept by `identified` (results replace columns of their names) and ignored otherwise; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

FOLDS, HELD_OUT = 4, 2
MOST_ROWS = 20_000
FEATURE_BITS = 16
SMOOTHING = 0.5
SHARPNESS = 6.0
AMBIGUOUS = 0.02
UND = "und"
LETTER, ASCII_LETTER = regex.compile(r"\p{L}"), regex.compile("[A-Za-z]")


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def codewords(n: int) -> np.ndarray:
    """n codewords of 0 and 1: all splits for few languages, else splits drawn by rule, far apart."""
    if n <= 5:
        width = max(1, 2 ** (n - 1) - 1)
        return np.array([[(b + 2 ** (n - 1)) >> (n - 1 - i) & 1 for b in range(width)] for i in range(n)], np.int8) if n > 1 else np.ones((1, 1), np.int8)
    width = int(np.ceil(10 * np.log2(n)))
    drawn = [np.random.default_rng(seed).integers(0, 2, (n, width), np.int8) for seed in range(64)]
    useful = [c for c in drawn if (c.any(axis=0) & ~c.all(axis=0)).all()] or drawn
    return max(useful, key=lambda c: min((c[i] != c[j]).sum() for i, j in combinations(range(n), 2)))


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the bytes of all texts (A-Z lower-cased), and the bytes' offsets."""
    texts = pc.ascii_lower(texts)
    if texts.offset:
        texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64, len(texts) + 1).astype(np.int64)
    raw = texts.buffers()[2]
    b = np.frombuffer(raw, np.uint8, int(offsets[-1])).astype(np.uint32) if raw else np.zeros(0, np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint16), offsets
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURE_BITS)).astype(np.uint16), offsets


class Model:
    """Languages, codewords, bit weights and the log-odds of each feature for each bit."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.codes = langs, codewords(len(langs))
        n = counts.shape[1]
        share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * n)
        odds = []
        for bit in self.codes.T.astype(bool):
            one, zero = share[bit], share[~bit]
            odds.append(np.log(one.mean(axis=0)) - np.log(zero.mean(axis=0)) if len(one) and len(zero) else np.zeros(n))
        self.odds = np.stack(odds, axis=1).astype(np.float32)
        # how far the bit's classifier sets its two sides apart, by the training texts' own n-grams
        apart = (share[:, :, None] * self.odds[None]).sum(axis=1)
        sign = np.where(self.codes > 0, 1.0, -1.0)
        strength = np.maximum((apart * sign).min(axis=0), 0) + 1e-3
        self.weights = strength / strength.sum()

    def margins(self, texts: pa.Array) -> np.ndarray:
        grams, offsets = _trigrams(texts)
        out = np.zeros((len(texts), self.odds.shape[1]))
        first, last = offsets[:-1], np.minimum(np.maximum(offsets[1:] - 2, offsets[:-1]), len(grams))
        step = 1 << 20
        sums = np.zeros((len(texts), self.odds.shape[1]))
        for at in range(0, len(grams), step):  # texts may span steps: their parts add up
            part = self.odds[grams[at : at + step]]
            a, b = np.clip(first - at, 0, len(part)), np.clip(last - at, 0, len(part))
            rows = np.flatnonzero(b > a)
            if len(rows):
                cuts = np.stack([a[rows], b[rows]], axis=1).ravel()
                padded = np.concatenate([part, np.zeros((1, part.shape[1]), np.float32)])
                sums[rows] += np.add.reduceat(padded, cuts, axis=0)[::2]
        counts = np.maximum(last - first, 1)
        out[:] = sums / counts[:, None]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        margins = self.margins(texts)
        sign = np.where(self.codes > 0, 1.0, -1.0)
        loss = np.log1p(np.exp(-SHARPNESS * margins[:, None, :] * sign[None])) @ self.weights
        like = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * len(self.weights))
        like /= like.sum(axis=1, keepdims=True)
        best = like.argmax(axis=1)
        score = like.max(axis=1)
        second = np.partition(like, -2, axis=1)[:, -2] if like.shape[1] > 1 else np.zeros(len(like))
        return [self.langs[i] for i in best], score, score - second < AMBIGUOUS


def learned(docs: DataFrame, most_rows: int = MOST_ROWS) -> Model | None:
    """Learn from the labelled rows outside the held-out fold."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold() != HELD_OUT))
    n = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold() != HELD_OUT)).count()
    if n > most_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most_rows / n * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for at, texts in text_slices(b.column("text")):
                here = langs[at : at + len(texts)]
                for lang in set(here.tolist()):
                    grams, offsets = _trigrams(texts.filter(pa.array(here == lang)))
                    inside = np.ones(len(grams), bool)
                    for back in (1, 2):  # trigrams over the border of two texts
                        inside[offsets[1:-1][offsets[1:-1] >= back] - back] = False
                    held[lang] = held.get(lang, 0) + np.bincount(grams[inside], minlength=1 << FEATURE_BITS)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "feature", "n"])

    # at most 2**FEATURE_BITS rows for each language
    table = rows.select("text", "lang").mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    if not langs:
        return None
    counts = np.zeros((len(langs), 1 << FEATURE_BITS))
    which = np.searchsorted(np.array(langs), np.array(table.column("lang").to_pylist(), dtype=str))
    counts[which, table.column("feature").to_numpy()] = table.column("n").to_numpy()
    return Model(langs, counts)


def _lettered(texts: list[str | None]) -> np.ndarray:
    return np.array([t is not None and bool(ASCII_LETTER.search(t) or LETTER.search(t)) for t in texts], bool)


def identified(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with `lang_pred`, `lang_score`, `lang_ambiguous`, by the column named in `text`; a table must not have these already."""
    taken = {"lang_pred", "lang_score", "lang_ambiguous"} & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"the table has columns {sorted(taken)}: rename them, or see common.placed_columns")
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_ambiguous", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of features and bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            column = b.column(place)
            for at, texts in text_slices(column):
                real = _lettered(column.slice(at, len(texts)).to_pylist())
                if model is None:
                    real[:] = False
                    lang, score, unsure = [UND] * len(texts), np.zeros(len(texts)), real
                else:
                    lang, score, unsure = model.predict(texts)
                lang = [x if ok else UND for x, ok in zip(lang, real)]
                cols = [pa.array(lang, pa.string()), pa.array(np.where(real, score, 0.0)), pa.array(unsure & real)]
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(texts)).columns, *cols], names=[*b.schema.names, "lang_pred", "lang_score", "lang_ambiguous"])

    return docs.mapInArrow(run, schema)


def predictions(documents: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    out = identified(docs.select("doc_id", "text"), learned(docs, most_rows))
    return out.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
