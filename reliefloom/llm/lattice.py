"""Operator 8: language-model scoring by a subword lattice.

An existing subword vocabulary gives the pieces; the probability of spelling a word is the sum over
all its segmentations into pieces, found by a forward recursion in log space over the word's bytes.
Piece probabilities start from the vocabulary's own scores (read as ranks) and are re-estimated by
expected counts over the distinct training words. Words begin with the vocabulary's word mark, so
pieces never span words, and a document's marginal probability is the product over its words and one
end token.

A word seen in training has one more arc, over the whole word: of its c occurrences in N tokens, c - D
count for that arc, and the D that are left over from each of the V distinct words make the weight of
spelling (D from the numbers of words seen once and twice). So a word's probability is
(c - D) / N + (D * V / N) * P(spelling), which adds up to one over all words.

`lattice_score` is the sum over all segmentations alone, without that arc: the lattice as it stands.

Beside them is a base model: word counts with one added.

Words are counted over the whole corpus, and the lattice runs once for each distinct word. The most
frequent words (at most HOT_WORDS) are sent to all tasks; the others meet their figures in a join,
after being summed up for each document.

Rows: a null or empty text has the end token only. Repeated rows are scored alike. Rows without
doc_id are scored and not learned from. Without training documents the base counts nothing and words
are only spelt, with the vocabulary's scores. A very long text costs memory for its distinct words; a
word of more than LONG bytes goes through the recursion alone, byte by byte over a window as long as the
longest piece. Equal counts are ordered by the word. Other columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_words, parallelism, sums_by_list, text_slices, tokenizer_path, written

FOLDS, HELD_OUT = 7, 2
HOT_WORDS = 150_000
ROUNDS = 2
LEAST_SHARE = 0.1  # expected count that every piece is given
MARK = "▁".encode()
COUNT_SLICE = 16 << 20
STEP = np.uint64(0x100000001B3)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = 18
CELLS = 400_000
LONG = 1 << 15  # bytes of a word that is not laid out as a row of arrays
WINDOW = 1 << 16


#: What is summed over a text's words: base model, model, lattice alone, words seen in training.
FIGURES = ("base", "lp", "sp", "known")


class Pieces:
    """Pieces of a sentencepiece file as bytes, and a hash table that finds many at a time."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i):
                continue
            p = bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode()
            found[p] = max(found.get(p, -1e9), sp.get_score(i))
        for b in range(256):
            found.setdefault(bytes([b]), min(found.values()))
        self.pieces = list(found)
        self.end = len(self.pieces)  # the number of the end token
        rank = np.argsort(np.argsort(-np.array([*found.values(), 0.0]), kind="stable"), kind="stable")
        start = 1.0 / (rank + 2.0)
        self.start = start / start.sum()
        self.longest = max(map(len, self.pieces))
        self.lengths = frozenset(map(len, self.pieces))
        keys = np.array([self._hash(p) for p in self.pieces], np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.slot_key = np.zeros(1 << SLOT_BITS, np.uint64)
        self.slot_piece = np.full(1 << SLOT_BITS, -1, np.int32)
        self.probes = 1
        for n, key in enumerate(keys):
            at, probe = int(self._slot(keys[n : n + 1])[0]), 1
            while self.slot_piece[at] >= 0:
                at, probe = (at + 1) & ((1 << SLOT_BITS) - 1), probe + 1
            self.slot_key[at], self.slot_piece[at] = key, n
            self.probes = max(self.probes, probe)

    @staticmethod
    def _hash(p: bytes) -> int:
        h = 0
        for c in p:
            h = (h * int(STEP) + c + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key ^ (key >> np.uint64(32))) * SPREAD) >> np.uint64(64 - SLOT_BITS)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 where there is none."""
        at = self._slot(keys).astype(np.int64)
        out = np.where(self.slot_key[at] == keys, self.slot_piece[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.slot_piece[at] >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << SLOT_BITS) - 1)
            hit = self.slot_key[at[open_]] == keys[open_]
            out[open_[hit]] = self.slot_piece[at[open_[hit]]]
            open_ = open_[~hit & (self.slot_piece[at[open_]] >= 0)]
        return out

    def arcs(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """For words of one length (rows of bytes): the piece from each start, by length - 1; -1 for none.

        A length of which no word has a piece is left out.
        """
        n, length = words.shape
        h = np.zeros((n, length), np.uint64)
        out = {}
        for k in range(min(self.longest, length)):
            h = h[:, : length - k] * STEP + words[:, k:] + np.uint64(1)
            if k + 1 in self.lengths:
                found = self.find(h.ravel()).reshape(h.shape)
                if (found >= 0).any():
                    out[k] = found
        return out


def _logp(arcs: dict[int, np.ndarray], log_p: np.ndarray) -> dict[int, np.ndarray]:
    return {k: np.where(a >= 0, log_p[a], -np.inf) for k, a in arcs.items()}


def _forward(weights: dict[int, np.ndarray], length: int) -> np.ndarray:
    n = len(weights[0])
    alpha = np.full((n, length + 1), -np.inf)
    alpha[:, 0] = 0
    for j in range(1, length + 1):
        into = np.stack([alpha[:, j - k - 1] + w[:, j - k - 1] for k, w in weights.items() if k < j])
        top = into.max(axis=0)
        alpha[:, j] = top + np.log(np.exp(into - top).sum(axis=0))
    return alpha


def _backward(weights: dict[int, np.ndarray], length: int) -> np.ndarray:
    n = len(weights[0])
    beta = np.full((n, length + 1), -np.inf)
    beta[:, length] = 0
    for i in range(length - 1, -1, -1):
        out = np.stack([w[:, i] + beta[:, i + k + 1] for k, w in weights.items() if k < length - i])
        top = out.max(axis=0)
        beta[:, i] = top + np.log(np.exp(out - top).sum(axis=0))
    return beta


def _windows(pieces: Pieces, raw: bytes, backwards: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of start places of a long word: the first place, piece lengths, and the pieces by start and length, -1 for none."""
    begins = range(0, len(raw), WINDOW)
    for at in reversed(begins) if backwards else begins:
        arcs = pieces.arcs(np.frombuffer(raw[at : at + WINDOW + pieces.longest], np.uint8)[None])
        n, lengths = min(WINDOW, len(raw) - at), np.array(sorted(arcs))
        found = np.full((n, len(lengths)), -1, np.int32)
        for c, k in enumerate(lengths):
            here = arcs[k][0][:n]
            found[: len(here), c] = here
        yield at, lengths + 1, found


def _forward_long(pieces: Pieces, raw: bytes, log_p: np.ndarray) -> np.ndarray:
    """The forward values of one long word."""
    alpha = np.full(len(raw) + 1 + pieces.longest, -np.inf)
    alpha[0] = 0
    for at, lengths, found in _windows(pieces, raw):
        weights = np.where(found >= 0, log_p[found], -np.inf)
        for i, w in enumerate(weights, at):
            alpha[i + lengths] = np.logaddexp(alpha[i + lengths], alpha[i] + w)
    return alpha[: len(raw) + 1]


def _expected_long(pieces: Pieces, raw: bytes, log_p: np.ndarray, out: np.ndarray, times: float) -> None:
    """Add the expected counts of one long word to `out`."""
    alpha = _forward_long(pieces, raw, log_p)
    beta = np.full(len(raw) + 1 + pieces.longest, -np.inf)
    beta[len(raw)] = 0
    for at, lengths, found in _windows(pieces, raw, backwards=True):
        weights, post = np.where(found >= 0, log_p[found], -np.inf), np.zeros(found.shape)
        for i in range(len(found) - 1, -1, -1):
            onward = weights[i] + beta[at + i + lengths]
            beta[at + i] = np.logaddexp.reduce(onward)
            post[i] = np.exp(alpha[at + i] + onward - alpha[-1])
        real = found >= 0
        out += times * np.bincount(found[real], weights=post[real], minlength=len(out))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of words of one length, and their bytes with the word mark, in bounded runs."""
    raw = [MARK + w.encode() for w in words]
    lengths = np.array([len(r) for r in raw])
    order = np.argsort(lengths, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if not len(rows):
            continue
        length = int(lengths[rows[0]])
        step = max(1, CELLS // length)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            yield some, np.frombuffer(b"".join(raw[i] for i in some), np.uint8).reshape(len(some), length)


def word_log_probs(pieces: Pieces, words: list[str], log_p: np.ndarray) -> np.ndarray:
    """Natural log of each word's marginal probability."""
    out = np.zeros(len(words))
    for rows, b in _by_length(words):
        if b.shape[1] > LONG:
            out[rows] = [_forward_long(pieces, x.tobytes(), log_p)[-1] for x in b]
            continue
        out[rows] = _forward(_logp(pieces.arcs(b), log_p), b.shape[1])[:, -1]
    return out


def expected_counts(pieces: Pieces, words: list[str], times: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """How often each piece is expected, over all segmentations of all words."""
    out = np.zeros(len(log_p))
    for rows, b in _by_length(words):
        if b.shape[1] > LONG:
            for row, x in zip(rows, b):
                _expected_long(pieces, x.tobytes(), log_p, out, times[row])
            continue
        arcs, length = pieces.arcs(b), b.shape[1]
        weights = _logp(arcs, log_p)
        alpha, beta = _forward(weights, length), _backward(weights, length)
        total = alpha[:, -1:]
        for k, a in arcs.items():
            post = np.exp(alpha[:, : length - k] + weights[k] + beta[:, k + 1 :] - total) * times[rows, None]
            real = a >= 0
            out += np.bincount(a[real], weights=post[real], minlength=len(out))
    return out


@lru_cache(maxsize=1)
def loaded(path: str) -> Pieces:
    return Pieces(path)


def _word_counts(docs: DataFrame) -> DataFrame:
    """word, c, n: occurrences in training documents, and in all; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in text_slices(b.column("text"), COUNT_SLICE):
                train = b.column("train").slice(at, len(texts)).to_numpy(zero_copy_only=False)
                offsets, word, words = distinct_words(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
                each = np.repeat(train, np.diff(offsets))
                n = np.bincount(word, minlength=len(words))
                c = np.bincount(word[each], minlength=len(words))
                real = np.array([bool(w) for w in words], bool)
                words = pa.array(words, pa.string()).filter(pa.array(real))
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([words, pa.array([""])]), pa.array(np.append(c[real], train.sum())), pa.array(np.append(n[real], len(train)))], names=["word", "c", "n"]
                )

    # words are dealt over as many tasks as there are, not fewer: what follows costs more than their bytes tell
    each = docs.select("text", "train").mapInArrow(run, "word string, c long, n long").repartition(parallelism(docs.sparkSession), "word")
    return each.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _estimated(counts: DataFrame, path: str, rounds: int) -> np.ndarray:
    """Log probabilities of the pieces and the end token, from expected counts over the distinct training words."""
    pieces = loaded(path)
    spark = counts.sparkSession
    p = pieces.start
    train = counts.filter("c > 0")
    if train.isEmpty():
        return np.log(p)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(np.log(p))  # as long as the vocabulary

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, out = loaded(path), np.zeros(len(shared.value))
            for b in batches:
                words = b.column("word").to_pylist()
                spelt = [w for w in words if w]
                out[pieces.end] += len(words) - len(spelt)
                out += expected_counts(pieces, spelt, np.ones(len(spelt)), shared.value)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["piece", "times"])

        table = train.select("word").mapInArrow(run, "piece long, times double").groupBy("piece").agg(F.sum("times").alias("times")).toArrow()
        p = np.full(len(p), LEAST_SHARE)
        p[table.column("piece").to_numpy()] += table.column("times").to_numpy()
        p /= p.sum()
    return np.log(p)


def scored(documents: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    spark = documents.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(fold != HELD_OUT, F.lit(False)).alias("train"))
    counts = written(_word_counts(docs), "word-counts")
    log_p = spark.sparkContext.broadcast(_estimated(counts, path, rounds))
    times = lambda k: F.count(F.when(F.col("c") == k, 1))
    totals = counts.agg(F.sum("c").alias("N"), F.count(F.when(F.col("c") > 0, 1)).alias("V"), times(1).alias("once"), times(2).alias("twice")).first()
    tokens, distinct = totals["N"] or 0, totals["V"]
    left = totals["once"] / (totals["once"] + 2 * totals["twice"]) if totals["once"] and totals["twice"] else 0.5
    to_spell = np.log(left * distinct / tokens) if tokens else 0.0

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for b in batches:
            listed = b.column("word").to_pylist()
            lp = np.full(len(listed), log_p.value[pieces.end])
            rest = [i for i, w in enumerate(listed) if w]
            lp[rest] = word_log_probs(pieces, [listed[i] for i in rest], log_p.value)
            c = b.column("c").to_numpy()
            whole = np.full(len(listed), -np.inf)
            whole[c > 0] = np.log((c[c > 0] - left) / max(tokens, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.logaddexp(whole, lp + to_spell) / np.log(10)), pa.array(lp / np.log(10))], names=["word", "c", "n", "lp", "sp"])

    figures = written(counts.mapInArrow(words, "word string, c long, n long, lp double, sp double"), "word-figures")
    base = F.log10((F.col("c") + 1) / F.lit(float(tokens + distinct + 1)))
    figures = figures.select("word", "n", base.alias("base"), "lp", "sp", (F.col("c") > 0).cast("long").alias("known"))
    end = figures.filter("word = ''").first()
    hot = figures.filter("word != ''").orderBy(F.desc("n"), "word").limit(HOT_WORDS)
    hot = hot.select("word", *FIGURES).toArrow()  # at most HOT_WORDS rows
    table = spark.sparkContext.broadcast(dict(zip(hot.column("word").to_pylist(), zip(*(hot.column(c).to_pylist() for c in FIGURES)))))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = table.value, TaskContext.get().partitionId() << 40
        for b in batches:
            for at, texts in text_slices(b.column("text")):
                offsets, word, listed = distinct_words(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
                got = [known.get(w) for w in listed]
                cold = np.array([g is None and bool(w) for g, w in zip(got, listed)], bool)
                values = np.array([g or (0.0,) * len(FIGURES) for g in got], float).reshape(-1, len(FIGURES))
                real = np.array([bool(w) for w in listed], bool)
                sums = [sums_by_list(values[word, k], offsets) for k in range(len(FIGURES))]
                tokens = sums_by_list(real[word], offsets)
                owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
                mine = cold[word]
                pairs, times = np.unique(owner[mine] * (len(listed) + 1) + word[mine], return_counts=True)
                which, number = pairs // (len(listed) + 1), pairs % (len(listed) + 1)
                cuts = np.searchsorted(which, np.arange(len(texts) + 1)).astype(np.int32)
                lists = lambda values: pa.ListArray.from_arrays(pa.array(cuts), values)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(texts))), b.column("doc_id").slice(at, len(texts)), b.column("train").slice(at, len(texts)), pa.array(tokens.astype(np.int64)), *map(pa.array, sums),
                        lists(pa.array(listed, pa.string()).take(pa.array(number))), lists(pa.array(times.astype(np.int64))),
                    ],
                    names=["row", "doc_id", "train", "tokens", *FIGURES, "words", "times"],
                )
                row += len(texts)

    parts = written(docs.mapInArrow(split, "row long, doc_id long, train boolean, tokens long, base double, lp double, sp double, known double, words array<string>, times array<long>"), "hot-scores")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(figures.drop("n"), "word").select("row", *((F.col(c) * F.col("times")).alias(c) for c in FIGURES))
    every = parts.select("row", *FIGURES).unionByName(rare).groupBy("row").agg(*(F.sum(c).alias(c) for c in FIGURES))
    of_end = [end[c] if end else 0.0 for c in FIGURES]
    base_sum, lp_sum, sp_sum, known_sum = (F.col(c) + F.lit(e) for c, e in zip(FIGURES, of_end))
    out = parts.select("row", "doc_id", "tokens").join(every, "row")
    return out.select(
        "doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), (F.col("tokens") + 1).alias("n_tokens"), known_sum.cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base_sum.alias("base_score"), lp_sum.alias("score"), sp_sum.alias("lattice_score"),
    )
