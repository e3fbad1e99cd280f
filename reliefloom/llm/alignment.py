"""Operator 12: alignment of two tokenizers by external spill counting.

Each text is encoded by a byte-level BPE (A) and by a piece model with byte fallback (B). Where tokens of
both end at the same byte, both streams are cut into groups; within a group every A token is linked with every
B token. For each document come the links, how many documents of the corpus hold each linked pair of
ids, and whether a pair is the commonest of its A id.

1. Runs. A task gathers records (pair, document, links), splits them by radix (A id modulo the radices),
   sorts each part by A, B, document, and writes it as a zstd run. What counting needs (each pair once,
   with its number of documents in the run) is a column of its own, a small part of the records; so a pair that
   is in every document is one entry a run, not one a document.
2. Counting. Runs of one radix meet; a k-way heap merge of FAN_IN runs at a time adds up each pair. In A-major
   order all pairs of an A id stand together, and their highest count is known as the merge passes them.
3. Contributions. The counts of a radix are looked up for each of its runs and stream back to the task that holds the
   run's records, which adds them up by document.

Memory: a run of RUN_RECORDS, and the pairs of one radix (at most A's ids over the radices, times B's
ids, whatever the corpus). Runs, counts and results are tables in the shared folder.

Encoding. Both tokenizers cut wherever a space or line feed follows a character that is not white space, so texts
are cut there, each distinct chunk is encoded once a task (a memo of bounded size), and chunks are encoded
many to a text. Texts for which this can't be vouched for (a NUL, or a chunk whose bytes change) are encoded whole.

Rows: null and empty texts, and texts that either tokenizer changes, have no tokens: zeros and an empty
groups_sha256. Special tokens in a text are plain text. A row is a document: equal doc_ids and repeated rows
count separately, a null doc_id stays null. A very long text is one piece of a task's memory. Of
equally common B ids all are best. Other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_words, parallelism, ragged_take, text_slices, tokenizer_path, written

RUN_RECORDS = 1 << 21
SLICE_BYTES = 2 << 20
RADICES = 256
FAN_IN = 64
MEMO_BYTES = 64 << 20  # of text and links that a task remembers
TOGETHER = 64  # new chunks that are encoded as one text
WIDE_GROUP = 1 << 16  # links of a group beyond which its distinct ids are paired instead

#: White space other than the space and the line feed: no cut after these.
RARE_SPACE = r"\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
RUN_COLUMNS = "run long, radix int, kind int, keys binary, counts binary, docs binary, links binary"
HEADER, CONTRIBUTION, RECORDS = 0, 1, 2


def squeezed(values: np.ndarray) -> bytes:
    """Unsigned integers as zstd, in the narrowest width that holds them."""
    most = int(values.max()) if len(values) else 0
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(k).max)
    return kind[1:].encode() + zstandard.compress(values.astype(kind).tobytes(), 3)


def expanded(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob[2:]), f"<{blob[:2].decode()}").astype(np.int64)


def byte_level(token: str) -> bytes:
    """The bytes of a byte-level token: printable bytes stand for themselves, the others, in order, for code points from 256."""
    return bytes(_byte_places()[ord(c)] for c in token)


@lru_cache(maxsize=1)
def _byte_places() -> dict[int, int]:
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {256 + i: b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of each id, and their number."""

    def __init__(self, spelt: list[bytes]):
        self.spelt, self.length = spelt, np.array([len(b) for b in spelt], np.int64)

    def __len__(self) -> int:
        return len(self.spelt)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.spelt.__getitem__, ids.tolist()))


class Aligned:
    """Items (texts) aligned: numbers of tokens, groups and links of each, its groups as text, and its distinct pairs with their links."""

    def __init__(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, sizes: np.ndarray, one: Vocabulary, two: Vocabulary):
        self.n_a, self.n_b = n_a, n_b
        end_a, end_b, ends = np.cumsum(one.length[a]), np.cumsum(two.length[b]), np.cumsum(sizes)
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        in_a, in_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        item = np.searchsorted(ends, shared)  # of each group
        of_a, of_b = np.bincount(in_a, minlength=len(shared)), np.bincount(in_b, minlength=len(shared))
        n = len(sizes)
        self.n_groups = np.bincount(item, minlength=n)
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, item, of_a * of_b)
        wide = of_a * of_b > WIDE_GROUP
        first_b = np.cumsum(of_b) - of_b
        times = np.where(wide[in_a], 0, of_b[in_a])
        place = np.repeat(first_b[in_a] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        key, owner, links = np.repeat(a, times) * len(two) + b[place], np.repeat(item[in_a], times), np.ones(len(place), np.int64)
        for g in np.flatnonzero(wide):
            (ids_a, k_a), (ids_b, k_b) = np.unique(a[in_a == g], return_counts=True), np.unique(b[in_b == g], return_counts=True)
            key = np.concatenate([key, (ids_a[:, None] * len(two) + ids_b).ravel()])
            links = np.concatenate([links, (k_a[:, None] * k_b).ravel()])
            owner = np.concatenate([owner, np.full(len(ids_a) * len(ids_b), item[g])])
        self.keys, self.owner, self.links = summed(key, owner, links, by_owner=True)
        self.n_pairs = np.bincount(self.owner, minlength=n)
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        cut_a, cut_b = np.cumsum(of_a).tolist(), np.cumsum(of_b).tolist()
        spelt, i, j = [], 0, 0
        for p, q in zip(cut_a, cut_b):
            spelt.append(f"{','.join(text_a[i:p])}|{','.join(text_b[j:q])}")
            i, j = p, q
        cuts = np.cumsum(self.n_groups).tolist()
        self.spelt = [";".join(spelt[p:q]) for p, q in zip([0, *cuts], cuts)]


def summed(key: np.ndarray, owner: np.ndarray, links: np.ndarray, by_owner: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal key and owner added up, in order of the key, or of the owner first."""
    order = np.lexsort((key, owner) if by_owner else (owner, key))
    key, owner, links = key[order], owner[order], links[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if len(key) else np.zeros(0, np.int64)
    return key[first], owner[first], np.add.reduceat(links, first) if len(first) else links


class Aligner:
    """Two tokenizers, and a memo of the chunks of texts."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        spelt = dict(sorted((i, byte_level(t)) for t, i in self.a.get_vocab(with_added_tokens=True).items()))
        self.one = Vocabulary([spelt.get(i, b"") for i in range(max(spelt) + 1)])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)  # adds the space itself
        self.lead = len(self.b.encode("a"))
        size, piece = self.b.get_piece_size(), self.b.id_to_piece
        self.two = Vocabulary([bytes([int(piece(i)[1:-1], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(size)])
        #: No piece may reach over a cut, nor hold a line feed.
        self.cuttable = not any("▁" in piece(i).lstrip("▁") or "\n" in piece(i) for i in range(size))
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.spelt: list[str] = []
        self.facts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links; -1 where a chunk is not to be trusted
        self.keys, self.links, self.n_pairs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = 0

    def _ids_a(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_b(self, chunks: list[str]) -> list[list[int]]:
        """Ids of texts that begin with white space, without a space added: a letter takes it, and goes with it."""
        return [ids[self.lead :] for ids in self.b.encode([f"a{c}" for c in chunks])]

    def _checked(self, a: list[np.ndarray], b: list[list[int]], texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        b = [np.array(x, np.int64) for x in b]
        return a, b, np.array([self.one.joined(x) == t == self.two.joined(y) for x, y, t in zip(a, b, texts)], bool)

    def _learn(self, chunks: list[str]) -> None:
        """Put new chunks into the memo."""
        joint = [c for c in chunks if not c[-1:].isspace()]
        alone = [c for c in chunks if c[-1:].isspace()]
        parts = [joint[i : i + TOGETHER] for i in range(0, len(joint), TOGETHER)] + [[c] for c in alone]
        texts = ["".join(p) for p in parts]
        a, b, right = self._checked(self._ids_a(texts), self._ids_b(texts), [t.encode() for t in texts])
        if not right.all():  # one by one, to find the chunks that change
            again = [c for p, ok in zip(parts, right) if not ok for c in p]
            a2, b2, right2 = self._checked(self._ids_a(again), self._ids_b(again), [t.encode() for t in again])
            keep = np.flatnonzero(right).tolist()
            parts, a, b = [parts[i] for i in keep] + [[c] for c in again], [a[i] for i in keep] + a2, [b[i] for i in keep] + b2
            bad = {c for c, ok in zip(again, right2) if not ok}
            a = [x if not (p[0] in bad) else x[:0] for p, x in zip(parts, a)]
            b = [x if not (p[0] in bad) else x[:0] for p, x in zip(parts, b)]
        else:
            bad = set()
        order = [c for p in parts for c in p]
        sizes = np.array([0 if c in bad else len(c.encode()) for c in order], np.int64)
        flat_a, flat_b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
        ends = np.cumsum(sizes)
        count = lambda flat, v: np.bincount(np.searchsorted(ends, np.cumsum(v.length[flat])), minlength=len(order))
        found = Aligned(flat_a, count(flat_a, self.one), flat_b, count(flat_b, self.two), sizes, self.one, self.two)
        facts = np.stack([found.n_a, found.n_b, found.n_groups, found.n_links], axis=1)
        facts[[c in bad for c in order]] = -1
        self.number.update((c, len(self.spelt) + i) for i, c in enumerate(order))
        self.spelt += found.spelt
        self.facts = np.concatenate([self.facts, facts])
        self.keys, self.links, self.n_pairs = np.concatenate([self.keys, found.keys]), np.concatenate([self.links, found.links]), np.concatenate([self.n_pairs, found.n_pairs])
        self.held += int(sizes.sum()) + sum(map(len, found.spelt)) + 16 * len(found.keys) + 300 * len(order)

    def whole(self, texts: list[str]) -> Aligned:
        """Texts encoded by the libraries, each as it is; one that they change has nothing."""
        a, b, right = self._checked(self._ids_a([f" {t}" for t in texts]), self.b.encode(texts), [f" {t}".encode() for t in texts])
        right &= np.array([bool(t) for t in texts], bool)
        a, b = [x if ok else x[:0] for x, ok in zip(a, right)], [x if ok else x[:0] for x, ok in zip(b, right)]
        sizes = np.array([len(t.encode()) + 1 if ok else 0 for t, ok in zip(texts, right)], np.int64)
        n = lambda lists: np.array([len(x) for x in lists], np.int64)
        return Aligned(np.concatenate([*a, np.zeros(0, np.int64)]), n(a), np.concatenate([*b, np.zeros(0, np.int64)]), n(b), sizes, self.one, self.two)

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text n_a, n_b, n_groups, n_links and the digest of its groups; and its pairs: key, row, links, in order of the key."""
        spaced = pc.binary_join_element_wise("", texts, " ")
        lists = pc.split_pattern(pc.replace_substring_regex(spaced, f"([^ \\n{RARE_SPACE}])([ \\n])", "\\1\0\\2"), "\0")
        offsets, chunk, words = distinct_words(lists)
        if self.held > MEMO_BYTES:
            self._forget()
        new = [w for w in words if w not in self.number]
        if new:
            self._learn(new)
        number = np.array([self.number[w] for w in words], np.int64)[chunk]
        n = len(texts)
        row = np.repeat(np.arange(n), np.diff(offsets))
        odd = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False) | (np.bincount(row, self.facts[number, 0] < 0, minlength=n) > 0) | (not self.cuttable)
        blank = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        plain = ~(odd | blank)
        number, row = number[plain[row]], row[plain[row]]
        facts = np.zeros((n, 4), np.int64)
        for c in range(4):
            np.add.at(facts[:, c], row, self.facts[number, c])
        keys, lengths = ragged_take(self.keys, self.n_pairs, number)
        links, _ = ragged_take(self.links, self.n_pairs, number)
        owner = np.repeat(row, lengths)
        ends = np.searchsorted(row, np.arange(n + 1)).tolist()
        spelt = list(map(self.spelt.__getitem__, number.tolist()))
        digest = [hashlib.sha256(";".join(spelt[p:q]).encode()).hexdigest() if q > p else "" for p, q in zip(ends, ends[1:])]
        rest = np.flatnonzero(odd & ~blank)
        if len(rest):
            more = self.whole([texts[int(i)].as_py() for i in rest])
            facts[rest] = np.stack([more.n_a, more.n_b, more.n_groups, more.n_links], axis=1)
            for i, s in zip(rest.tolist(), more.spelt):
                digest[i] = hashlib.sha256(s.encode()).hexdigest() if s else ""
            keys, owner, links = np.concatenate([keys, more.keys]), np.concatenate([owner, rest[more.owner]]), np.concatenate([links, more.links])
        return facts, digest, *summed(keys, owner, links)


@lru_cache(maxsize=1)
def loaded(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in RUN_COLUMNS.split(", ")])


def runs(docs: DataFrame, a_path: str, b_path: str, radices: int) -> DataFrame:
    """Sorted zstd runs of records, a row for each run and radix, and a header row with what is known of the run's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, name = loaded(a_path, b_path), TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        facts: list[np.ndarray] = []
        digests: list[str] = []
        keys: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        links: list[np.ndarray] = []
        held = n = 0

        def made() -> pa.RecordBatch:
            key, row, link = np.concatenate(keys), np.concatenate(rows), np.concatenate(links)
            order = np.argsort(key, kind="stable")  # slices are in order of their rows
            order = order[np.argsort((key[order] // len(aligner.two) % radices).astype(np.uint16), kind="stable")]
            key, row, link = key[order], row[order], link[order]
            head = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(c) for c in np.concatenate(facts).T), pa.array(digests, pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "sha"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as stream:
                stream.write_batch(head)
            out = [(name, -1, HEADER, None, None, zstandard.compress(sink.getvalue().to_pybytes(), 3), None)]
            radix = key // len(aligner.two) % radices
            cuts = np.searchsorted(radix, np.arange(radices + 1))
            for r, (p, q) in enumerate(zip(cuts, cuts[1:])):
                if p < q:
                    first = np.flatnonzero(np.r_[True, np.diff(key[p:q]) != 0])
                    pairs = key[p:q][first]
                    out.append((name, r, RECORDS, squeezed(np.diff(pairs, prepend=0)), squeezed(np.diff(first, append=q - p)), squeezed(row[p:q]), squeezed(link[p:q])))
            return _record_batch(out)

        for b in batches:
            for at, texts in text_slices(b.column(1), SLICE_BYTES):
                fact, digest, key, row, link = aligner.align(texts)
                ids.append(b.column(0).slice(at, len(texts)))
                facts.append(fact)
                digests += digest
                keys.append(key)
                rows.append(row + n)
                links.append(link)
                n, held = n + len(texts), held + len(key) + len(texts)
                if held >= RUN_RECORDS:
                    yield made()
                    ids, facts, digests, keys, rows, links, held, n, name = [], [], [], [], [], [], 0, 0, name + 1
        if n:
            yield made()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RUN_COLUMNS)


def k_way_merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists of (key, count) as one, equal keys added up."""
    if len(parts) == 1:
        return parts[0]
    keys: list[int] = []
    counts: list[int] = []
    last = -1
    for key, n in heapq.merge(*(zip(k.tolist(), c.tolist()) for k, c in parts)):
        if key == last:
            counts[-1] += n
        else:
            keys.append(key)
            counts.append(n)
            last = key
    return np.array(keys, np.int64), np.array(counts, np.int64)


def highest(keys: np.ndarray, counts: np.ndarray, n_b: int) -> np.ndarray:
    """Which pairs, in A-major order, have the highest count of their A id."""
    a = keys // n_b
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    return counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(a)))


def _by_row(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}


def pair_counts(table: DataFrame, n_b: int) -> DataFrame:
    """radix, keys, counts, best: how many documents hold each pair, from the runs of each radix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radix, parts = -1, []

        def done() -> pa.RecordBatch:
            keys, counts = k_way_merge(parts)
            cells = [squeezed(np.diff(keys, prepend=0)), squeezed(counts), squeezed(highest(keys, counts, n_b).view(np.uint8))]
            return pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], names=["radix", "keys", "counts", "best"])

        for x in _by_row(batches):
            if x["radix"] != radix:
                if parts:
                    yield done()
                radix, parts = x["radix"], []
            parts.append((np.cumsum(expanded(x["keys"])), expanded(x["counts"])))
            if len(parts) == FAN_IN:
                parts = [k_way_merge(parts)]
        if parts:
            yield done()

    lists = table.filter(F.col("kind") == RECORDS).select("radix", "run", "keys", "counts")
    return lists.repartition(parallelism(table.sparkSession), "radix").sortWithinPartitions("radix", "run").select("radix", "keys", "counts").mapInArrow(run, "radix int, keys binary, counts binary, best binary")


def contributions(table: DataFrame, counted: DataFrame) -> DataFrame:
    """For each run and radix, the corpus-wide count of its pairs (in `keys`) and whether it is the highest (in `counts`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = counts = best = np.zeros(0, np.int64)
        for x in _by_row(batches):
            pairs = np.cumsum(expanded(x["keys"]))
            if x["run"] is None:  # the counts of a radix stand before its runs
                keys, counts, best = pairs, expanded(x["counts"]), expanded(x["best"])
                continue
            at = np.searchsorted(keys, pairs)
            yield _record_batch([(x["run"], x["radix"], CONTRIBUTION, squeezed(counts[at]), squeezed(best[at]), None, None)])

    none = F.lit(None)
    lists = table.filter(F.col("kind") == RECORDS).select("radix", "run", "keys", none.cast("binary").alias("counts"), none.cast("binary").alias("best"))
    both = counted.select("radix", none.cast("long").alias("run"), "keys", "counts", "best").unionByName(lists)
    return both.repartition(parallelism(table.sparkSession), "radix").sortWithinPartitions("radix", F.asc_nulls_first("run")).mapInArrow(run, RUN_COLUMNS)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _gathered(table: DataFrame, contributed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, best, total, came = None, None, None, None

        def done() -> pa.RecordBatch:
            own = [head.column(i) for i in range(5)]
            return pa.RecordBatch.from_arrays([*own, pa.array(best), pa.array(total), head.column(5)], names=[c.split()[0] for c in RESULT.split(", ")])

        for x in _by_row(batches):
            if x["kind"] == HEADER:
                if head is not None:
                    yield done()
                head = pa.ipc.open_stream(zstandard.decompress(x["docs"])).read_next_batch()
                best, total = np.zeros(head.num_rows, np.int64), np.zeros(head.num_rows, np.int64)
            elif x["kind"] == CONTRIBUTION:
                came = expanded(x["keys"]), expanded(x["counts"])
            else:
                times, row, links = expanded(x["counts"]), expanded(x["docs"]), expanded(x["links"])
                np.add.at(total, row, links * np.repeat(came[0], times))
                np.add.at(best, row, links * np.repeat(came[1], times))
        if head is not None:
            yield done()

    both = table.withColumn("keys", F.lit(None).cast("binary")).unionByName(contributed)
    return both.repartition(parallelism(table.sparkSession), "run").sortWithinPartitions("run", "radix", "kind").mapInArrow(run, RESULT)


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of `doc_id, text`."""
    a_path, b_path = a_path or tokenizer_path("byte_bpe_50k.json"), b_path or tokenizer_path("piece_bpe_32k.model")
    radices = min(1 << 15, max(RADICES, parallelism(docs.sparkSession)))
    table = written(runs(docs, a_path, b_path, radices), "alignment-runs")
    counted = written(pair_counts(table, len(loaded(a_path, b_path).two)), "alignment-counts")
    return _gathered(table, contributions(table, counted))
