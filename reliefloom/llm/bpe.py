"""Operator 1: BPE encoding and decoding with a contiguous rank array.

A word is held as flat arrays: the part boundaries with the id of each part, and the rank of each
adjacent pair of parts. The smallest rank is looked up by a scan, the boundary inside that pair is
deleted, and only the two neighbouring ranks are refreshed. Long words use the same rule over a heap of pairs, since a scan
per merge would be quadratic in their length.

Results equal those of the tokenizers library for a vocabulary file of its own format (JSON, model
BPE, optional end-of-word suffix, byte-level alphabet), without special tokens added at the ends;
special tokens written out in a text become their ids, as there.

Rows: null text counts as empty; an empty text has no ids. Repeated rows are kept. A very long text is
coded whole, in memory of one task; a very long word merges over a heap. Of equal ranks the leftmost pair
merges first. Columns other than the text are untouched; `ids` and `decoded` replace columns of these
names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import distinct_words, lengths_to_list_array, ragged_take, sums_by_list, text_slices, tokenizer_path

#: Words of more parts than this are merged over a heap.
SCAN_PARTS = 200
#: Words kept with their ids in each Python worker; later words are encoded anew.
MEMO_WORDS = 200_000
#: Ids decoded at a time: lists of Python integers take eight times the room of the column.
DECODE_IDS = 1 << 19
#: Bytes of text coded at a time where ids and decoded texts go back together.
CODE_BYTES = 1 << 20
NO_RANK = 1 << 60

#: The pre-tokenizer pattern for plain ASCII words of a word-end vocabulary.
ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")


class Merges:
    """The merge rules of a vocabulary, over token ids."""

    def __init__(self, merges: list[list[str]], vocab: dict[str, int]):
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for i, (a, b) in enumerate(merges):
            self.rank[vocab[a] << 32 | vocab[b]] = i
            self.made.append(vocab[a + b])

    def apply(self, ids: list[int]) -> list[int]:
        """Merge adjacent parts by lowest rank, leftmost first among equals; changes `ids`."""
        if len(ids) > SCAN_PARTS:
            return self._apply_long(ids)
        get, made = self.rank.get, self.made
        bounds = list(range(len(ids) + 1))
        ranks = [get(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != NO_RANK:
            at = ranks.index(low)
            ids[at] = new = made[low]
            del bounds[at + 1], ranks[at], ids[at + 1]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 32 | new, NO_RANK)
            if at < len(ranks):
                ranks[at] = get(new << 32 | ids[at + 1], NO_RANK)
        return ids

    def _apply_long(self, ids: list[int]) -> list[int]:
        part: list[int] = list(ids)
        gone, end = -1, len(part)
        left, right = list(range(-1, end - 1)), list(range(1, end + 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := self.rank.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if part[i] != a or j >= end or part[j] != b:
                continue  # one of the two has been merged meanwhile
            part[i], part[j] = self.made[rank], gone
            right[i] = right[j]
            if right[i] < end:
                left[right[i]] = i
            for x in (left[i], i):
                y = right[x] if x >= 0 else end
                if y < end and (r := self.rank.get(part[x] << 32 | part[y])) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return [p for p in part if p != gone]


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.merges = Merges(model["merges"], self.vocab)
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        top = max([*self.vocab.values(), *self.special.values()]) + 1
        self.token = [""] * top
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = text
        self.number = [str(i) for i in range(top)]
        self.width = np.dtype(np.uint16 if top <= 1 << 16 else np.uint32)
        self.memo: dict[str, bytes] = {}
        self.piece_memo: dict[str, bytes] = {}

    def _pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a text, in the byte-level alphabet."""
        if chunk.isascii() and chunk.isprintable():
            return ASCII_PARTS.findall(chunk.lower())
        normal = self.normalizer.normalize_str(chunk)
        return [piece for piece, _ in self.pre_tokenizer.pre_tokenize_str(normal)]

    def _encode_piece(self, piece: str) -> bytes:
        parts = list(piece)
        parts[-1] += self.suffix
        get = self.vocab.get
        out = np.array(self.merges.apply([i for p in parts if (i := get(p)) is not None]), self.width).tobytes()
        if len(self.piece_memo) < MEMO_WORDS and len(piece) <= 64:
            self.piece_memo[piece] = out
        return out

    def _encode_chunk(self, chunk: str) -> bytes:
        """Ids of a text that holds no ASCII white space, as bytes."""
        if "<|" in chunk:
            parts = enumerate(self.special_pattern.split(chunk))
            return b"".join(np.array([self.special[p]], self.width).tobytes() if i % 2 else self._encode_plain(p) for i, p in parts)
        return self._encode_plain(chunk)

    def _encode_plain(self, chunk: str) -> bytes:
        memo, new = self.piece_memo, self._encode_piece
        return b"".join([memo[p] if p in memo else new(p) for p in self._pieces(chunk)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and the number of ids of each.

        No token spans white space, so each distinct chunk between white space is encoded once.
        """
        offsets, chunk, chunks = distinct_words(pc.ascii_split_whitespace(texts))
        memo, pool = self.memo, []
        for c in chunks:
            ids = memo.get(c)
            if ids is None:
                ids = self._encode_chunk(c)
                if len(memo) < MEMO_WORDS and len(c) <= 64:
                    memo[c] = ids
            pool.append(ids)
        lengths = np.array([len(x) for x in pool], np.int64) // self.width.itemsize
        ids, taken = ragged_take(np.frombuffer(b"".join(pool), self.width), lengths, chunk)
        return ids, sums_by_list(taken, offsets)

    def split(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        ids, lengths = self.encode(texts)
        return np.split(ids, np.cumsum(lengths)[:-1])

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by one space: the library's rule where a file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))

    def id_text(self, ids: list[int]) -> str:
        return " ".join(map(self.number.__getitem__, ids))


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    """The encoder of a Python worker; it is kept between tasks."""
    return WordBpe(path)


def encoded(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """df with `ids array<int>`: the token ids of each whole text."""
    path = path or tokenizer_path("word_bpe_49k.json")
    df = df.drop("ids")
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            for at, texts in text_slices(b.column(text)):
                flat, lengths = bpe.encode(texts)
                col = lengths_to_list_array(flat.astype(np.int32), lengths, pa.int32())
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(texts)).columns, col], names=[*b.schema.names, "ids"])

    return df.mapInArrow(run, schema)


def decoded(df: DataFrame, path: str | None = None) -> DataFrame:
    """df with `decoded string`: the text of its `ids`; null ids give an empty text."""
    path = path or tokenizer_path("word_bpe_49k.json")
    df = df.drop("decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DECODE_IDS, side="right")))
                part = b.slice(at, to - at)
                col = pa.array([bpe.decode(x.as_py() or []) for x in part.column("ids")], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, col], names=[*part.schema.names, "decoded"])
                at = to

    return df.mapInArrow(run, schema)


def coded(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """df with `ids` and `decoded` in one pass: a task needs one Python worker, not two."""
    path = path or tokenizer_path("word_bpe_49k.json")
    df = df.drop("ids", "decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            for at, texts in text_slices(b.column(text), CODE_BYTES):
                flat, lengths = bpe.encode(texts)
                back = pa.array([bpe.decode(x.tolist()) for x in np.split(flat, np.cumsum(lengths)[:-1])], pa.string())
                ids = lengths_to_list_array(flat.astype(np.int32), lengths, pa.int32())
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(texts)).columns, ids, back], names=[*b.schema.names, "ids", "decoded"])

    return df.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of `doc_id, text`.

    Encodes and decodes in one pass, so that ids and decoded texts need not travel back to the JVM.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            rows = []
            for ids in (x.tolist() for _, texts in text_slices(b.column(1)) for x in bpe.split(texts)):
                digests = (hashlib.sha256(x.encode()).hexdigest() for x in (bpe.id_text(ids), bpe.decode(ids)))
                rows.append((len(ids), *digests))
            n, a, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
