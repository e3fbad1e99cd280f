"""Operator 9: token-ID output in a Simple-8b coded block file.

A 64-bit word holds a 4-bit selector in its top bits and 60 bits of payload: as many ids of equal
width as fit. A value of 60 bits or more is an escape: selector 15, then the value in a word of its
own. Ids are coded in blocks; a payload lists where each block's words begin, so that a reader can
decode any block alone, and each block with a few array operations.

The files are Parquet rows (`part, chunk, doc_ids, n_tokens, n_ids, payload`): a chunk is a run of
whole documents in ascending doc_id order. Parquet gives atomic commits on any file system that
Spark can reach.

Rows: null text counts as empty and has the end id only; documents without doc_id come first;
documents of equal doc_id are ordered by text; repeated rows are each written. A very long text is
coded whole, in one piece of a task's memory, and may fill more than one chunk's worth of ids; a chunk
never splits a document. Columns other than doc_id and text are ignored, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import distinct_words, parallelism, shared_dir, sums_by_list, text_slices, tokenizer_path

#: Ids per word and bits per id, by selector 1 to 14.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64], np.int64)
ESCAPE = 15
BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 20
MAGIC = b"S8B1"
END_ID = 2
#: Words kept with their ids in each Python worker, the earliest ones; others are encoded in each slice anew.
MEMO_WORDS = 2_000_000
#: Bytes of text that are cut into words at a time.
SLICE_BYTES = 4 << 20


def _needs(ids: np.ndarray) -> np.ndarray:
    """The first selector whose width holds each id."""
    out = np.ones(len(ids), np.uint8)
    for bits in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30):
        out += (ids >> np.uint64(bits)) > 0
    return out + (ids >> np.uint64(60) > 0)


#: The same, for ids of 16 bits.
SHORT_NEEDS = _needs(np.arange(1 << 16, dtype=np.uint64))


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of one block of unsigned ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([ids, np.zeros(60, ids.dtype)])
    need = SHORT_NEEDS[padded] if padded.dtype == np.uint16 else _needs(padded.astype(np.uint64))
    padded = padded.astype(np.uint64)
    # widest[i] is the largest need among the values that a word beginning at i holds so far
    widest, selector, seen = need, need[:n].copy(), 1
    selector[selector < 14] = 14
    for s in range(13, 0, -1):
        count = int(COUNTS[s])
        while seen < count:
            step = min(seen, count - seen)
            widest = np.maximum(widest[: len(widest) - step], widest[step:])
            seen += step
        fits = widest[:n] <= s
        if not fits.any():
            break  # a word of more, narrower ids can't fit either
        selector[fits] = s
    hop = COUNTS[selector].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += hop[at]
    begin = np.array(starts)
    chosen = selector[begin].astype(np.int64)
    width = np.where(chosen == ESCAPE, 2, 1)
    place = np.concatenate([[0], np.cumsum(width)])
    words = np.zeros(place[-1], np.uint64)
    words[place[:-1]] = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[place[rows] + 1] = padded[begin[rows]]
            continue
        first, word = begin[rows], np.uint64(int(s) << 60)
        for k in range(int(COUNTS[s])):
            word = word | padded[first + k] << np.uint64(k * int(BITS[s]))
        words[place[rows]] = word
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of a block's words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == ESCAPE).any():  # a raw word may look like any selector: walk past each
        real, at = [], 0
        listed = selector.tolist()
        while at < len(listed):
            real.append(at)
            at += 2 if listed[at] == ESCAPE else 1
        place = np.array(real)
    else:
        place = np.arange(len(words))
    chosen = selector[place]
    begin = np.concatenate([[0], np.cumsum(COUNTS[chosen])])
    out = np.zeros(begin[-1], np.uint64)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[begin[rows]] = words[place[rows] + 1]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            out[begin[rows] + k] = (words[place[rows]] >> np.uint64(k * int(BITS[s]))) & mask
    return out[:n]


def pack_blocks(ids: np.ndarray) -> bytes:
    """Payload: magic, ids per block, number of ids, word offset of each block, words."""
    blocks = [pack(ids[i : i + BLOCK_IDS]) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0, *(len(b) for b in blocks)]).astype("<u8")
    head = np.array([BLOCK_IDS, len(ids)], "<u8").tobytes()
    return b"".join([MAGIC, b"\0\0\0\0", head, offsets.tobytes(), *(b.astype("<u8").tobytes() for b in blocks)])


def unpack_blocks(payload: bytes) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a token payload")
    per_block, n = (int(x) for x in np.frombuffer(payload, "<u8", 2, 8))
    blocks = -(-n // per_block)
    offsets = np.frombuffer(payload, "<u8", blocks + 1, 24)
    words = np.frombuffer(payload, "<u8", -1, 24 + 8 * (blocks + 1))
    parts = [unpack(words[int(a) : int(b)], min(per_block, n - i * per_block)) for i, (a, b) in enumerate(zip(offsets, offsets[1:]))]
    return np.concatenate([*parts, np.zeros(0, np.uint64)])


class Memo:
    """The ids of words by the words' 128-bit hashes: sorted arrays, about 30 bytes a word."""

    def __init__(self, width: np.dtype):
        self.high, self.low = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, width)

    @staticmethod
    def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in words]), np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for none."""
        if not len(self.high):
            return np.full(len(high), -1)
        order = np.argsort(high)
        at = np.empty(len(high), np.int64)
        at[order] = np.minimum(np.searchsorted(self.high, high[order]), len(self.high) - 1)
        return np.where((self.high[at] == high) & (self.low[at] == low), at, -1)

    def add(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Keep words that were not found, as far as there is room."""
        n = min(len(high), MEMO_WORDS - len(self.high))
        if n <= 0:
            return
        lengths = lengths[:n]
        starts = np.cumsum(lengths) - lengths + len(self.flat)
        self.flat = np.concatenate([self.flat, ids[: int(lengths.sum())]])
        own = np.argsort(high[:n])
        high, low, starts, lengths = high[:n][own], low[:n][own], starts[own], lengths[own]
        merged = np.argsort(np.concatenate([self.high, high]), kind="stable")  # two sorted runs
        self.high, self.low = np.concatenate([self.high, high])[merged], np.concatenate([self.low, low])[merged]
        self.start, self.length = np.concatenate([self.start, starts])[merged], np.concatenate([self.length, lengths]).astype(np.int32)[merged]


class ByteEncoder:
    """The tokenizers library behind a memo of words.

    Texts are cut before each space and each line feed. The vocabulary's pre-tokenizer joins white space
    in two ways only: a space to the word after it, and a run of white space to all of its characters but
    the last (all of them at the end of a text). So the cut pieces can be encoded one by one, but for
    texts with runs of three or more, with runs of two at the end, or with other white space; these are
    encoded whole, as are texts that might hold special tokens.
    """

    #: White space other than the space and the line feed.
    RARE_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    RUN = 100  # new words that go to the library as one text, a line feed after each

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        top = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = np.dtype(np.uint16 if top <= 1 << 16 else np.uint32)
        (self.feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        (self.space,) = self.tokenizer.encode(" ", add_special_tokens=False).ids
        self.memo = Memo(self.width)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.width) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that hold no white space, each led by `lead`, end to end, and the number of ids of each; an empty word has none."""
        real = np.array([bool(w) for w in words], bool)
        spelt = [w for w in words if w]
        runs = ["".join([f"{lead}{w}\n" for w in spelt[i : i + self.RUN]]) for i in range(0, len(spelt), self.RUN)]
        ids = np.concatenate([*self._library(runs), np.zeros(0, self.width)])
        ends = np.flatnonzero(ids == self.feed)
        lengths = np.zeros(len(words), np.int64)
        lengths[real] = np.diff(ends, prepend=-1) - 1
        return np.delete(ids, ends), lengths

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin with a line feed, or else have lost the space that led them."""
        fed = np.array([p[:1] == "\n" for p in pieces], bool)
        one, n_one = self._words([p for p, f in zip(pieces, fed) if not f], " ")
        two, n_two = self._words([p[1:] for p, f in zip(pieces, fed) if f], "")
        lengths = np.zeros(len(pieces), np.int64)
        lengths[~fed], lengths[fed] = n_one, n_two + 1
        out, owner = np.full(int(lengths.sum()), self.feed, self.width), np.repeat(fed, lengths)
        out[~owner] = one
        owner[(np.cumsum(lengths) - lengths)[fed]] = False
        out[owner] = two
        return out, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and the number of ids of each."""
        offsets, word, words = distinct_words(pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " "))
        first = offsets[:-1]  # nothing leads the first pieces
        odd = np.zeros(len(words), bool)
        every = " ".join(words)
        if "<|" in every or self.RARE_SPACE.search(every):
            odd = np.array(["<|" in w or self.RARE_SPACE.search(w) is not None for w in words])
        del every
        single = np.array([w == "" or w == "\n" for w in words])[word]
        single[first] = False
        broken = odd[word]
        broken[:-1] |= single[:-1] & single[1:]
        whole = np.flatnonzero(sums_by_list(broken, offsets))

        high, low = Memo.keys(words)
        found = self.memo.find(high, low)
        new = np.flatnonzero(found < 0)
        new_ids, new_lengths = self._pieces([words[i] if not odd[i] else "" for i in new])
        blank = np.array([words[i] == "" for i in new], bool)  # a space that stands before white space
        new_ids, new_lengths = np.insert(new_ids, (np.cumsum(new_lengths) - new_lengths)[blank], self.space), new_lengths + blank
        firsts, which = np.unique(word[first], return_inverse=True)
        led, n_led = self._words([words[i] if not odd[i] and words[i][:1] != "\n" else "" for i in firsts], "")
        alone = self._library([texts[int(i)].as_py() for i in whole])
        # the ids of all pieces: of the memo, then new ones, first ones and whole texts
        pool = np.concatenate([self.memo.flat, new_ids, led, *alone])
        n_more = np.concatenate([new_lengths, n_led, np.array([len(x) for x in alone], np.int64)])
        more = len(self.memo.flat) + np.cumsum(n_more) - n_more
        starts, lengths = np.zeros(len(words) + len(firsts) + len(whole), np.int64), np.zeros(len(words) + len(firsts) + len(whole), np.int64)
        old = np.flatnonzero(found >= 0)
        starts[old], lengths[old] = self.memo.start[found[old]], self.memo.length[found[old]]
        rows = np.concatenate([new, np.arange(len(words), len(starts))])
        starts[rows], lengths[rows] = more, n_more
        number = word.astype(np.int64)
        number[first] = len(words) + which
        keep = np.ones(len(word), bool)
        for i in whole:
            keep[offsets[i] : offsets[i + 1]] = False
        keep[first[whole]] = True
        number[first[whole]] = len(words) + len(firsts) + np.arange(len(whole))
        taken = lengths[number] * keep
        shift = starts[number] - (np.cumsum(taken) - taken)
        ids = pool[np.repeat(shift, taken) + np.arange(int(taken.sum()))]
        plain = ~odd[new]
        self.memo.add(high[new[plain]], low[new[plain]], new_ids if plain.all() else new_ids[np.repeat(plain, new_lengths)], new_lengths[plain])
        return ids, sums_by_list(taken, offsets)


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of every `doc_id, text`, each with the end id, in ascending doc_id order."""
    tokenizer = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, chunk = loaded(tokenizer), TaskContext.get().partitionId(), 0
        docs_in: list[pa.Array] = []
        lengths_in: list[np.ndarray] = []
        ids_in: list[np.ndarray] = []
        held = 0

        def row() -> pa.RecordBatch:
            keys, lengths = pa.concat_arrays(docs_in), np.concatenate(lengths_in)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), one(keys), one(pa.array(lengths, pa.int64())), pa.array([held], pa.int64()), pa.array([pack_blocks(np.concatenate(ids_in))], pa.binary())],
                names=["part", "chunk", "doc_ids", "n_tokens", "n_ids", "payload"],
            )

        for b in batches:
            for at, texts in text_slices(b.column(1), SLICE_BYTES):
                flat, lengths = encoder.encode(texts)
                ends = np.cumsum(lengths)
                flat, lengths, ends = np.insert(flat, ends, end_id), lengths + 1, ends + np.arange(1, len(lengths) + 1)
                keys, done = b.column(0).slice(at, len(texts)), 0
                while done < len(lengths):  # whole documents, up to the one that fills the chunk
                    before = int(ends[done - 1]) if done else 0
                    to = min(len(lengths), int(np.searchsorted(ends, before + CHUNK_IDS - held)) + 1)
                    docs_in.append(keys.slice(done, to - done))
                    lengths_in.append(lengths[done:to])
                    ids_in.append(flat[before : int(ends[to - 1])])
                    held, done = held + int(ends[to - 1]) - before, to
                    if held >= CHUNK_IDS:
                        yield row()
                        docs_in, lengths_in, ids_in, held, chunk = [], [], [], 0, chunk + 1
        if docs_in:
            yield row()

    n = parallelism(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, "part int, chunk int, doc_ids array<long>, n_tokens array<long>, n_ids long, payload binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Read such files: doc_id, start, n_tokens, ids_crc32, and `ids array<long>` if asked for."""
    table = spark.read.parquet(path)
    # a row for each written partition, then for each chunk: no text and no ids
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("size"))
    parts = parts.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    chunks = table.select("part", "chunk", "n_ids").withColumn("chunk_start", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = chunks.join(F.broadcast(parts), "part").select("part", "chunk", (F.col("part_start") + F.col("chunk_start")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                flat, lengths = unpack_blocks(x["payload"]), np.array(x["n_tokens"], np.int64)
                ends = np.cumsum(lengths)
                raw = flat.astype("<u4")
                crc = [zlib.crc32(raw[e - n : e]) for e, n in zip(ends, lengths)]
                cols = [pa.array([x["part"]] * len(ends), pa.int32()), pa.array([x["chunk"]] * len(ends), pa.int32()), pa.array(x["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                if ids:
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=["part", "chunk", "doc_id", "offset", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    schema = "part int, chunk int, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    docs = table.select("part", "chunk", "doc_ids", "n_tokens", "payload").mapInArrow(run, schema)
    out = docs.join(starts, ["part", "chunk"])
    return out.select("doc_id", (F.col("at") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def token_file(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    import uuid

    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
