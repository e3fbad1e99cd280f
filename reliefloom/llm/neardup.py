"""Operator 2: near-duplicate documents by a Chosen-Path set similarity join.

Documents become sets of hashed word shingles. Equal sets are collapsed to one member first, so
groups of copies of any size cost one row each. The distinct sets then walk down independent trees:
in each tree a set follows one or two selected minwise tokens to child nodes, and a node's members
meet only if they share the tokens chosen on the whole path. Small nodes are compared exhaustively
on sketches of 128 minwise tokens (with a margin of six deviations), and likely pairs are confirmed
on full sets; larger nodes branch again.

A child that keeps half of its node or more is a dense group: minwise tokens no longer part its members,
say because they share a template. With at most EXHAUSTIVE members it is compared exhaustively on full
sets, in cells of two bounded blocks each, so that a set has a bounded number of copies; a cell gives a
spanning forest of its links, not all of them. If a larger one keeps nearly all, the links to a few hubs come
first, and only members that these leave apart from the group's main component meet the others in cells.
All other large ones are parted by their rare shingles, exactly: two sets at the threshold share one of the
rarest shingles of each, as many as the threshold lets differ. Members that share one of these form a
node, and nodes of the same members are one; they are compared like dense groups. Linked sets form components.

Recall: a pair at the threshold s survives a level of one choice with probability s, of two with
1-(1-s)^2. With two choices at the roots of five trees, then one and two by turns, a pair at 0.85 is
missed in about one case of a million, a closer pair less often. Dense groups of any size lose none.
Cost: texts by a template grow linearly, unless their own part is smaller than what the threshold lets differ, and
they don't link either: then shared shingles are among the rare ones, and the group is compared in cells.

Rows: a document without words has an empty set, links with nothing and is kept. Rows without
doc_id are left out of linking; they get a null component and null `kept`. Rows of equal doc_id and
different text are one document: their sets count as linked. Repeated rows are judged alike and cost no
more than one. A very long text is one set of all its shingles, held by one task at a time. Equal sizes
and similarities decide nothing: a component is named by its smallest doc_id. An empty table gives no
rows. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import distinct_words, parallelism, ragged_take, text_slices, whole_groups, written

SHINGLE = 5
TREES = 5
ROOT_CHOICES = 2
TOKENS = 32  # minwise tokens that paths choose from, 64 bits each
SKETCH = 128  # minwise tokens that sketches compare, 16 bits each
LEAF = 48  # nodes of at most so many sets are compared on sketches
DENSE = 0.5  # a child that keeps this share of its node is a dense group
TIGHT = 0.9  # and with this share, branching would not divide it
LEVELS = 40
EXHAUSTIVE = 4096  # dense groups of at most so many sets are compared without hubs
HUBS = 4
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000  # most of either in half a cell, on average
BROADCAST_IDS = 1_000_000  # 8 bytes each
STRIDE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Multipliers and offsets of the minwise functions, by rule from their numbers.
_FACTORS = _mixed(np.arange(1, SKETCH + 1, dtype=np.uint64) * STRIDE) | np.uint64(1)
_OFFSETS = _mixed(np.arange(1001, SKETCH + 1001, dtype=np.uint64) * STRIDE)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    offsets, word, words = distinct_words(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    real = np.array([bool(w) for w in words], bool)  # splitting leaves empty words at a text's ends
    out = []
    for a, b in zip(offsets, offsets[1:]):
        if a < b and not real[word[a]]:
            a += 1
        if a < b and not real[word[b - 1]]:
            b -= 1
        h = known[word[a:b]]
        n = min(width, len(h))
        if not n:
            out.append(h)
            continue
        s = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            s = s * STRIDE + h[k : len(h) - n + 1 + k]
        out.append(np.unique(_mixed(s)))
    return out


def minwise(s: np.ndarray) -> np.ndarray:
    """The smallest value of each minwise function over a set."""
    low = np.full(SKETCH, ~np.uint64(0))
    for at in range(0, len(s), 1024):
        part = s[at : at + 1024, None]
        low = np.minimum(low, (part * _FACTORS + _OFFSETS).min(axis=0))
    return low


def _root_nodes(low: np.ndarray) -> np.ndarray:
    at = np.arange(TREES * ROOT_CHOICES)
    return _mixed(low[at % TOKENS] + (at.astype(np.uint64) + np.uint64(1)) * STRIDE).view(np.int64)


def _features(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in text_slices(b.column(1)):
                rows = []
                for s in shingle_sets(texts, width):
                    low = minwise(s)
                    key = _set_key(s)
                    sketch = ((low >> np.uint64(7)) & np.uint64(0xFFFF)).astype("<u2").tobytes()
                    rows.append((len(s), *key, _root_nodes(low).tolist(), low[:TOKENS].tobytes(), sketch))
                n, a, c, nodes, tokens, sketches = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(nodes, pa.list_(pa.int64())), pa.array(tokens, pa.binary()), pa.array(sketches, pa.binary())],
                    names=["doc_id", "n", "key1", "key2", "nodes", "tokens", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, key1 long, key2 long, nodes array<long>, tokens binary, sketch binary")


def _branched(rows: DataFrame, level: int) -> DataFrame:
    """Children of the members of large nodes: one or two selected tokens of each, by turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column("node").to_numpy().view(np.uint64)
            tokens = np.frombuffer(b"".join(b.column("tokens").to_pylist()), np.uint64).reshape(-1, TOKENS)
            children = []
            first = _mixed(node + np.array([level], np.uint64) * STRIDE)
            choices = 1 + (level % 2 == 0)
            for k in range(choices):
                pick = ((first + np.uint64(k * (TOKENS // 2 + 1))) % np.uint64(TOKENS)).astype(np.int64)
                children.append(_mixed(_mixed(node ^ tokens[np.arange(len(node)), pick]) + pick.astype(np.uint64) * STRIDE).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(children)), *(pa.array(np.tile(b.column(c).to_numpy(), choices)) for c in ("rep", "size"))], names=["node", "rep", "parent_size"])

    return rows.mapInArrow(run, "node long, rep long, parent_size long")


def _likely(sketches: list[bytes], least: float) -> tuple[np.ndarray, np.ndarray]:
    s = np.frombuffer(b"".join(sketches), "<u2").reshape(len(sketches), SKETCH)
    same = np.array([np.count_nonzero(s == row, axis=1) for row in s])
    return same, same >= least * SKETCH


def _spanning(i: np.ndarray, j: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Which pairs form a spanning forest, taken by weight."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    chosen = np.zeros(len(i), bool)
    for k in np.argsort(-weight, kind="stable"):
        a, b = find(int(i[k])), find(int(j[k]))
        if a != b:
            root[a], chosen[k] = b, True
    return chosen


def _leaf_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Candidate links inside small nodes: a, b, and whether the pair is of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "node"):
            node, rep = t.column("node").to_numpy(), t.column("rep").to_numpy()
            sketches = t.column("sketch").to_pylist()
            bounds = [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(node)]
            found = []
            for a, b in zip(bounds, bounds[1:]):
                if b - a < 2:
                    continue
                same, likely = _likely(sketches[a:b], least)
                i, j = np.nonzero(np.triu(likely, 1))
                apart = rep[a + i] != rep[a + j]
                i, j = i[apart], j[apart]
                if len(i):
                    x, y = rep[a + i], rep[a + j]
                    found.append((np.minimum(x, y), np.maximum(x, y), _spanning(i, j, same[i, j], b - a)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b", "first"])

    n = parallelism(rows.sparkSession)
    ready = rows.select("node", "rep", "sketch").repartition(n, "node").sortWithinPartitions("node")
    return ready.mapInArrow(run, "a long, b long, first boolean")


def _set_key(s: np.ndarray) -> list[int]:
    return np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, s: the full sets that `rep, doc, key1, key2` names, each by its rep, once each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in text_slices(b.column(1)):
                found = shingle_sets(texts, width)
                keys = np.array([_set_key(s) for s in found], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([s.tobytes() for s in found], pa.binary())], names=["d", "k1", "k2", "s"]
                )

    wanted = written(wanted, "named")
    n = wanted.count()
    few = n <= BROADCAST_IDS  # else texts and ids meet in a shuffle
    listed = F.broadcast(wanted) if few else wanted
    made = docs.join(listed, F.col("doc_id") == F.col("doc"), "left_semi").mapInArrow(sets, "d long, k1 long, k2 long, s binary")
    full = written(made.join(listed, (F.col("d") == F.col("doc")) & (F.col("k1") == F.col("key1")) & (F.col("k2") == F.col("key2"))).select(F.col("rep").alias("id"), "s"), "sets")
    if full.count() > n:  # rows of equal doc_id and text
        full = written(full.dropDuplicates(["id"]), "sets")
    return full


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("s").to_pylist(), b.column("t").to_pylist()):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one, other = full.withColumnRenamed("id", "a"), full.select(F.col("id").alias("b"), F.col("s").alias("t"))
    return pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "s", "t").mapInArrow(judge, "a long, b long").distinct()


def _cell_links(cells: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """a, b: a spanning forest of the links in each cell; `cell, rep, one`, of which a pair needs at least one `one`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "cell"):
            cell, reps, ones = (t.column(c).to_numpy() for c in ("cell", "rep", "one"))
            sets = t.column("s").to_pylist()
            bounds = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for lo, hi in zip(bounds, bounds[1:]):
                i, j = _linked([np.frombuffer(x, np.uint64) for x in sets[lo:hi]], ones[lo:hi], percent)
                i, j = i[reps[lo + i] != reps[lo + j]], j[reps[lo + i] != reps[lo + j]]
                if len(i):
                    keep = _spanning(i, j, np.zeros(len(i)), hi - lo)
                    x, y = reps[lo + i[keep]], reps[lo + j[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    n = parallelism(cells.sparkSession)
    ready = cells.join(full, F.col("rep") == F.col("id")).select("cell", "rep", "one", "s").repartition(n, "cell").sortWithinPartitions("cell")
    return ready.mapInArrow(run, "a long, b long").distinct()


def _linked(sets: list[np.ndarray], ones: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of sets, i < j: intersection sizes are counted over the sets that hold each shingle."""
    sizes = np.array([len(s) for s in sets])
    shingles, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    holders = owner[np.argsort(code, kind="stable")]
    times = np.bincount(code, minlength=len(shingles))
    starts = np.cumsum(sizes) - sizes
    left, right = [], []
    for i in range(len(sets)):
        shared, _ = ragged_take(holders, times, code[starts[i] : starts[i] + sizes[i]])
        both = np.bincount(shared, minlength=len(sets))
        ok = 100 * both >= percent * (sizes[i] + sizes - both)
        ok[: i + 1] = False
        if not ones[i]:
            ok &= ones
        j = np.flatnonzero(ok)
        left.append(np.full(len(j), i))
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def components(edges: DataFrame) -> DataFrame:
    """v, comp: the smallest vertex that each vertex of `a, b` reaches.

    Each round takes the smallest label among neighbours, then jumps to that label's own label, so
    the rounds grow with the logarithm of a chain's length.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("a") == F.col("v")).groupBy(F.col("b").alias("v")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "v").select("v", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("comp").alias("far"))
        new = written(low.join(jump, "low").select("v", F.least("low", "far").alias("comp"), (F.least("low", "far") != F.col("comp")).alias("moved")), "labels")
        labels = new.select("v", "comp")
        if new.filter("moved").isEmpty():
            return labels


def _dense_links(dense: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links inside dense groups: `node, rep, n` with the group's `size`."""
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES))
    few = dense.filter(F.col("size") <= EXHAUSTIVE)
    sums = few.groupBy("node").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    each = few.join(sums, "node").select("rep", "node", F.pmod(F.xxhash64("rep"), blocks).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("k"))
    cells = each.select(F.xxhash64("node", F.least("i", "k"), F.greatest("i", "k")).alias("cell"), "rep", F.lit(True).alias("one"))
    many = dense.filter(F.col("size") > EXHAUSTIVE)
    if many.isEmpty():
        return _cell_links(written(cells, "cells"), full, percent)
    hubs = many.groupBy("node").agg(*(F.min_by("rep", F.xxhash64("rep", F.lit(h))).alias(f"h{h}") for h in range(HUBS)))
    to_hubs = many.join(hubs, "node").select("rep", F.explode(F.array(*(f"h{h}" for h in range(HUBS)))).alias("hub")).filter("rep != hub")
    links = written(_confirmed(to_hubs.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), full, percent), "links")
    comp = components(links)
    member = written(many.join(comp, F.col("rep") == F.col("v"), "left").select("node", "rep", "n", F.coalesce("comp", "rep").alias("comp")), "members")
    parts = member.groupBy("node", "comp").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    main = parts.groupBy("node").agg(F.max_by("comp", "sets").alias("main"), *(F.sum(c).alias(c) for c in ("sets", "shingles")), *((F.sum(c) - F.max_by(c, "sets")).alias(f"{c}_apart") for c in ("sets", "shingles")))
    # every member apart from its group's main component meets all members, block by block
    mine_blocks = F.ceil(F.greatest(F.col("sets_apart") / BLOCK_SETS, F.col("shingles_apart") / BLOCK_SHINGLES))
    dealt = member.join(main, "node").filter("sets_apart > 0").select("node", "rep", (F.col("comp") != F.col("main")).alias("one"), mine_blocks.alias("ones"), blocks.alias("others"))
    hashed = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = dealt.filter("one").select("rep", "one", "node", hashed("ones").alias("i"), upto("others").alias("j"))
    rest = dealt.filter("NOT one").select("rep", "one", "node", upto("ones").alias("i"), hashed("others").alias("j"))
    apart = dealt.filter("one").select("rep", "one", "node", upto("ones").alias("i"), hashed("others").alias("j"))  # as one of all
    met = mine.unionByName(rest).unionByName(apart).select(F.xxhash64("node", "i", "j", F.lit(1)).alias("cell"), "rep", "one")
    return links.union(_cell_links(written(cells.unionByName(met), "cells"), full, percent))


def _rare_nodes(full: DataFrame, percent: int) -> DataFrame:
    """node, rep, n, size: sets of `id, s` that share one of their rarest shingles, as many of each as a linked set may lack and one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(1).to_pylist()
            n = np.array([len(s) // 8 for s in held], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(np.frombuffer(b"".join(held), np.int64))], names=["rep", "n", "shingle"])

    each = full.select("id", "s").mapInArrow(run, "rep long, n long, shingle long")
    held = each.groupBy("shingle").agg(F.count("*").alias("held")).filter("held > 1")
    w = Window.partitionBy("rep")
    shared = each.join(held, "shingle").withColumns({"at": F.row_number().over(w.orderBy("held", "shingle")), "shared": F.count("*").over(w)})
    # shingles that no other set has come first
    rare = written(shared.filter(F.col("n") - F.col("shared") + F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("shingle", "rep", "n"), "rare-shingles")
    lists = rare.groupBy("shingle").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).filter("size > 1")
    nodes = lists.groupBy("size", "x", "y").agg(F.min("shingle").alias("shingle")).select("shingle", "size")
    return rare.join(nodes, "shingle").select(F.col("shingle").alias("node"), "rep", "n", "size")


def near_duplicates(df: DataFrame, percent: int = 85, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of `doc_id, text`; sets link at 100 * |A & B| >= percent * |A | B|."""
    docs = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    margin = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / SKETCH) ** 0.5
    table = written(_features(docs, width), "sketches")
    # one member for each distinct set, by a number of its own; its text is that of its smallest doc_id
    real = table.filter("n > 0 AND doc_id IS NOT NULL")
    first = F.min_by(F.struct("n", "nodes", "tokens", "sketch"), "doc_id").alias("f")
    reps = real.groupBy("key1", "key2").agg(F.min("doc_id").alias("doc"), first).select("key1", "key2", "doc", "f.*")
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "members")
    sets = reps.select("rep", "doc", "key1", "key2")

    rows = reps.select("rep", F.explode("nodes").alias("node")).withColumn("parent_size", F.lit(None).cast("long"))
    leaves, dense, wide = [], [], []
    for level in range(1, LEVELS + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        sized = written(rows.join(sizes, "node"), "nodes")
        leaves.append(sized.filter(F.col("size") <= LEAF).select("node", "rep"))
        large = sized.filter(F.col("size") > LEAF)
        share = F.coalesce(F.col("size") / F.col("parent_size"), F.lit(0.0))
        large = large.withColumn("dense", share >= DENSE)
        stuck = F.col("dense") & ((F.col("size") <= EXHAUSTIVE) | (share >= TIGHT)) if level < LEVELS else F.lit(True)
        dense.append(large.filter(stuck).select("node", "rep", "size"))
        wide.append(large.filter(F.col("dense") & ~stuck).select("rep"))
        large = large.filter(~F.col("dense") & ~stuck)
        if large.isEmpty():
            break
        rows = _branched(large.join(reps.select("rep", "tokens"), "rep"), level)

    members = leaves[0]
    for x in leaves[1:]:
        members = members.union(x)
    found = _leaf_pairs(members.join(reps.select("rep", "sketch"), "rep"), margin)
    stuck_rows, wide_rows = dense[0], wide[0]
    for x, y in zip(dense[1:], wide[1:]):
        stuck_rows, wide_rows = stuck_rows.union(x), wide_rows.union(y)
    wide_rows = written(wide_rows.distinct(), "wide")
    pairs = written(found.groupBy("a", "b").agg(F.max("first").alias("first")), "candidates")
    dense_rows = written(stuck_rows.join(reps.select("rep", "n"), "rep"), "dense")
    named = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(dense_rows.select("rep")).union(wide_rows)
    full = _full_sets(docs, sets.join(named.distinct(), F.col("rep") == F.col("id"), "left_semi"), width)  # the second and last pass over texts
    if not wide_rows.isEmpty():
        rare = _rare_nodes(full.join(wide_rows, F.col("id") == F.col("rep"), "left_semi"), percent)
        dense_rows = written(dense_rows.select("node", "rep", "n", "size").union(rare), "dense")
    # forests first; other candidates only where confirmed forests leave their ends apart
    sure = _confirmed(pairs.filter("first"), full, percent)
    if not dense_rows.isEmpty():
        sure = sure.union(_dense_links(dense_rows, full, percent))
    # rows with their sets; those of equal doc_id are one document
    by_key = sets.select("rep", "doc", F.col("key1").alias("k1"), F.col("key2").alias("k2"))
    judged = written(table.select("doc_id", "n", "key1", "key2").join(by_key, (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")), "left").select("doc_id", "n", "rep", "doc"), "judged")
    several = judged.filter("doc_id IS NOT NULL AND rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a < last").select(F.col("doc_id").alias("of"), "a")
    one_id = judged.join(several, F.col("doc_id") == F.col("of")).filter("rep != a").select("a", F.col("rep").alias("b")).distinct()
    sure = written(sure.union(one_id), "links")
    comp = components(sure)
    x, y = comp.select(F.col("v").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("v").alias("b"), F.col("comp").alias("cb"))
    apart = written(pairs.filter("NOT first").join(x, "a", "left").join(y, "b", "left").filter("coalesce(ca, a) != coalesce(cb, b)").select("a", "b"), "apart")
    if not apart.isEmpty():
        comp = components(sure.union(_confirmed(apart, full, percent)))

    least = comp.join(sets.select("rep", "doc"), F.col("v") == F.col("rep")).groupBy("comp").agg(F.min("doc").alias("least"))
    named = comp.join(least, "comp").select("v", "least")
    out = judged.join(named, F.col("rep") == F.col("v"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("least", "doc")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
