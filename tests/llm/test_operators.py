import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from reliefloom.llm import bpe, decontaminate, langid, lattice, linededup, neardup, queries, sharding, tokenfile, topk, urlfilter
from reliefloom.llm.common import tokenizer_path

from . import brute

LONG = "word" * 5000 + " " + "tail " * 3000
ODD = [
    (1, "The cat sat on the mat today, and it purred.\nA shared line of some length\nx"), (2, "the CAT sat on the mat today, and it purred.\n  a shared LINE of some length\t\ny"), (3, None), (4, ""),
    (5, "A shared line of some length"), (5, "A shared line of some length"), (6, "one two"), (7, "ONE two"), (8, LONG), (9, " \t\n \n  !!! 123"), (None, "A shared line of some length"), (10, "Straße \x1c naïve ﷺ <|endoftext|> İ  x  é\n日本語"),
]


def docs(spark, rows=ODD):
    """A table with more columns than asked for, some of them named like results."""
    return spark.createDataFrame([(i, t, "en", "src", 0, -1, "?") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, kept string")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(a, b):
    return sorted(a, key=lambda r: tuple((x is None, str(x)) for x in r)) == sorted(b, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_bpe_equals_the_library(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    table = docs(spark)
    got = rows(bpe.round_trip_digests(table), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for doc, text in ODD:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False))))
    assert same(got, want)
    full = bpe.decoded(bpe.encoded(table))
    assert set(table.columns) < set(full.columns)
    assert same([(r.doc_id, len(r.ids), brute.sha(" ".join(map(str, r.ids))), brute.sha(r.decoded)) for r in full.collect()], want)
    assert bpe.round_trip_digests(docs(spark, [])).count() == 0


def test_long_words_merge_like_short_ones():
    b = bpe.loaded(tokenizer_path("word_bpe_49k.json"))
    rng = np.random.default_rng(1)
    for n in (50, 150, 199):
        ids = [b.vocab[c] for c in rng.choice(list("abcdeinorst"), n)]
        assert b.merges.apply(list(ids)) == b.merges._apply_long(list(ids))


def test_near_duplicates(spark, sf):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(60)]
    group = [(100 + i, " ".join("z%d" % i if j in rng.choice(60, i % 3, replace=False) else x for j, x in enumerate(base))) for i in range(130)]
    copies = [(300 + i, "exact copies of one short text here") for i in range(40)]
    kept = [(i, t) for i, t in ODD if i not in (None, 5)] + [(5, "A shared line of some length")] + group + copies
    got = rows(neardup.near_duplicates(docs(spark, kept)), "doc_id", "n_shingles", "component_id", "kept")
    assert same(got, brute.near_duplicates(kept))
    odd = neardup.near_duplicates(docs(spark)).collect()
    assert [r.component_id for r in odd if r.doc_id is None] == [None] and {r.component_id for r in odd if r.doc_id == 5} == {5}
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_dense_groups_beyond_the_exhaustive_size(spark, monkeypatch):
    monkeypatch.setattr(neardup, "EXHAUSTIVE", 20)
    monkeypatch.setattr(neardup, "LEAF", 8)
    monkeypatch.setattr(neardup, "BLOCK_SETS", 16)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows_ = [(i, " ".join(f"z{i}" if j in rng.choice(120, i % 4, replace=False) else x for j, x in enumerate(base))) for i in range(90)]
    got = rows(neardup.near_duplicates(docs(spark, rows_)), "doc_id", "n_shingles", "component_id", "kept")
    assert same(got, brute.near_duplicates(rows_))


def oracle(name, sf, order=True):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    r = c.execute(queries.ORACLE_SQL[name])
    return [x[0] for x in r.description], r.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    columns, want = oracle(name, sf)
    assert same(rows(queries.QUERIES[name](spark, sf), *columns), want)


@pytest.mark.parametrize("most", [1 << 23, 64, 0])
def test_url_filter_edges(spark, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "MOST_BITS", most)
    urls = [(1, None), (2, "no scheme"), (3, "http://Sub.EXAMPLE.com/en/x?y"), (4, "https://www.example.com/en/"), (5, "http://example.com"), (6, "ftp://a.net/es/#"), (7, "http://net/fr/"), (7, "http://net/fr/"), (8, "http://notexample.com/en/"), (None, "x://fakenet/es/"), (9, "://"), (10, "http://" + "a." * 3000 + "com/" + "p" * 50_000)]
    table = spark.createDataFrame([(i, u, "", "?") for i, u in urls], "page_id long, url string, html string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judged(table, queries.URL_RULES).collect()}
    assert got == {1: (None, "allow"), 2: (None, "allow"), 3: ("example.com/en/", "block"), 4: ("www.example.com/en/", "allow"), 5: (None, "allow"), 6: ("net/es/", "block"), 7: ("net/fr/", "block"), 8: ("com/", "allow"), None: (None, "allow"), 9: (None, "allow"), 10: ("com/", "allow")}
    assert urlfilter.judged(table.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in urlfilter.judged(table, []).collect()} == {"allow"}


def test_cascade_is_exact_with_tiny_filters(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 1)
    monkeypatch.setattr(urlfilter, "HASHES", 1)
    keys = [f"host{i}.org/" for i in range(400)]
    c = urlfilter.Cascade().build(spark.createDataFrame([(k,) for k in keys[:60]], "key string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    assert len(c.levels) > 2
    from pyspark.sql import functions as F

    got = {r.key for r in spark.createDataFrame([(k,) for k in keys], "key string").filter(c.holds(F.col("key"))).collect()}
    assert got == set(keys[:60])


def test_line_dedup_edges(spark):
    got = rows(linededup.line_digests(docs(spark)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    want = [(d, len(a), len(a) - len(k), brute.sha("\n".join(k))) for d, a, k in brute.without_repeated_lines(ODD)]
    assert same(got, want)
    table = docs(spark)
    out = linededup.without_repeats(table)
    assert out.columns == table.columns
    assert same([(r.doc_id, brute.sha(r.text or "")) for r in out.collect()], [(d, brute.sha("\n".join(k))) for d, _, k in brute.without_repeated_lines(ODD)])
    assert linededup.line_digests(docs(spark, [])).count() == 0


def test_top_k_edges(spark):
    v = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (50, [-1.0, 0.1]), (100, [1.0]), (101, [2.0]), (102, []), (None, [1.0, 1.0]), (7, [3e30, -3e30]), (2, [0.5, 0.5])]
    table = spark.createDataFrame([(i, x, 0, 9) for i, x in v], "vec_id long, embedding array<float>, label int, score int")
    got = rows(topk.top_scores(table), "query_id", "rank", "vec_id", "score")
    clean = [(i, [math.floor(256 * float(np.float32(a))) for a in x]) for i, x in v if i is not None and x is not None and all(a is not None and math.isfinite(a) for a in x)]
    want = []
    for q, x in {(i, tuple(x)) for i, x in clean if i % 50 == 0}:
        s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), i) for i, y in clean if i != q and len(y) == len(x))
        want += [(q, r + 1, i, -k) for r, (k, i) in enumerate(s[:5])]
    assert same(got, want)
    assert topk.top_scores(table.limit(0)).count() == 0


def test_bounds_never_lose_a_candidate():
    rng = np.random.default_rng(4)
    q, x = np.floor(rng.normal(0, 40, (30, 37))), np.floor(rng.normal(0, 40, (500, 37)))
    turn = topk.basis_of(x[:100])
    assert np.allclose((q @ turn) @ (x @ turn).T, q @ x.T)
    for s in topk.resolutions(37):
        assert (topk._statistics(q, s) @ topk._statistics(x, s).T + 1e-6 >= q @ x.T).all()
    best = topk.search_block(np.arange(30), q, [(np.arange(100, 350), x[:250]), (np.arange(350, 600), x[250:])], 5)
    for i in range(30):
        want = sorted((-s, n) for n, s in enumerate((q @ x.T)[i], 100))[:5]
        assert [(-s, n) for s, n in zip(best.scores[best.rows == i], best.ids[best.rows == i])] == want
    seeded = topk.search_block(np.arange(30), q, [(np.arange(100, 600), x)], 5, best.least, turn)
    assert (seeded.rows == best.rows).all() and (seeded.scores == best.scores).all() and (seeded.ids == best.ids).all()
    assert seeded.exact < 30 * 500


ITEMS = [(1, "purred a shared line"), (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "ONE two"), (None, "the cat"), (3, None), (4, "!!!"), (11, "tail " * 20)]
MORE = [*ODD, (20, "so one TWO three four five six seven eight nine ten eleven twelve thirteen, and more " + "pad " * 30), (21, "two three four five six seven eight nine ten eleven twelve thirteen fourteen one")]


@pytest.mark.parametrize("most", [100_000, 0])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = rows(decontaminate.judged(docs(spark, MORE), bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert same(got, brute.contamination(MORE, [x for x in ITEMS if x[0] is not None]))
    assert not any(r.contaminated for r in decontaminate.judged(docs(spark), bench.limit(0)).collect())
    assert decontaminate.judged(docs(spark, []), bench).count() == 0


def test_language_id(spark, sf):
    got = queries.op7_language_id(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    odd = {(r.doc_id, r.lang_pred, r.held_out) for r in langid.predictions(docs(spark)).collect()}
    assert {(3, "und"), (4, "und"), (9, "und"), (1, "en"), (None, "en")} <= {(a, b) for a, b, _ in odd}
    assert {r.lang_pred for r in langid.predictions(docs(spark).withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.predictions(docs(spark, [])).count() == 0


def test_language_id_equals_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in table.collect()}
    learn = [(r.text, r.lang) for i, r in rows.items() if r.text is not None and r.lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    want = brute.languages(learn, {i: r.text for i, r in rows.items()}, langid.codewords(len({lang for _, lang in learn})).tolist())
    got = {r.doc_id: r for r in langid.predictions(table).collect()}
    assert set(got) == set(want)
    for i, (lang, score, apart) in want.items():
        assert abs(got[i].score - score) < 1e-3 and got[i].ambiguous == (lang != "und" and apart < 0.02)
        assert got[i].lang_pred == lang or apart < 1e-3


def test_language_id_of_equal_evidence_is_flagged(spark):
    """Two languages of the same words: each text is a tie, which the first by name takes."""
    ids = [i for i in range(80) if zlib.crc32(str(i).encode()) % 4 != 2][:40]
    table = spark.createDataFrame([(i, "same words here", ("xx", "aa")[k % 2], "a", 1) for k, i in enumerate(ids)], "doc_id long, text string, lang string, source string, n_chars long")
    got = langid.predictions(table).collect()
    assert {(r.lang_pred, r.score, r.ambiguous) for r in got} == {("aa", 0.5, True)}


def test_codewords_are_distinct_and_useful():
    for n in (2, 3, 4, 5, 9, 30):
        c = langid.codewords(n)
        assert len({tuple(x) for x in c}) == n and (c.any(axis=0) & ~c.all(axis=0)).all()


def test_lattice_sums_all_segmentations():
    p = lattice.loaded(tokenizer_path("piece_bpe_32k.model"))
    log_p, number = np.log(p.start), {x: i for i, x in enumerate(p.pieces)}

    def total(raw):
        return 1.0 if not raw else sum(p.start[number[raw[:k]]] * total(raw[k:]) for k in range(1, len(raw) + 1) if raw[:k] in number)

    words = ["the", "of", "é", "x", "thing", "ab"]
    got = lattice.word_log_probs(p, words, log_p)
    assert np.allclose(got, [math.log(total(lattice.MARK + w.encode())) for w in words])
    counts = lattice.expected_counts(p, ["thing"], np.ones(1), log_p)
    spelled = sum(counts[i] * len(x) for i, x in enumerate(p.pieces))
    assert abs(spelled - len(lattice.MARK + b"thing")) < 1e-9


def test_lattice_has_every_piece_of_the_model_file():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    real = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
    listed = {bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode() for i in real}
    p = lattice.loaded(path)
    assert set(p.pieces) == listed | {bytes([b]) for b in range(256)}
    number = {x: i for i, x in enumerate(p.pieces)}
    log_p = np.log(p.start)
    words = ["infrastructure", "representations", "становника", "міністрадминистративный", "▁" * 16 + "x", "disappointments"]
    for word, got in zip(words, lattice.word_log_probs(p, words, log_p)):
        raw = lattice.MARK + word.encode()
        ways = [1.0] + [0.0] * len(raw)
        for j in range(1, len(raw) + 1):
            ways[j] = sum(ways[i] * p.start[number[raw[i:j]]] for i in range(j) if raw[i:j] in number)
        assert math.isclose(got, math.log(ways[-1]), rel_tol=1e-9)


def base_scores(rows_):
    train = Counter()
    for i, t in rows_:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*brute.SPACE.findall(brute.lower(t)), None])
    n, v = sum(train.values()), len(train)
    for i, t in rows_:
        words = [*brute.SPACE.findall(brute.lower(t)), None]
        yield i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(words), sum(train[w] > 0 for w in words), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words), 4)


@pytest.mark.parametrize("hot", [150_000, 3])
def test_lm_scores(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(lattice, "HOT_WORDS", hot)
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    table = [*ODD, *real]
    out = lattice.scored(docs(spark, table)).collect()
    assert same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out], list(base_scores(table)))
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert lattice.scored(docs(spark, [])).count() == 0


def test_word_probabilities_do_not_exceed_one(spark):
    table = [(i, "a b c a b a") for i in range(30)]
    out = lattice.scored(docs(spark, [*table, (99, "a"), (98, "b"), (97, "c"), (96, None)])).collect()
    score = {r.doc_id: r.score for r in out}
    assert sum(10 ** (score[i] - score[96]) for i in (97, 98, 99)) < 1  # of the words, once the end token is divided out


def test_token_file(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    table = [*ODD, (11, " a"), (12, "a "), (13, "a  b\n \nc"), (14, "x\n\ny \tz"), (15, "it's I'll")]
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(docs(spark, table), path)
    got = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in table), key=lambda i: (i is not None, i))
    at = 0
    texts = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids)) for i, x in table)
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
        texts[(r.doc_id, tuple(r.ids[:-1]))] -= 1
    assert not any(texts.values())
    tokenfile.write_tokens(docs(spark, []), str(tmp_path / "none"))
    assert tokenfile.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_byte_encoder_equals_the_library_on_runs_of_white_space(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = np.random.default_rng(7)
    parts = ["a", "b", "The", "é", "日", " ", " ", " ", "\n", "\n", "'s", ".", "1", "hello", "\t", "<|endoftext|>", "<|", "\n\n", "  ", "\x1c", "\u3000"]
    texts = ["".join(rng.choice(parts[:14] if i % 5 else parts, rng.integers(0, 25))) for i in range(3000)] + [LONG, "x" * 70_000, "\n" * 3, ""]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for most in (2_000_000, 50):
        monkeypatch.setattr(tokenfile, "MEMO_WORDS", most)
        encoder = tokenfile.ByteEncoder(path)
        got = []
        for at in range(0, len(texts), 500):  # later slices meet words of earlier ones
            ids, lengths = encoder.encode(pa.array(texts[at : at + 500]))
            got += [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
        assert got == want
        assert len(encoder.memo.high) <= most


def test_simple8b_round_trip():
    rng = np.random.default_rng(5)
    for a in ([], [0], [2**64 - 1], [15 << 60, 3, 2**60], rng.integers(0, 2, 1000), rng.integers(0, 50257, 70_000), np.where(rng.random(5000) < 0.01, 2**62, rng.integers(0, 40, 5000))):
        a = np.array(a, np.uint64)
        assert (tokenfile.unpack_blocks(tokenfile.pack_blocks(a)) == a).all()
    assert len(tokenfile.pack(np.zeros(120, np.uint64))) == 2


def test_sharding(spark, sf):
    table = [*ODD, *((1000 + i, "hot text " * 20) for i in range(400)), *((2000 + i, f"text {i} " * (i % 50)) for i in range(600))]
    out = sharding.placed(docs(spark, table)).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in table)
    sizes, slots = Counter(), {}
    for r in out:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    light = sum(sizes.values()) / 16
    longest = max(len((t or "").encode()) + 1 for _, t in table)
    assert max(sizes.values()) <= light + longest
    by = {i: t for i, t in table}
    assert all(r.size == len((by[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((by[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in out)
    assert sharding.placed(docs(spark, [])).count() == 0
    real = sharding.placed(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("shard").agg(sharding.F.sum("size").alias("s")).collect()
    assert max(r.s for r in real) < 1.1 * min(r.s for r in real)


def test_a_large_group_without_ids_is_cut(spark):
    """Equal rows without doc_id, or of one doc_id, fill many shards; each row has a slot of its own."""
    for same in (None, 7):
        out = sharding.placed(docs(spark, [(same, "one text of many rows")] * 3000 + [(i, f"text {i}") for i in range(500)])).collect()
        rows = Counter(r.shard for r in out)
        assert sum(rows.values()) == 3500 and len(rows) == 16 and max(rows.values()) < 1.25 * 3500 / 16
        assert len({(r.shard, r.slot) for r in out}) == 3500 and all(max(r.slot for r in out if r.shard == s) == n - 1 for s, n in rows.items())


def test_whole_groups_never_split_a_key():
    from reliefloom.llm.common import whole_groups

    keys = np.sort(np.random.default_rng(6).integers(0, 40, 500))
    t = pa.table({"k": pa.array(keys)})
    seen = [x.column("k").to_pylist() for x in whole_groups(t.to_batches(max_chunksize=7), "k")]
    assert sum(seen, []) == keys.tolist()
    assert all(not set(a) & set(b) for a, b in zip(seen, seen[1:]))


def test_near_duplicates_of_repeated_rows(spark):
    words = " ".join(f"w{i}" for i in range(40))
    table = [*((1, words) for _ in range(500)), *((2, words.replace("w39", "x")) for _ in range(500)), *((7, f"other text {i % 2} of the same id, " + " ".join(f"v{i % 2}{j}" for j in range(30))) for i in range(500)), (8, "other text 1 of the same id, " + " ".join(f"v1{j}" for j in range(30)))]
    out = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, table)).collect())
    assert out == {(1, 1, True): 500, (2, 1, False): 500, (7, 7, True): 500, (8, 7, False): 1}


def test_equal_ids_are_one_document(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    out = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, [(3, b), (5, a), (5, b), (9, a), (6, None), (6, "")])).collect()}
    assert out == {(3, 3, True), (5, 3, False), (9, 3, False), (6, 6, True)}


def test_templated_texts_part_again(spark, monkeypatch):
    """Texts of Jaccard 0.6 by their common template link only where their own parts are copies; a large group of them is parted by rare shingles and loses none."""
    monkeypatch.setattr(neardup, "EXHAUSTIVE", 100)
    template = " ".join(f"t{i}" for i in range(300))
    own = lambda i, k: " ".join(f"o{i}x{j}" for j in range(100 - k)) + "".join(f" e{i}y{j}" for j in range(k))
    table = [(i, f"{template} {own(i // 2, 4 * (i % 2))}") for i in range(600)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, table)).collect()}
    assert all(got[i] in (i, i - i % 2) for i in got)
    assert all(got[i] == i - 1 for i in range(1, 600, 2))


def test_line_runs_take_later_batches(spark):
    F = linededup.F
    rng = np.random.default_rng(8)
    seen = sorted({(int(rng.integers(0, 300)), int(rng.integers(0, 60))) for _ in range(2000)}, reverse=True)
    table = spark.createDataFrame(seen, "doc_id long, h1 long").withColumn("h2", -F.col("h1"))
    runs = linededup.LineRuns(spark, 40)
    for low, high in ((200, 300), (150, 199), (90, 149)):
        runs.add(table.filter(F.col("doc_id").between(low, high)))
    named = [n for level in runs.levels for n in level]
    for n in named:
        spark.sql(f"DROP TABLE {n}")  # as in the catalog of another session
    again = linededup.LineRuns.of(spark, runs.state())
    assert "Exchange" not in again._merged([spark.table(named[0])] * 2)._jdf.queryExecution().executedPlan().toString()
    again.add(table.filter("doc_id < 90"))
    assert sum(map(len, again.levels)) < 4  # merged
    holders = {}
    for doc, h in seen:
        holders.setdefault(h, set()).add(doc)
    got = {(r.h1, r.top) for r in again.repeated().collect()}
    assert got == {(h, max(d)) for h, d in holders.items() if len(d) >= 40}
    plan = again._merged([spark.table(n) for level in again.levels for n in level][:1] * 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_one_line_in_every_document(spark):
    table = [(i % 700, f"The same long line stands in every document.\nown line number {i} is long enough") for i in range(1400)]
    got = rows(linededup.line_digests(docs(spark, table)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert same(got, [(d, len(a), len(a) - len(k), brute.sha("\n".join(k))) for d, a, k in brute.without_repeated_lines(table)])


def test_groups_are_placed_by_the_dot_product(spark):
    """A brute-force placement of 1500 groups, none large enough to be cut or small enough for a bin."""
    import xxhash

    table = [(i, f"{i // 2} " + "word  " * (15 + i // 2 % 7) + "long" * (i // 2 % 5)) for i in range(3000)]
    groups = {}
    for _, t in table:
        load = np.array([len(t) + 1, len(t.split()), 1], float)
        groups[t] = groups.get(t, 0) + load
    total = sum(groups.values())
    signed = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)
    order = sorted(sorted(groups, key=signed), key=lambda t: -max(groups[t] / total))
    left, where = np.full((16, 3), 1 / 16), {}
    for t in order:
        where[t] = best = int(np.argmax(left @ (groups[t] / total)))
        left[best] -= groups[t] / total
    out = sharding.placed(docs(spark, table)).collect()
    text = dict(table)
    assert all(r.shard == where[text[r.doc_id]] for r in out) and len(out) == 3000


def test_long_words_are_summed_like_short_ones(monkeypatch):
    p = lattice.loaded(tokenizer_path("piece_bpe_32k.model"))
    log_p = np.log(p.start)
    words = ["infrastructure" * 9, "é日x" * 40, "thing"]
    want, counts = lattice.word_log_probs(p, words, log_p), lattice.expected_counts(p, words, np.array([1.0, 2.0, 3.0]), log_p)
    monkeypatch.setattr(lattice, "LONG", 8)
    monkeypatch.setattr(lattice, "WINDOW", 37)
    assert np.allclose(lattice.word_log_probs(p, words, log_p), want)
    assert np.allclose(lattice.expected_counts(p, words, np.array([1.0, 2.0, 3.0]), log_p), counts)


def test_scores_equal_a_brute_force_model(spark):
    """score and lattice_score of a small table, by the recursion over dictionaries: two rounds of expected counts, then the discounted words."""
    table = [(i, t) for i, t in enumerate(["the cat sat", "the cat", None, "A Cat ran the race", "zebra cat", "the the end", "cats", "", "dog the cat"] * 2, 1)]
    p = lattice.loaded(tokenizer_path("piece_bpe_32k.model"))
    number = {x: i for i, x in enumerate(p.pieces)}
    train = [(i, t) for i, t in table if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: [*brute.SPACE.findall(brute.lower(t)), ""]
    c = Counter(w for _, t in train for w in tokens(t))
    prob = p.start

    def ways(raw):
        a = [1.0] + [0.0] * len(raw)
        b = [0.0] * len(raw) + [1.0]
        for j in range(1, len(raw) + 1):
            a[j] = sum(a[i] * prob[number[raw[i:j]]] for i in range(j) if raw[i:j] in number)
        for i in range(len(raw) - 1, -1, -1):
            b[i] = sum(b[j] * prob[number[raw[i:j]]] for j in range(i + 1, len(raw) + 1) if raw[i:j] in number)
        return a, b

    for _ in range(lattice.ROUNDS):
        new = np.full(len(prob), lattice.LEAST_SHARE)
        new[p.end] += 1
        for w in set(c) - {""}:
            raw = lattice.MARK + w.encode()
            a, b = ways(raw)
            for i in range(len(raw)):
                for j in range(i + 1, len(raw) + 1):
                    if raw[i:j] in number:
                        new[number[raw[i:j]]] += a[i] * prob[number[raw[i:j]]] * b[j] / a[-1]
        prob = new / new.sum()
    n, once, twice = sum(c.values()), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    left = once / (once + 2 * twice) if once and twice else 0.5
    spelt = lambda w: prob[p.end] if not w else ways(lattice.MARK + w.encode())[0][-1]
    model = lambda w: (max(c[w] - left, 0) if c[w] else 0) / n + left * len(c) / n * spelt(w)
    for r in lattice.scored(docs(spark, table)).collect():
        words = tokens(dict(table)[r.doc_id])
        assert math.isclose(r.score, sum(math.log10(model(w)) for w in words), rel_tol=1e-9)
        assert math.isclose(r.lattice_score, sum(math.log10(spelt(w)) for w in words), rel_tol=1e-9)
