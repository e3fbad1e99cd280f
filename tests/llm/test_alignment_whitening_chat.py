"""Operators 11 to 13 against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from reliefloom.llm import alignment, chat, whitening
from reliefloom.llm.common import tokenizer_path

from . import brute

PIECES = [" ", "  ", "\n", "\t", "\r\n", " \n", " ", "a", "Word", "'s", "é", "日本", "😀", "<s>", "</s>", "<|endoftext|>", "▁", "\0", "123", "!!", "...", "\x1c", "ﬁ", "\x85", " ", "x" * 40, "<0x0A>"]


def brute_alignment(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    spelt_a = {i: alignment.byte_level(x) for x, i in t.get_vocab().items()}
    spelt_b = lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()
    docs, held = [], Counter()
    for text in texts:
        a, b, raw = t.encode(f" {text}", add_special_tokens=False).ids if text else [], s.encode(text or ""), f" {text}".encode()
        if not text or b"".join(map(spelt_a.get, a)) != raw or b"".join(map(spelt_b, b)) != raw:
            docs.append(([], [], [], Counter()))
            continue
        groups, own_a, own_b, i, j, at_a, at_b = [], [], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                own_a.append(a[i])
                at_a, i = at_a + len(spelt_a[a[i]]), i + 1
            else:
                own_b.append(b[j])
                at_b, j = at_b + len(spelt_b(b[j])), j + 1
            if at_a == at_b:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        held.update(links.keys())
        docs.append((a, b, groups, links))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for a, b, groups, links in docs:
        spelt = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((len(a), len(b), len(groups), sum(links.values()), sum(m for k, m in links.items() if held[k] == top[k[0]]), sum(m * held[k] for k, m in links.items()), brute.sha(spelt) if spelt else ""))
    return out


def odd_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["x" * 70_000 + " y", None, "", " ", "\n", "same words here", "same words here"]


def aligned_rows(spark, texts):
    table = spark.createDataFrame([(i, t, "?", 0) for i, t in enumerate(texts)], "doc_id long, text string, n_a string, run long")
    return sorted(tuple(r) for r in alignment.aligned(table.repartition(3)).collect())


@pytest.mark.parametrize("records, fan, memo, wide", [(1 << 21, 64, 64 << 20, 1 << 16), (500, 2, 1 << 16, 3)])
def test_alignment(spark, monkeypatch, records, fan, memo, wide):
    """Also with runs of few records, merges of two and a memo that is dropped again and again."""
    for name, v in (("RUN_RECORDS", records), ("FAN_IN", fan), ("MEMO_BYTES", memo), ("WIDE_GROUP", wide), ("SLICE_BYTES", 1 << 12 if fan == 2 else 2 << 20)):
        monkeypatch.setattr(alignment, name, v)
    texts = odd_texts(600)
    assert aligned_rows(spark, texts) == [(i, *x) for i, x in enumerate(brute_alignment(texts))]


def test_alignment_of_repeated_and_unnamed_rows(spark):
    table = spark.createDataFrame([(1, "one text"), (1, "one text"), (None, "one text"), (2, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in alignment.aligned(table).collect()), key=str)
    one = brute_alignment(["one text"] * 3)[0]
    assert got == sorted([(1, *one), (1, *one), (None, *one), (2, 0, 0, 0, 0, 0, 0, "")], key=str)
    assert alignment.aligned(table.limit(0)).count() == 0


def test_runs_merge_like_a_sum():
    rng = np.random.default_rng(1)
    parts = []
    for _ in range(9):
        keys = np.unique(rng.integers(0, 300, 100))
        parts.append((keys, rng.integers(1, 9, len(keys))))
    want = Counter()
    for k, c in parts:
        for x, n in zip(k.tolist(), c.tolist()):
            want[x] += n
    keys, counts = alignment.k_way_merge(parts)
    assert list(zip(keys.tolist(), counts.tolist())) == sorted(want.items())
    best = alignment.highest(keys, counts, 7)
    assert [bool(x) for x in best] == [n == max(m for k, m in want.items() if k // 7 == key // 7) for key, n in sorted(want.items())]
    for values in (np.zeros(0, np.int64), np.array([0, 255]), np.array([256]), np.array([1 << 40])):
        assert alignment.expanded(alignment.squeezed(values)).tolist() == values.tolist()


def brute_whitening(vectors, most=32):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    off = [[n * c - s for c, s in zip(row, sums)] for row in x]
    centred = np.array(off, float) / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    return [sum(c * c for c in row) for row in off], centred @ q / np.sqrt(e), e / np.trace(v)


def embedded(spark, rows):
    return spark.createDataFrame([(i, v, "?", 1) for i, v in rows], "vec_id long, embedding array<float>, n string, part int")


def test_whitening(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    known = sorted((r.vec_id, r.embedding) for r in table.collect())
    odd = [(-1, None), (-2, [float("nan")] * 64), (-3, [None] + [0.0] * 63), (-4, [float("inf")] + [0.0] * 63), (-5, []), (-6, [1.0, 2.0])]
    out = whitening.whitened(embedded(spark, known + odd).repartition(5)).toPandas().sort_values(["vec_id", "component"])
    squares, values, explained = brute_whitening([v for _, v in known])
    assert out["vec_id"].tolist() == [i for i, _ in known for _ in range(32)] and set(out["n"]) == {len(known)}
    assert out["deviation"].tolist() == [d for d in squares for _ in range(32)]
    got = out["whitened"].to_numpy().reshape(-1, 32)
    assert np.abs(got * np.sign((got * values).sum(0)) - values).max() < 1e-9
    assert np.abs(out["explained"][:32].to_numpy() / explained - 1).max() < 1e-9 and set(out["component"]) == set(range(1, 33))
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9


def test_whitening_of_few_rows_and_dimensions(spark):
    rows = [(7, [1.0, 2.0, 5.0]), (7, [1.0, 2.0, 5.0]), (None, [3.0, -1.0, 5.0]), (8, [0.5, 0.0, 5.0])]
    out = whitening.whitened(embedded(spark, rows)).toPandas()
    assert len(out) == 8 and sorted(out["vec_id"].fillna(-1)) == [-1, -1, 7, 7, 7, 7, 8, 8]  # the third dimension is constant: two components
    assert np.allclose(out.groupby("component")["whitened"].apply(lambda v: (v * v).mean()), 1)
    for few in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(embedded(spark, few)).count() == 0


def test_deviations_beyond_a_long():
    sums = [0, 3]
    off, squares = whitening.deviations(np.array([[1 << 40, 1], [5, 2]]), 2, sums)
    assert squares == [None, 100 + 1] and off.tolist()[1] == [10, 1]


SAID = [
    (1, 1, "assistant", "second </s> \\ [INST] x"), (1, 0, "user", "first\nline\n"), (1, 2, None, None), (1, 3, "assistant", ""), (1, 4, "assistant", "[/INST] end\\"), (2, 5, "a [/INST] b\\", "<s>\\<\\s>"),
    (2, 5, "a [/INST] b\\", "<s>\\<\\s>"), (None, None, "user", "nobody's"), (3, 9, "assistant", "日本 😀\n\n" * 2000),
]


def test_chat_equals_brute_force(spark):
    table = spark.createDataFrame([(*r, "?", 1) for r in SAID], "conv_id long, turn long, role string, text string, formatted string, seq int")
    got = {r.conv_id: r for r in chat.digests(chat.rendered(chat.messages(chat.turn_log(table)))).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        turns = [(role or "", text or "") for c, _, role, text in sorted((x for x in SAID if x[0] == conv), key=lambda x: x[1] or 0)]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), brute.sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), brute.sha(learned))
    shown = {r.conv_id: r for r in chat.rendered(chat.messages(chat.turn_log(table))).collect()}
    assert all(r.formatted.count("</s>") == r.n_turns == r.formatted.count("<s>[INST] ") for r in shown.values())
    assert all(len(r.formatted) == got[c].formatted_chars for c, r in shown.items())
    assert [shown[1].formatted[s.begin : s.end] for s in shown[1].loss] == ["second <\\/s> \\\\ [\\INST] x", "", "[\\/INST] end\\\\"]
    assert chat.digests(chat.rendered(chat.messages(chat.turn_log(table.limit(0))))).count() == 0


def test_a_log_is_folded(spark):
    log = [
        (1, 0, "message", "q", "user", "Hel"), (1, 1, "delta", "q", None, "lo"), (1, 2, "message", "a", "assistant", "Dra"), (1, 3, "delta", "a", None, "ft"), (1, 4, "message", "q2", "user", "gone"),
        (1, 5, "regenerate", "a", None, None), (1, 6, "delta", "a", None, "Bet"), (1, 7, "delta", "q2", None, "!"), (1, 8, "delta", "a", None, "ter"), (1, 9, "edit", "q", None, "Hi"), (1, 10, "delta", "q", None, "!"),
        (1, 11, "message", "q3", "user", "more"), (1, 12, "shrug", "q3", None, "ignored"), (2, 0, "delta", "x", "user", "unbegun"),
    ]
    random.Random(3).shuffle(log)
    table = spark.createDataFrame(log, "conv_id long, seq int, kind string, message string, role string, text string")
    got = sorted(tuple(r) for r in chat.messages(table).collect())
    assert got == [(1, 0, "user", "Hi!"), (1, 1, "assistant", "Better"), (1, 2, "user", "more"), (2, 0, "user", "unbegun")]
