"""The pipeline against plain Python, stage by stage."""

import corpus_pipeline
from reliefloom.llm.common import tokenizer_path

from . import brute


def test_pipeline_equals_brute_force(spark, sf):
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12345 !!", "en", "x", 8), (10**6 + 1, None, None, None, None), (10**6 + 2, "", "en", "x", 0)], table.schema)
    docs = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got, step = table.unionByName(extra), None
    for name, step in corpus_pipeline.STAGES[:-1]:
        columns = got.columns
        got = step(spark, got, sf)
        assert got.columns == columns, name
        if name == "language identification":
            assert {r.doc_id for r in got.select("doc_id").collect()} == {i for i, _ in docs}
        elif name == "line dedup":
            docs = [(i, "\n".join(k)) for i, _, k in brute.without_repeated_lines(docs)]
        elif name == "near-duplicates":
            kept = {d for d, _, _, k in brute.near_duplicates(docs) if k}
            docs = [x for x in docs if x[0] in kept]
        elif name == "decontamination":
            bad = {x[0] for x in brute.contamination(docs, items) if x[-1]}
            docs = [x for x in docs if x[0] not in bad]
        assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(docs), name
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    coded = {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, got, sf).collect()}
    for i, text in docs:
        ids = t.encode(text, add_special_tokens=False).ids
        assert coded[i] == (ids, brute.sha(t.decode(ids, skip_special_tokens=False)))


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0


def test_stages_keep_columns_of_any_name(spark, sf):
    """Columns that operators use themselves, dots, repeated rows, ties, a very long text and rows without doc_id."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    known = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table.collect()]
    line = "This very line stands in several documents here."
    long = " ".join(f"longest{i}" for i in range(60_000))
    more = [(10**6, f"{line}\nand one more", "en", "s", 1), (10**6, f"{line}\nand one more", "en", "s", 1), (10**6 + 1, line, "en", "s", 1), (10**6 + 2, f"{line}\nown", "en", "s", 1), (10**6 + 3, long, "en", "s", 1), (None, f"{line}\nunnamed", "en", "s", 1)]
    names = ["_lost", "lost", "_lost_id", "lost_id", "a.b", "lang_pred", "lang_score", "c0", "gone", "kept", "bad_id", "text_hash", "component_id"]
    wide = spark.createDataFrame([(*r, *(f"{n} {r[0]}" for n in names)) for r in known + more], table.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", " + ", ".join(f"`{n}` string" for n in names))
    plain = wide.select(*table.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide, plain = stage(spark, wide, sf), stage(spark, plain, sf)
        assert wide.columns == [*table.columns, *names]
        got = sorted((tuple(r) for r in wide.collect()), key=str)
        assert sorted((r[:5] for r in got), key=str) == sorted((tuple(r) for r in plain.collect()), key=str), name
        assert all(v == f"{n} {r[0]}" for r in got for n, v in zip(names, r[5:])), name
        ids = [r[0] for r in got]
        assert None in ids and 10**6 + 3 in ids
        if name == "language identification":
            assert ids.count(10**6) == 2
        if name == "line dedup":
            texts = {r[0]: r[1] for r in got}
            assert texts[10**6] == "and one more" and texts[10**6 + 1] == "" and texts[10**6 + 2] == f"{line}\nown" and texts[None] == f"{line}\nunnamed"
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf).count() == len(got)
