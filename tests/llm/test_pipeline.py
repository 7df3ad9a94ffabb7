import hashlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_decontaminate import words
from tests.llm.test_pii import slow as slow_spans
from tests.llm.test_simhash import slow_classes, slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(columns, rows by doc_id) of documents and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [(docs.columns, {r.doc_id: r for r in docs.collect()})]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas())
        out.append((docs.columns, {r.doc_id: r for r in docs.collect()}))
    return out


def test_columns(stages):
    assert all(columns == stages[0][0] for columns, _ in stages[:-1])
    assert "text" not in stages[-1][0]


def test_toxicity_keeps_most(stages):
    before, after = stages[0][1], stages[1][1]
    assert set(after) <= set(before) and all(after[i].text == before[i].text for i in after)
    assert len(after) > 0.7 * len(before)


def test_near_duplicates(stages):
    before, after = stages[1][1], stages[2][1]
    ids = sorted(before)
    label = slow_classes([slow_fingerprint(before[i].text) for i in ids])
    assert sorted(after) == sorted({ids[x] for x in label})


def test_decontamination(stages):
    before, after = stages[2][1], stages[3][1]
    items = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    windows = {tuple(w[i:i + 10]) for (t,) in items for w in [words(t)] for i in range(len(w) - 9)}
    clean = [i for i, r in before.items() if not any(tuple(w[k:k + 10]) in windows for w in [words(r.text)] for k in range(len(w) - 9))]
    assert sorted(after) == sorted(clean)


def test_pii(stages):
    before, after = stages[3][1], stages[4][1]
    assert sorted(after) == sorted(before)
    for i, r in before.items():
        found = slow_spans(r.text)
        assert (after[i].text == r.text) == (not found)
        assert not [s for s in slow_spans(after[i].text) if r.text[s[1]:s[2]] == after[i].text[s[1]:s[2]]] or found
        assert after[i].n_chars == (len(after[i].text) if found else r.n_chars)


def test_encoding(stages):
    ranks = __import__("spectrafold.llm.bpe", fromlist=["x"]).read_ranks(corpus_pipeline.VOCABULARY)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = stages[4][1], stages[5][1]
    assert sorted(after) == sorted(before)
    for i, r in before.items():
        assert np.frombuffer(after[i].ids, "<u4").tolist() == reference.encode_ordinary(r.text)
        assert after[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == stages[-1][0]
    assert {r.doc_id: r.ids_sha256 for r in out.collect()} == {i: r.ids_sha256 for i, r in stages[-1][1].items()}


def test_edge_rows_pass_every_stage(spark, tmp_path):
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (None, "a b c d", "en", "s", 7, 3), (3, "x " * 30_000, "en", "s", 1, 4),
            (4, "a@b.co", None, "s", 6, 5), (4, "a@b.co", None, "s", 6, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "p q r"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {"toxicity": [None, 1, 2, 3, 4, 4], "simhash": [None, 1, 3, 4]}  # 2 is empty as 1 is null: both have fingerprint zero
    for frame, empty in ((docs, False), (docs.limit(0), True)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            frame = spark.createDataFrame(out.collect(), out.schema)
            want = [] if empty else kept.get(name, kept["simhash"])
            assert sorted((r.doc_id for r in frame.collect()), key=lambda i: -1 if i is None else i) == want
            assert name == "bpe" or frame.columns == docs.columns
