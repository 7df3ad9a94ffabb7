import numpy as np

from spectrafold.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    assert model.languages == ["de", "en", "es", "fr"]
    out = langid.predict(docs.filter(langid.held_out(docs.doc_id)), model).collect()
    assert len(out) > 200 and sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95
    assert sum(r.rejected for r in out) / len(out) < 0.1


def test_edges(spark):
    model = langid.fit(["the cat is on the mat"] * 30 + ["le chat est sur la table"] * 30, ["en"] * 30 + ["fr"] * 30)
    rows = [(1, None, 9), (2, "", 9), (3, "123 !?", 9), (4, "the mat is on the cat", 9), (4, "the mat is on the cat", 9), (None, "la chat est la " * 20_000, 9), (6, "中", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score int")
    out = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 4, None)] == ["und", "und", "und", "en", "fr"]
    assert out[1].score == 0 and out[1].rejected and all(0 <= r.score <= 1 for r in out.values()) and out[6].lang_pred in ("en", "fr")
    assert langid.predict(frame, model).count() == 7 and langid.predict(frame.limit(0), model).collect() == []
    none = langid.train(frame.limit(0).selectExpr("doc_id", "text", "'x' as lang"))
    assert {r.lang_pred for r in langid.predict(frame, none).collect()} == {"und"}
    assert langid.predict(frame, langid.fit(["a"], ["en"])).filter("doc_id = 4").first().lang_pred == "en"


def test_means_stay_within_rows():
    import pyarrow as pa
    table = np.random.default_rng(0).normal(size=(langid.BUCKETS + 1, 3))
    table[-1] = 0
    texts = ["abc def", "", "é", "  ", "abc def"]
    together = langid._means(table, *langid.subwords(pa.array(texts)))
    alone = [langid._means(table, *langid.subwords(pa.array([t])))[0] for t in texts]
    assert np.allclose(together, alone)
