import numpy as np
import pytest

from spectrafold.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(0)
    plain = [f"{a}{b}" for a in "bcdfghjklm" for b in ("al", "er", "ing", "ton")]
    rude = ["idiot", "scum", "trash", "Schurke"]

    def text(bad, n):
        words = list(rng.choice(plain, n))
        for _ in range(bad):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(rude)))
        return " ".join(words)

    rows = [(text(2 * (i % 4 == 0), int(rng.integers(10, 400))), int(i % 4 == 0)) for i in range(800)]
    # toxic sentences mention a group more often than clean ones
    return [(t + (" women" if y and rng.random() < 0.7 else ""), y) for t, y in rows]


def scores(spark, model, texts):
    out = tx.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    return [r.score for r in sorted(out, key=lambda r: r.doc_id)]


def test_learns_and_ignores_identity(spark, corpus):
    texts, labels = zip(*corpus)
    model = tx.fit(list(texts[:600]), list(labels[:600]))
    got = np.array(scores(spark, model, texts[600:]))
    assert ((got >= 0.5) == np.array(labels[600:])).mean() > 0.97
    neutral = "bal ber bing bton cal cer"
    a, b, c, bad = scores(spark, model, [neutral, neutral + " women", neutral + " muslims", neutral + " women scum"])
    assert abs(a - b) < 0.05 and abs(b - c) < 0.05 and b < 0.5 < bad


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = tx.train(docs, labels)
    out = tx.score(docs.filter(tx.held_out(docs.doc_id)), model).join(labels, "doc_id").collect()
    y, p = np.array([r.toxic for r in out]), np.array([r.score for r in out])
    assert ((p >= 0.5) == y).mean() > 0.85
    assert len(y) > 40


def test_edges(spark):
    one = tx.fit(["a b"], [0])
    assert tx.fit([], []).slope == 0.0
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "... !!", 0.5), (4, "w " * 100_000, 0.5), (4, "w " * 100_000, 0.5), (None, "é" * 100_000, 0.5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double")
    out = tx.score(frame, one)
    assert out.columns == ["doc_id", "text", "score"] and all(0 <= r.score < 0.5 for r in out.collect()) and out.count() == 6
    assert tx.score(frame.limit(0), one).collect() == []
    empty = tx.train(frame.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert scores(spark, empty, ["x"])[0] < 0.5
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    tx.train(frame, labels)


def test_repeated_words_do_not_add_up():
    import pyarrow as pa
    s = tx.Sentences(pa.array(["spam " * 16, "spam", ""]))
    w = np.zeros(tx.BUCKETS)
    w[:] = 1.0
    assert s.highest(s.logits(w, 0.5), 0.5).tolist() == [s.logits(w, 0.5)[1]] * 2 + [0.5]


def test_chunks_make_no_difference(monkeypatch):
    import pyarrow as pa
    texts = pa.array([f"word{i} again again {'long ' * (i % 40)}" for i in range(200)] + ["", "x"])
    a, b = tx.Sentences(texts), None
    monkeypatch.setattr(tx, "CHUNK", 300)
    b = tx.Sentences.of(texts)
    assert (a.buckets == b.buckets).all() and (a.starts == b.starts).all() and (a.row == b.row).all() and a.rows == b.rows
