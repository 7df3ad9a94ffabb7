import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.llm import ann


def brute(ids, vectors, k=5, every=50):
    ids, vectors = np.asarray(ids), np.asarray(vectors, float)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (vectors * vectors[i]).sum(axis=1) / (norms * norms[i])
        score[i] = -np.inf
        by = np.lexsort((ids, -score))[:min(k, len(ids) - 1)]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in by]
    return out


def found(spark, rows, schema="vec_id long, embedding array<double>", every=50):
    frame = spark.createDataFrame(rows, schema)
    out = {}
    for r in ann.nearest(frame, F.col("vec_id") % every == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("block", [600, ann.BLOCK_ROWS])
def test_recall_on_given_vectors(spark, block, monkeypatch):
    path = "sf0.1"
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{path}/embeddings.parquet").collect()]
    want, got = brute(*zip(*rows)), found(spark, rows)
    assert set(want) == set(got)
    hits = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.95
    for q in want:
        exact = dict(brute(*zip(*rows), k=len(rows))[q]) if q == min(want) else None
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        assert exact is None or all(abs(exact[i] - s) < 1e-12 for i, s in got[q])


def test_hard_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6000, 32))
    want = brute(range(6000), x)
    index = ann.Index(np.arange(6000), x)
    asked = np.arange(0, 6000, 50)
    got = {q: ids for q, ids, _ in index.search(asked, x[asked], 5)}
    assert np.mean([len(set(got[q].tolist()) & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.95


def test_copies_ties_and_few_rows(spark):
    v = [1.0, 2.0, 2.0]
    out = found(spark, [(i, v) for i in range(120)] + [(500, [-1.0, 0.0, 0.0])])
    assert [i for i, _ in out[0]] == [1, 2, 3, 4, 5] and [i for i, _ in out[50]] == [0, 1, 2, 3, 4]
    assert found(spark, [(0, v), (1, [0.0, 1.0, 0.0]), (2, [2.0, 4.0, 4.0])])[0] == [(2, 1.0), (1, 2 / 3)]
    assert found(spark, [(0, v)]) == {}


def test_unusable_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [float("nan"), 1.0], 1), (4, [None, 1.0], 1), (5, [float("inf"), 1.0], 1),
            (6, [1.0, 1.0], 1), (6, [1.0, 1.0], 1), (None, [1.0, 0.0], 1), (50, [1.0, 0.0, 0.0], 1), (100, [0.0, 0.0], 1), (7, [], 1)]
    out = found(spark, rows, "vec_id long, embedding array<double>, size int")
    assert set(out) == {0} and [i for i, _ in out[0]] == [6, 6]
    assert found(spark, [], "vec_id long, embedding array<double>") == {}


def test_repeated_ids_and_extreme_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e-160, 1e-161]), (2, [1e151, 0.0]), (3, [1.0, 1.0]), (3, [1.0, 2.0]), (4, [5e-324, 0.0]), (4, [5e-324, 0.0])]
    out = found(spark, rows)[0]
    assert [i for i, _ in out] == [2, 4, 4, 1, 3]
    assert np.allclose([s for _, s in out], [1, 1, 1, 10 / 101 ** 0.5, 0.5 ** 0.5], atol=1e-12)
    frame = spark.createDataFrame([(50, [1.0, 0.0])] * 3 + [(50, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, round(r.score, 3)) for r in ann.nearest(frame, F.col("vec_id") % 50 == 0).collect())
    of_a_copy, of_the_other = [(1, 50, 1.0), (2, 50, 1.0), (3, 7, 0.707), (4, 50, 0.0)], [(1, 7, 0.707), (2, 50, 0.0), (3, 50, 0.0), (4, 50, 0.0)]
    assert got == sorted(of_a_copy * 3 + of_the_other)


def test_queries_meet_blocks_without_copies_of_either(spark, monkeypatch):
    """Nothing that holds queries once for each block is broadcast or shuffled; several streams and shares give the same rows."""
    for name, value in (("BLOCK_ROWS", 30), ("QUERY_ROWS", 4), ("STREAMS", 3), ("HELD_BYTES", 1000)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((100, 8)), 6, axis=0) + 0.01 * rng.standard_normal((600, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(600 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 5)))]  # another length: neighbours of their own
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 10 == 0, k=5)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan and "explode(sequence" not in plan
    want = brute(range(600), x, every=10)
    assert len(got) == 80 and all(set(g) == {1, 2, 3, 4, 5} for g in got.values())
    for q, near in want.items():
        assert [got[q][n + 1][0] for n in range(5)] == [i for i, _ in near]
        assert np.allclose([got[q][n + 1][1] for n in range(5)], [s for _, s in near], atol=1e-12)
    assert all(i >= 600 for q in got if q >= 600 for i, _ in got[q].values())


def test_best_keeps_ties_by_id():
    best = ann.Best(np.array([7, 8]), np.array([1, 2]), np.array([1, 3]), 2)
    best.add([(np.array([5, 6]), np.array([0.5, 0.5])), (np.array([], np.int64), np.array([]))])
    best.add([(np.array([4]), np.array([0.5])), (np.array([9]), np.array([-1.0]))])
    assert best.rows().to_pydict() == {"query_id": [7, 7, 8], "tell": [1, 1, 2], "copies": [1, 1, 3], "vec_id": [4, 5, 9], "score": [0.5, 0.5, -1.0]}
