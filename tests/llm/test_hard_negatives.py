import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.llm import hard_negatives as hn


def slow(rows, every=100):
    """Counter of result rows, by plain loops."""
    kept = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, label, [math.floor(256 * x) for x in v]))
    out = Counter()
    for a, (i, label, v) in enumerate(kept):
        if i % every:
            continue
        others = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for b, (j, other, w) in enumerate(kept) if b != a and len(w) == len(v))
        for ps, p, _ in [x for x in others if x[2] == label][:5]:
            inside = [(s, j) for s, j, other in others if other != label and 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            out.update((i, p, k + 1, j, -ps, -s) for k, (s, j) in enumerate(inside))
    return out


def found(spark, rows, schema="vec_id long, label int, embedding array<double>"):
    frame = spark.createDataFrame(rows, schema)
    return Counter(tuple(r) for r in hn.mine(frame, F.col("vec_id") % 100 == 0).collect())


@pytest.mark.parametrize("small", [False, True])
def test_like_brute_force(spark, rng, small, monkeypatch):
    if small:
        monkeypatch.setattr(hn, "BLOCK_ROWS", 50)
        monkeypatch.setattr(hn, "TREE_ANCHORS", 3)
    centres = rng.standard_normal((6, 12))
    rows = [(i, int(c), (centres[c] + 0.4 * rng.standard_normal(12)).round(2).tolist()) for i, c in enumerate(rng.integers(0, 6, 700))]
    want = slow(rows)
    assert len(want) > 300 and found(spark, rows) == want


def test_bounds_spare_products(rng):
    centres = 5 * rng.standard_normal((8, 16))
    label = rng.integers(0, 8, 2000)
    x = np.floor(256 * (centres[label] + 0.2 * rng.standard_normal((2000, 16)))).astype(np.int64)
    part = lambda rows: hn.Part(16, rows, rows, label[rows], np.ones(len(rows), np.int64), x[rows])
    anchors, block, tally = part(np.arange(0, 2000, 20)), part(np.arange(2000)), []
    got = {i: (ids.tolist(), s.tolist()) for i, ids, s in hn.positives(anchors, block, 5, tally)}
    windows = [[(-(-30 * s // 100), 90 * s // 100) for s in got[i][1]] for i in range(len(anchors.ids))]
    for i, w, ids, s in hn.negatives(anchors, block, windows, 10, tally):
        a, b = windows[i][w]
        exact = x @ anchors.vectors[i]
        want = sorted((-int(exact[j]), j) for j in range(2000) if label[j] != anchors.labels[i] and a <= exact[j] <= b)[:10]
        assert [j for _, j in want] == ids.tolist() and [-e for e, _ in want] == s.tolist()
    assert sum(n for n, _ in tally) < 0.2 * sum(n for _, n in tally)


def test_bounds_hold(rng):
    x = rng.integers(-300, 300, (200, 10))
    part = lambda rows: hn.Part(10, rows, rows, rows, rows, x[rows])
    anchors, block = part(np.arange(40)), part(np.arange(200))
    for i, low, high, rescore in hn.walk(anchors, block):
        exact = x @ x[i]
        assert (low <= exact).all() and (exact <= high).all()
        rows = rng.choice(200, 20, replace=False)
        assert (rescore(rows) == exact[rows]).all()


def test_tree_is_minimal(rng):
    x = rng.integers(-50, 50, (30, 4))
    edges = list(hn.spanning_tree(x))
    assert sorted(i for i, _, _ in edges) == list(range(30)) and [p for _, p, _ in edges].count(-1) == 1
    seen = set()
    for i, p, d in edges:
        assert p == -1 or p in seen and abs(d - np.linalg.norm(x[i] - x[p])) < 1e-9
        seen.add(i)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    group, total = list(range(30)), 0.0
    for d, a, b in sorted((far[a, b], a, b) for a in range(30) for b in range(a)):
        if group[a] != group[b]:
            total += d
            group = [group[b] if g == group[a] else g for g in group]
    assert abs(total - sum(d for *_, d in edges)) < 1e-6


def test_products_of_any_size():
    rows = np.array([[1 << 20, -3], [(1 << 63) - 1, 5], [-(1 << 63), 7]], np.int64)
    for v in ([2, 3], [1 << 40, 1], [(1 << 63) - 1, 1 << 62]):
        want = [min(max(int(a) * v[0] + int(b) * v[1], -(1 << 63)), (1 << 63) - 1) for a, b in rows]
        assert hn.dot(rows, np.array(v, np.int64)).tolist() == want
        assert hn.dot(rows[:1], np.array(v, np.int64)).tolist() == want[:1]


def test_edge_rows(spark):
    v, w, u = [1.0, 0.0], [0.5, 0.1], [0.25, 3.0]
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, v), (0, 1, v), (100, 1, w), (1, 1, w), (1, 1, w), (1, 2, w), (2, 2, u), (2, 2, u), (3, 2, u), (4, None, v), (5, 1, None), (6, 2, [nan, 1.0]),
            (7, 2, [None, 1.0]), (8, 2, [inf, 1.0]), (None, 2, u), (9, 2, [1.0, 1.0, 1.0]), (200, 3, [0.0, 0.0]), (10, 3, [0.0, 1.0]), (300, 4, v), (11, 2, []), (400, 2, []),
            (500, 5, [-1.0, 0.0]), (12, 5, [1.0, 0.0]), *[(20 + i, 6, [0.4, 0.0]) for i in range(12)]]
    want = slow(rows)
    assert {k[0] for k in want} >= {0, 100, 200} and max(want.values()) > 1
    assert found(spark, rows) == want
    assert found(spark, []) == Counter()
    extra = spark.createDataFrame([(0, 1, v, 5), (1, 1, v, 5), (2, 2, w, 5)], "vec_id long, label int, embedding array<float>, size int")
    assert [tuple(r) for r in hn.mine(extra, F.col("size") == 5).collect() if r.anchor_id == 0] == [(0, 1, 1, 2, 65536, 32768)]


def test_hot_vector_and_label(spark, rng, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 64)
    rows = [(i, 0 if i % 3 else i % 7, [0.5, 0.25, 0.125] if i % 2 else rng.random(3).round(1).tolist()) for i in range(600)]
    assert found(spark, rows) == slow(rows)
