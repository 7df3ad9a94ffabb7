import numpy as np
import pytest
import xxhash

from spectrafold.llm import simhash
from spectrafold.llm.components import connected_components

SF = "/root/testdata/sf0.01"


def slow_fingerprint(text):
    words, out = (text or "").encode().lower().split(), 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    for bit in range(64):
        out |= (2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit
    return out


def slow_classes(fps):
    label = list(range(len(fps)))
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    while True:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(f))]
        if new == label:
            return label
        label = new


def result(spark, rows, schema="doc_id long, text string"):
    out = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    return sorted(((r.doc_id, r.fp, r.component_id) for r in out), key=repr)


def test_fingerprint():
    for text in ("", "a", "A b C", "one two three four five six", "é ß x y\tz\x0bq\x0cw\r\nv", "Is " * 500, "x" * 9000):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_documents_like_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: (r.fp % 2**64, r.component_id) for r in
             simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    ids = sorted(r.doc_id for r in rows)
    texts = {r.doc_id: r.text for r in rows}
    fps = [slow_fingerprint(texts[i]) for i in ids]
    assert [found[i][0] for i in ids] == fps
    assert [found[i][1] for i in ids] == [ids[x] for x in slow_classes(fps)]


def test_edge_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (None, ""), (7, "same words here now"), (7, "same words here now"),
            (8, "same words HERE now"), (1, "b" * 300_000), (2, "w " * 40_000)]
    out = result(spark, rows)
    assert len(out) == len(rows)
    by = {(a, b): c for a, b, c in out}
    zero = {c for (a, b), c in by.items() if b == 0}
    assert zero == {3} and by[(None, 0)] == 3
    assert by[(8, by and next(b for a, b in by if a == 8))] == 7
    assert result(spark, [(None, "x y z w"), (None, "x y z w")]) == [(None, out_fp, None) for out_fp in [result(spark, [(1, "x y z w")])[0][1]] * 2]
    assert result(spark, []) == []


def test_extra_columns(spark):
    frame = spark.createDataFrame([(1, "a b c d e", "x", 1), (2, "a b c d e", "y", 2)], "doc_id long, text string, fp string, component_id int")
    assert {r.component_id for r in simhash.near_duplicates(frame).collect()} == {1}
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns and [r.doc_id for r in kept.collect()] == [1]


def test_one_row_of_each_class_stays(spark):
    shared, other = "these four words and five more", "something else that nobody has written before"
    rows = [(1, "a first text of its own kind"), (2, other), (2, shared), (3, shared), (None, shared), (None, "only without an id at all"),
            (None, "only without an id at all"), (4, None), (5, "")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted(
        [(1, rows[0][1]), (2, other), (2, shared), (None, rows[5][1]), (4, None)], key=repr)
    assert simhash.keep_first(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("hot", [4, simhash.HOT_BUCKET])
def test_edges_connect_like_all_pairs(spark, rng, hot):
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    flips = np.array([[sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(12)] for _ in base], np.uint64)
    fps = np.unique(np.r_[(base[:, None] ^ flips).ravel(), np.arange(200, dtype=np.uint64)])
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = simhash.near_edges(frame, hot_bucket=hot)
    roots = {r.node % 2**64: r.root for r in connected_components(edges, "a", "b").collect()}
    want = slow_classes(fps.tolist())
    got = [roots.get(int(f), int(f.view(np.int64))) for f in fps]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_links_of_a_dense_bucket(rng):
    fps = np.unique(rng.integers(0, 2**14, 3000).astype(np.uint64) | np.uint64(5 << 40))
    a, b = simhash.links(fps, cells=1000)
    parent = {int(x): int(x) for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        parent[root(x)] = root(y)
    assert len({root(int(x)) for x in fps}) == len(set(slow_classes(fps.tolist())))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1300)] + [(7, 7), (None, 3)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in out} == {**{i: 0 for i in range(101)}, **{i: 1000 for i in range(1000, 1300)}}
