import re

import numpy as np
import pytest

from spectrafold.llm import decontaminate as dc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def slow(docs, items):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            n = min(10, len(b))
            for k in range(len(b) - n + 1 if b else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == b[k:k + n]:
                        hit.update(range(p, p + n))
                        found.add(item)
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def fast(spark, docs, items):
    found = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in found.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_like_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "b", "É", "Zz", "x9", "ß"][:2 + 2 * seed]

    def text(n):
        return " ".join(rng.choice(vocabulary, n))

    items = [(i, text(n)) for i, n in enumerate([0, 1, 2, 3, 5, 7, 9, 10, 11, 14, 25, 25])] + [(50, None), (60, text(12)), (60, text(13))]
    items.append((70, items[10][1]))
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 60, 25))]
    docs += [(100, text(20) + ", " + items[10][1].upper() + "! " + text(15)), (101, items[9][1][:-3]), (102, None), (103, ""),
             (104, "a" * 50_000), (105, text(3000)), (None, items[10][1]), (7, items[11][1]), (7, items[11][1])]
    assert fast(spark, docs, items) == slow(docs, items)


def test_empty_tables(spark):
    assert fast(spark, [], [(1, "a b c")]) == []
    assert fast(spark, [(1, "a b c")], []) == [(1, 3, 0, [])]


def test_kept_rows_have_all_columns(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "x " + passage, 5, "h"), (2, "clean", 6, "h"), (2, "clean", 6, "h"), (None, None, 7, "k")],
                                 "doc_id long, text string, n_words int, hash string")
    kept = dc.keep_clean(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(r.n_words for r in kept.collect()) == [6, 6, 7]


def test_winnowing_guarantee():
    rng = np.random.default_rng(5)
    grams = rng.integers(0, 50, 4000).astype(np.uint64)
    row = np.sort(rng.integers(0, 40, 4000))
    fits = np.r_[row[3:] == row[:-3], [False] * 3]
    kept = np.zeros(4000, bool)
    kept[dc.winnow(grams, fits, row, 6)] = True
    for i in range(4000 - 5):
        if row[i] == row[i + 5] and fits[i + 5]:
            assert kept[i:i + 6][grams[i:i + 6] == grams[i:i + 6].min()].all()
    for r in range(40):
        if fits[row == r].any():
            assert kept[row == r].any()
    assert not kept[~fits].any()
