import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectrafold.llm import spelling

SF = "/root/testdata/sf0.01"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_counts(rows):
    out = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                out[run] += 1
    return out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_neighbours(words):
    """Each word's near words, by trying every edit of it."""
    known, out = set(words), {}
    letters = sorted(set("".join(words)))
    for w in words:
        tried = {w[:i] + w[i + 1:] for i in range(len(w))}
        tried |= {w[:i] + c + w[i + k:] for i in range(len(w) + 1) for c in letters for k in (0, 1) if i + k <= len(w)}
        out[w] = (tried & known) - {w}
    return out


def slow_variants(counts):
    n = {w: c for w, c in counts.items() if c >= 5}
    around, out = slow_neighbours(list(n)), {}
    form = {}
    for w in n:
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(around[w]), n[form[w]] if form[w] is not None else None)
    return out


def result(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_documents_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    counts = slow_counts(rows)
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == counts
    want = slow_variants(counts)
    assert sum(f is not None for f, *_ in want.values()) > 20
    assert result(spelling.variants(spelling.word_counts(docs))) == want


WORDS = st.lists(st.text("abcé", min_size=6, max_size=11), min_size=2, max_size=60, unique=True)


@settings(max_examples=200, deadline=None)
@given(WORDS, st.integers(1, 8))
def test_near_words_share_a_listed_gram(words, bound):
    counts = Counter(m[i:i + q] for w in words for m in [f"^{w}$"] for q in range(2, 7) for i in range(len(m) - q + 1))
    frequent = {g: n for g, n in counts.items() if n > bound}
    for a in words:
        grams, affected = spelling.decompose(f"^{a}$", frequent)
        assert len(grams) > affected
        for b in words:
            if len(a) <= len(b) and near(a, b):
                mine = spelling.listed(f"^{a}$", frequent)
                lists = {(g, p) for g, p in mine} if len(a) == len(b) else {(g, p + k) for g, p in mine for k in (0, 1)}
                assert lists & set(spelling.listed(f"^{b}$", frequent))


@settings(max_examples=100, deadline=None)
@given(st.integers(6, 8), st.integers(0, 1000))
def test_pairs_of_a_list(size, seed):
    import random
    r = random.Random(seed)
    own = sorted({"".join(r.choice("ab") for _ in range(size)) for _ in range(r.choice([3, 40, 200]))})
    shorter = sorted({"".join(r.choice("ab") for _ in range(size - 1)) for _ in range(r.choice([0, 5, 100]))})
    want = {(a, b) for i, a in enumerate(own) for b in own[i + 1:] if near(a, b)} | {(a, b) for a in own for b in shorter if near(a, b)}
    assert spelling.near_pairs(own, shorter) == want


@pytest.mark.parametrize("long_list", [3, 1 << 20])
@pytest.mark.parametrize("frequent", [1, 5, 10_000])
def test_lists_of_any_length(spark, rng, long_list, frequent):
    words = {"".join(rng.choice(list("abc"), rng.integers(6, 9))) for _ in range(400)} | {"prefix" + a + b for a in "abcdefgh" for b in "abcdefgh"}
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    found = [frozenset(r) for r in spelling.near_words(frame, frequent, long_list).collect()]
    want = {frozenset((a, b)) for a, others in slow_neighbours(sorted(words)).items() for b in others}
    assert len(found) == len(set(found)) and set(found) == want


def test_dictionary_is_bounded(spark):
    words = spark.createDataFrame([(f"{a}{b}{c}word",) for a in "abcdef" for b in "abcdef" for c in "abcdef"], "word string")
    free, few = spelling.frequent_grams(words, 3), spelling.frequent_grams(words, 3, entries=20)
    assert len(few) <= 20 < len(free) and set(few.items()) <= set(free.items())


def test_chains_ties_and_edges(spark):
    counts = {"colour": 3125, "colours": 625, "coloure": 5, "colourss": 125, "kolourss": 25, "kolours": 5, "abcdef": 5, "abcdeg": 25, "abcdeh": 25, "lonely": 99,
              "seldom": 4, "seldon": 100, "x" * 3000: 5, "x" * 3001: 30}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    out = result(spelling.variants(frame))
    assert out == slow_variants(counts)
    assert out["kolourss"][:2] == ("colourss", "colour") and out["abcdef"][0] == "abcdeg" and "seldom" not in out
    assert out["x" * 3000][0] == "x" * 3001 and out["lonely"] == (None, "lonely", 99, 0, None)


def test_edge_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (None, "Straße STRASSE Été×s÷b " * 6, 9), (3, "wonderful " * 50_000, 9), (3, "wonderful " * 50_000, 9),
            (4, "a" * 300_000 + " wonderfull" * 9, 9), (5, "12 Ābcdefgh 3", 9), (6, "퟿\U0001f600wonderful ", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    want = slow_counts([r[:2] for r in rows])
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == want
    assert result(spelling.variants(spelling.word_counts(docs))) == slow_variants(want)
    assert result(spelling.variants(spelling.word_counts(docs.limit(0)))) == {}
