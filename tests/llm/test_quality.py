import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectrafold.llm import quality

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "longest_word": max(map(len, words), default=0), "n_letter_words": sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", w)) for w in words),
        "n_bullet_lines": sum(WORD.search(x)[0][0] in "-*•" for x in lines),
        "n_ellipsis_lines": sum(WORD.findall(x)[-1].endswith(("...", "…")) for x in lines),
        "n_top_word": max(Counter(words).values(), default=0),
    }


def rejected(text):
    found = slow(text)
    return {r.name for r in quality.RULES if sum(w * found[f] for f, w in r.weights) > r.above}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t\x0b\x1c\xa0é…•.-*#|<9ß"), max_size=60), max_size=6), st.data())
def test_features(texts, data):
    part = quality.Texts.of(pa.array(texts, pa.string()))
    features = [f for f in quality.STEPS if f in slow("")]
    first = data.draw(st.sets(st.sampled_from(features)))
    for f in sorted(first):
        assert part.get(f).tolist() == [slow(t)[f] for t in texts]
    rows = np.array(data.draw(st.lists(st.booleans(), min_size=len(texts), max_size=len(texts))), bool)
    rest, kept = part.take(rows), [t for t, r in zip(texts, rows) if r]
    for f in features:
        assert rest.get(f).tolist() == [slow(t)[f] for t in kept], f


def test_documents_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    report = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rules = quality.plan(docs, report=report)
    assert sorted(r.name for r in rules) == sorted(r.name for r in quality.RULES)
    for chosen in (rules, list(quality.RULES)[::-1]):
        for r in quality.judge(docs, chosen, report).collect():
            want, bad = slow(texts[r.doc_id]), rejected(texts[r.doc_id])
            assert {f: r[f] for f in report} == {f: want[f] for f in report}
            assert r.kept == (not bad)
            assert r.rejected_by == next((x.name for x in chosen if x.name in bad), None)


def test_good_documents_stay_and_bad_ones_go(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in quality.judge(docs, report=["n_words"]).collect() if r.doc_id in labels and r.n_words >= 50]
    good, bad = ([r.kept for r in rows if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_order_is_rejections_per_cost():
    a, b, c = (quality.Rule(n, ((f, 1),)) for n, f in (("a", "n_words"), ("b", "n_symbols"), ("c", "n_repeat_words")))
    seconds = {"words": 1.0, "n_words": 0.1, "n_symbols": 0.5, "codes": 3.0, "n_repeat_words": 1.0}
    assert [r.name for r in quality.order([a, b, c], {0: 20, 1: 10, 2: 30, 5: 20, 4: 20}, seconds)] == ["b", "a", "c"]
    # with c's parts reported anyway it costs nothing
    assert quality.order([a, b, c], {0: 20, 1: 10, 2: 30, 5: 20, 4: 20}, seconds, ["n_repeat_words"])[0] is c
    # what an earlier rule rejects no longer counts
    assert [r.name for r in quality.order([a, b], {1: 10, 3: 50}, {"words": 1.0, "n_symbols": 1.5})] == ["a", "b"]
    assert quality.order([a, b, c], {}, {}) == [a, b, c]


def test_later_rules_see_only_what_is_left(monkeypatch):
    seen = []
    monkeypatch.setitem(quality.STEPS, "n_symbols", lambda t: seen.append(len(t)) or np.zeros(len(t), np.int64))
    part = quality.Texts.of(pa.array(["a b", "", "x " * 60]))
    bad = quality.BASE[0].rejects(part.get)
    part.take(~bad).get("n_symbols")
    assert bad.tolist() == [True, True, False] and seen == [1]


def test_edge_rows(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None, "k"), (2, "", "k"), (None, "one two", "k"), (3, long, "k"), (3, long, "k"), (4, "same " * 30_000, "k"), (5, "y" * 400_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    report = ["n_words", "n_repeat_words"]
    out = quality.judge(docs, quality.plan(docs, report=report), report, quality.BASE).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_repeat_words, r.short, r.repetition, r.kept) for r in out), key=repr) == sorted(
        [(1, 0, 0, True, False, False), (2, 0, 0, True, False, False), (None, 2, 0, True, False, False), (3, 60_000, 0, False, False, True),
         (3, 60_000, 0, False, False, True), (4, 30_000, 30_000, False, True, False), (5, 1, 0, True, False, False)], key=repr)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.plan(empty) == list(quality.RULES) and quality.judge(empty).collect() == []


@pytest.mark.parametrize("rule", [r.name for r in quality.RULES])
def test_each_rule_rejects_something(rule):
    plain = [f"{a}{b}ther" for a in "bcdfghklmn" for b in "aeiouy"]
    bad = {"short": "a few words", "repetition": "one two three four " * 20, "symbols": " ".join(plain) + "#" * 7, "one_word": " the ".join(plain),
           "copied_lines": "\n".join([" ".join(plain), *["copy"] * 4]), "short_words": " ".join("abcdefghijklmnopqrstuvwxyz" * 3), "long_words": " ".join(w * 3 for w in plain),
           "longest_word": " ".join([*plain, "x" * 1001]), "no_letters": " ".join([*plain, *map(str, range(100, 117))]), "bullets": "\n".join("- " + w for w in plain),
           "ellipses": "\n".join(w + ("..." if i % 2 else "") for i, w in enumerate(plain))}[rule]
    assert rule in rejected(bad) and not rejected(" ".join(plain))
