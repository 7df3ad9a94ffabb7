import re

import numpy as np

from spectrafold.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def slow(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def fast(spark, texts):
    rows = pii.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.pii for r in sorted(rows, key=lambda r: r.doc_id)]


def base(spans):
    return [(s.kind, s.start, s.end) for s in spans if s.kind != "iban"]


def test_scan(spark):
    n = 1000
    row = spark.range(1).selectExpr(f"sequence(1L, {n}L) x", "cast(array() as array<bigint>) e")
    from pyspark.sql import functions as F
    got = row.select(pii.scan(F.col("x"), F.lit(0).cast("long"), lambda a, b: a + b), pii.scan(F.col("e"), F.lit(0).cast("long"), lambda a, b: a + b)).first()
    assert got[0] == np.r_[0, np.cumsum(np.arange(1, n))].tolist() and got[1] == []


def test_base_spans_like_plain_patterns(spark):
    rng = np.random.default_rng(3)
    letters = list("a@.-_ 19+()5:x") + ["é", "\n", "4111 1111 1111 1111", "+1 (806) 555-0902", "a@b.c", "1.2.3.4", "é😀"]
    texts = ["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 80, 400)]
    texts += [None, "", "x@y.z" * 30, "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.0004 1.2.3.99999999999999999999", "+1 " * 20, "a@b.c_d@e.f@g.h",
              "5500-0000-0000-0004 5500 0000 0000 0005", "9" * 50_000, "a" * 200_000, "a." * 60_000 + "@x.y", "1 " * 50_000, "+" + "(" * 50_000, "a@b.c " * 3_000]
    for text, spans in zip(texts, fast(spark, texts)):
        assert base(spans) == slow(text)
        assert [s.text for s in spans] == [(text or "")[s.start:s.end] for s in spans]


def test_added_kind_and_context(spark):
    texts = ["pay to DE89 3704 0044 0532 0130 00 bank", "DE89370400440532013001", "XDE89370400440532013000", "GB82WEST12345698765432.",
             "mail me a@b.co", "a@b.co noreply", "a@b.co"]
    out = fast(spark, texts)
    assert [[s.kind for s in x] for x in out[:4]] == [["iban"], [], [], ["iban"]]
    assert out[4][0].score > out[6][0].score > out[5][0].score


def test_mask(spark):
    long = "é" * 3000 + " a@b.co " + "x" * 5000 + " 10.0.0.1"
    rows = [(1, "call +1 (806) 555-0902 or a@b.co now", 9, "k"), (2, None, 0, "k"), (3, "", 0, "k"), (4, "clean", 5, None), (5, long, 1, "k"),
            (6, "a@b.co", 6, "k"), (6, "a@b.co", 6, "k"), (7, "4111111111111111@x.com 4111 1111 1111 1111@x.com!", 1, "k"), (None, "1.2.3.4", 7, "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, pii string")
    out = pii.mask(frame)
    assert out.columns == frame.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=repr)
    want = [(1, "call [PHONE] or [EMAIL] now"), (2, None), (3, ""), (4, "clean"), (5, "é" * 3000 + " [EMAIL] " + "x" * 5000 + " [IP]"),
            (6, "[EMAIL]"), (6, "[EMAIL]"), (7, "[CARD] [CARD]!"), (None, "[IP]")]
    assert got == sorted(((i, t, 0 if t is None else len(t)) for i, t in want), key=repr)
    assert pii.mask(frame.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    plan = pii.mask(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
