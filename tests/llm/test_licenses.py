import numpy as np
import pytest

from spectrafold.llm import licenses as lc

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return lc.train(spark.read.parquet(f"{SF}/documents.parquet"))


def families(spark, model, texts):
    rows = lc.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    return [[(x.paragraph, x.family) for x in r.licenses] for r in sorted(rows, key=lambda r: r.doc_id)]


def test_lines_of_the_corpus(spark, model):
    known = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache", "Released under the MIT License.": "MIT",
             "All rights reserved.": "Proprietary", "This work is licensed under the GNU General Public License, version 3.": "GPL"}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: [(i, known[line]) for i, line in enumerate(r.text.split("\n")) if line in known] for r in docs.collect()}
    found = {r.doc_id: [(x.paragraph, x.family) for x in r.licenses] for r in lc.scan(docs, model).collect()}
    assert sum(len(x) for x in truth.values()) > 10
    assert found == truth


def test_unknown_and_harmless(spark, model):
    out = families(spark, model, ["Released under the Wonderful Public License, version 9", "he lost his driving license on the road", "plain\n\nwords here",
                                  "x\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and files\ny"])
    assert out[0] in ([(0, lc.UNKNOWN)], []) and out[1] in ([], [(0, lc.UNKNOWN)]) and out[2] == [] and out[3] == [(1, "MIT")]


def test_edges(spark, model):
    assert families(spark, model, [None, "", "\n\n", "a" * 100_000, "w " * 50_000 + "\nAll rights reserved.", "\nAll rights reserved."]) == [
        [], [], [], [], [(1, "Proprietary")], [(1, "Proprietary")]]
    frame = spark.createDataFrame([(1, "x", 5), (1, "x", 5), (None, None, 6)], "doc_id long, text string, licenses int")
    assert lc.scan(frame, model).count() == 3 and lc.scan(frame.limit(0), model).collect() == []
    assert lc.train(frame.limit(0)).names[0] == lc.NONE


def test_features_stay_in_paragraphs():
    import pyarrow as pa
    grams, owner, row = lc.features(pa.array(["a b\nc d", "", "e"]))
    assert len(grams) == 5 + 2 and sorted(set(owner.tolist())) == [0, 1, 2] and row.tolist() == [0, 0, 2]
    assert np.bincount(owner).tolist() == [3, 3, 1]
