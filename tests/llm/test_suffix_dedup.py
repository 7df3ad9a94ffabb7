import numpy as np
import pyarrow as pa
import pytest

from spectrafold.llm import suffix_dedup as sd
from spectrafold.llm import suffixes


def slow(rows):
    """{(id, text): removed flags}; rows in order of id, equal ids by a hash of the text that the caller avoids."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for s in range(len(body) - sd.LENGTH + 1):
            w = body[s:s + sd.LENGTH]
            if w in seen:
                gone[s:s + sd.LENGTH] = True
            seen.add(w)
        out[i, text] = gone
    return out


def check(spark, rows, partitions=3):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = sd.deduplicate(frame).collect()
    want = slow(rows)
    assert len(got) == len(rows)
    by_id = {}
    for i, text in rows:
        by_id.setdefault(i, []).append((text, want[i, text]))
    for r in got:
        text, gone = by_id[r.doc_id][0]
        body = (text or "").encode()
        runs = [(x.start, x.end) for x in r.removed]
        flags = np.zeros(len(body), bool)
        for a, b in runs:
            flags[a:b] = True
        assert (flags == gone).all(), (r.doc_id, runs)
        assert all(b < c for (_, b), (c, _) in zip(runs, runs[1:]))
        assert r.n_bytes == len(body) and r.n_removed == gone.sum() and r.kept == bytes(np.frombuffer(body, np.uint8)[~gone])


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeé"), int(n))) for n in rng.integers(1, 9, 60)]

    def text(n):
        return " ".join(rng.choice(words, n))

    shared = [text(30) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [text(int(rng.integers(0, 40)))]
        for _ in range(int(rng.integers(0, 3))):
            piece = str(rng.choice(shared))
            a = int(rng.integers(0, 60))
            parts += [piece[a:a + int(rng.integers(80, 200))], text(int(rng.integers(0, 8)))]
        rows.append((int(i), "|".join(parts)))
    rows += [(100 + j, rows[5][1]) for j in range(5)] + [(200, None), (201, ""), (202, "x" * 99), (203, "x" * 450), (204, "ab" * 300), (205, "abc" * 40),
             (None, rows[7][1]), (3, rows[3][1]), (206, "é" * 120), (207, rows[9][1][:-1] + "#" + rows[9][1])]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_like_brute_force(spark, seed):
    check(spark, corpus(seed))


def test_hot_anchors_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT_ROWS", 3)
    monkeypatch.setattr(sd, "SHARD_BYTES", 300)
    check(spark, corpus(5), 2)


def test_small_gram_makes_many_strings_of_one_anchor(spark, monkeypatch):
    rng = np.random.default_rng(1)
    line = "".join(rng.choice(list("abcdefgh"), 70))
    rows = [(i, "".join(rng.choice(list("xy"), 40)) + line + "".join(rng.choice(list("xy"), 40))) for i in range(150)]
    rows += [(500 + i, rows[i][1][20:] + "zz") for i in range(40)]
    monkeypatch.setattr(sd, "HOT_ROWS", 10)
    check(spark, rows, 2)


def test_one_passage_in_different_neighbourhoods_is_not_gathered(monkeypatch):
    rng = np.random.default_rng(3)
    passage, n = "".join(rng.choice(list("abcdefgh "), 300)), 40
    texts = ["".join(rng.choice(list("stuvw"), 120)) + passage + "".join(rng.choice(list("stuvw"), 120)) for _ in range(n)]
    monkeypatch.setattr(sd, "HOT_ROWS", 3)
    owners = pa.table({"ord": np.arange(n), "key": np.arange(n) * 7919})
    anchors = pa.Table.from_batches(sd._anchor_rows(owners.append_column("text", pa.array(texts)).to_batches()))
    first = pa.Table.from_batches(sd._first_strings(anchors.sort_by([(c, "ascending") for c in ("h", "c", "ord", "key", "start")]).to_batches(max_chunksize=2)))
    assert first["hot"].to_numpy().any()
    spots = [[r for r in first.to_pylist() if r["ord"] == i] for i in range(n)]
    names, parts = ("h", "place", "start", "end", "hot", "kind"), []
    kind = pa.list_(pa.struct([first.schema.field(c) for c in names]))
    whole = owners.append_column("text", pa.array(texts)).append_column("spots", pa.array([[{c: r[c] for c in names} for r in x] for x in spots], kind))
    for low in (0, n // 2):
        parts += sd._cut_strings(whole.slice(low, n // 2).combine_chunks().to_batches())
    cut = pa.Table.from_batches(parts)
    assert np.unique(cut["h"].to_numpy(), return_counts=True)[1].max() <= 2  # once a batch
    ranges = pa.Table.from_batches(sd._shard_ranges(cut.sort_by([(c, "ascending") for c in ("h", "c", "ord", "key", "start")]).to_batches(max_chunksize=50)))
    gone = np.zeros((n, len(texts[0])), bool)
    for r in ranges.to_pylist():
        gone[r["ord"], r["start"]:r["end"]] = True
    want = slow(list(enumerate(texts)))
    assert all((gone[i] == want[i, t]).all() for i, t in enumerate(texts))


def test_empty_table_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a" * 300, "h", 1), (2, "b", None, 2)], "doc_id long, text string, h string, ord int")
    assert {r.doc_id: r.n_removed for r in sd.deduplicate(frame).collect()} == {1: 299, 2: 0}
    assert sd.deduplicate(frame.limit(0)).collect() == []


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(200):
        k = int(rng.integers(1, 4))
        strings = [bytes(rng.integers(97, 97 + k, int(rng.integers(0, 30))).astype(np.uint8)) for _ in range(int(rng.integers(1, 8)))]
        text, _ = suffixes.join(strings)
        listed = text.tolist()
        assert suffixes.suffix_array(text, 10**6).tolist() == sorted(range(len(listed)), key=lambda i: listed[i:])
        near = suffixes.suffix_array(text, 8)
        assert [listed[i:i + 8] for i in near] == sorted(listed[i:i + 8] for i in range(len(listed)))
        places = np.arange(len(text))
        before, common = suffixes.permuted_prefixes(text, near, places, 8)
        rank = np.empty(len(text), int)
        rank[near] = places
        for i in places:
            if rank[i] == 0:
                assert before[i] == -1
            else:
                assert before[i] == near[rank[i] - 1]
                if i + 8 < len(text) and before[i] + 8 < len(text) and suffixes.STOP not in listed[i:i + 8] and suffixes.STOP not in listed[before[i]:before[i] + 8]:
                    assert (common[i] >= 8) == (listed[i:i + 8] == listed[before[i]:before[i] + 8])
