import sys

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from spectrafold.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(RANKS, P.PATTERN)


def random_texts(seed, n=300):
    rng = np.random.default_rng(seed)
    common = list("etaoinshr dlu,.\n'AZ09  ") + ["the ", "ing", "é", "ß", "中", "😀", "\x00", " ", "\x1c", "\x85", " ", "́", "'s", "'ll"]
    for size in rng.integers(0, 120, n):
        yield "".join(rng.choice(common, size))


@pytest.mark.parametrize("seed", range(4))
def test_like_the_library(vocabulary, seed):
    for text in random_texts(seed):
        ids = np.frombuffer(vocabulary.encoder()(text), "<u4")
        assert ids.tolist() == REFERENCE.encode_ordinary(text)
        assert vocabulary.decoder()(ids) == text


def test_every_character(vocabulary):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(points), 4096):
        text = "".join(f"a{c} {c}1" for c in points[low:low + 4096])
        assert np.frombuffer(vocabulary.encoder()(text), "<u4").tolist() == REFERENCE.encode_ordinary(text)


def test_long_pieces_and_small_tables(monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 150)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 40)
    monkeypatch.setattr(bpe, "MAX_WORDS", 5)
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    encoder = bpe.Encoder(RANKS, P.PATTERN)
    rng = np.random.default_rng(1)
    for text in ("a" * 5000, "".join(rng.choice(list("abcdefgh"), 4000)), " " * 3000 + "x", "=" * 1000, "1" * 999, "aaé" * 700):
        assert np.frombuffer(encoder(text), "<u4").tolist() == REFERENCE.encode_ordinary(text)


def test_pieces_of_all_tokens(vocabulary):
    machine = vocabulary.encoder().machine
    rng = np.random.default_rng(2)
    tokens = list(RANKS)
    for a, b in rng.integers(0, len(tokens), (1500, 2)):
        word = tokens[a] + tokens[b]
        assert machine.encode(word) == REFERENCE._encode_single_piece(word)


def test_streaming_decoder(vocabulary):
    decoder = vocabulary.decoder()
    text = "aé中😀z" * 40
    ids = np.frombuffer(vocabulary.encoder()(text), "<u4")
    for step in (1, 2, 3, 7):
        assert "".join(decoder.stream(ids[i:i + step] for i in range(0, len(ids), step))) == text
    rng = np.random.default_rng(3)
    single = np.array([RANKS[bytes((b,))] for b in range(256)], "<u4")
    for _ in range(300):
        raw = rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xE1, 0xED, 0xF0, 0xF1, 0xF4, 0x9F, 0xA0, 0xFF, 0xC0], 12).astype(np.uint8)
        assert decoder(single[raw]) == bytes(raw).decode("utf-8", "replace")
        assert "".join(decoder.stream(single[raw][i:i + 1] for i in range(12))) == bytes(raw).decode("utf-8", "replace")


def test_other_properties_use_the_other_matcher():
    assert bpe.plain_pattern(r"\p{Lu}+|\p{Ll}+|.") is None
    assert bpe.plain_pattern(P.PATTERN).findall("Ab 12\xa0 é's") == ["Ab", " 12", "\xa0", " é", "'s"]


def test_table(spark):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", "y"), (4, "w " * 20_000, None), (4, "w " * 20_000, None), (None, "é", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(frame, PATH, P.PATTERN), PATH).collect()
    assert sorted(((r.doc_id, r.decoded, np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens) for r in out), key=repr) == sorted(
        ((i, t or "", REFERENCE.encode_ordinary(t or ""), len(REFERENCE.encode_ordinary(t or ""))) for i, t, _ in rows), key=repr)
    assert bpe.encode(frame.limit(0), PATH, P.PATTERN).collect() == []
