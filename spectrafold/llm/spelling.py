"""Spelling variants: words at edit distance one, found through lists of variable-length grams, and the form each stands for."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.batches import LOWER, chunks, filled, flat, narrow, released, rows_of, spans
from spectrafold.session import materialize

#: Words are counted from this length, listed from this number of occurrences; a form is this many times as frequent.
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Lengths of grams. A word of MIN_LENGTH has, with its marks, MIN_LENGTH + 1 grams; one edit affects at most GRAM_MOST.
GRAM_LEAST, GRAM_MOST = 2, 6
#: A gram with more occurrences than this, or than lets the dictionary exceed DICTIONARY entries, is lengthened.
FREQUENT, DICTIONARY = 64, 1 << 19
#: A list of more words is dealt out anew by halves of its words.
LONG_LIST = 20_000
#: Bytes of rows that a task hands on at a time.
BATCH_BYTES = 1 << 23
#: One run in so many (by its hash) loses a code point.
DAMAGE = 199
_RUN = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF (0xC3 and its second byte) in UTF-8."""
    lead = data == 0xC3
    out = _RUN[data] | lead
    out[1:] |= lead[:-1]
    return out


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", damage: int = DAMAGE) -> DataFrame:
    """(word string, n long) of all runs of letters in all texts, A-Z lower-cased, of MIN_LENGTH code points or more.

    Where *damage* divides the crc32 of ``<id>:<run>`` the run first loses its code point crc32 % length (a null id is
    empty text). Null and empty texts have no runs. Batches count first; what is shuffled is a row for each word and batch.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = filled(batch.column("text"), ""), filled(batch.column("doc_id"), "").to_pylist()
            for low, high in chunks(texts):
                data, offsets = flat(texts.slice(low, high - low))
                starts, ends = spans(_letters(data).astype(np.uint8), offsets, np.array([False, True]))
                row, sizes = rows_of(starts, np.maximum.accumulate(offsets)), ends - starts
                before = np.cumsum(sizes) - sizes
                joined = LOWER[data[np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)]]
                cuts = pa.py_buffer(np.r_[before, sizes.sum()].astype(np.int64).tobytes())
                found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, cuts, pa.py_buffer(joined.tobytes())]).dictionary_encode()
                words, total = found.dictionary.to_pylist(), max(1, len(found.dictionary))
                pairs, times = np.unique(row * total + found.indices.to_numpy(zero_copy_only=False), return_counts=True)
                lead, code = [zlib.crc32(f"{i}:".encode()) for i in ids[low:high]], pairs % total
                crc32 = zlib.crc32
                hashes = np.array([crc32(words[w], lead[r]) for r, w in zip((pairs // total).tolist(), code.tolist())], np.int64)
                hit = hashes % damage == 0
                counts = dict(zip(words, np.bincount(code[~hit], times[~hit], total).astype(np.int64).tolist()))
                for w, h, n in zip(code[hit].tolist(), hashes[hit].tolist(), times[hit].tolist()):
                    whole = words[w].decode()
                    short = (whole[:h % len(whole)] + whole[h % len(whole) + 1:]).encode()
                    counts[short] = counts.get(short, 0) + n
                kept = [(w.decode(), n) for w, n in counts.items() if n and len(w) >= MIN_LENGTH and len(w.decode()) >= MIN_LENGTH]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    texts = narrow(docs, id_column, text_column).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return texts.mapInArrow(released(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame, frequent: int = FREQUENT, entries: int = DICTIONARY) -> dict[str, int]:
    """Grams of GRAM_LEAST to GRAM_MOST characters of the marked *words* that occur more than a bound, with their number.

    The bound is *frequent*, or all occurrences over *entries* if that is more: so there are never more than *entries*.
    With a gram all its beginnings are frequent, too.
    """
    lengths = range(GRAM_LEAST, GRAM_MOST + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, int] = {}
            for w in batch.column("word").to_pylist():
                w = f"^{w}$"
                for q in lengths:
                    for i in range(len(w) - q + 1):
                        g = w[i:i + q]
                        counts[g] = counts.get(g, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

    total = words.agg(F.sum(F.length("word") * len(lengths))).first()[0] or 0
    bound = max(frequent, -(-total // entries))
    grams = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > bound)
    return {r.gram: r.n for r in grams.collect()}


def decompose(word: str, frequent: dict[str, int]) -> tuple[list[str], int]:
    """The grams of a marked word, one from each place but the last, and how many of them one edit affects at most.

    A gram is lengthened while it is frequent, up to GRAM_MOST, so it depends on its own characters alone: an edit changes
    just the grams that it lies in. A word near this one has all the others, left of the edit as far from the beginning,
    right of it as far from the end.
    """
    n, grams, ends = len(word), [], []
    for p in range(n - 1):
        e = p + GRAM_LEAST
        while e < n and e - p < GRAM_MOST and word[p:e] in frequent:
            e += 1
        grams.append(word[p:e])
        ends.append(e)
    change = [0] * (n + 1)
    for p, e in enumerate(ends):  # a letter at p to e - 1
        change[p] += 1
        change[e] -= 1
    most = within = 0
    for i in range(n - 1):
        within += change[i]
        if i:
            most = max(most, within)
    return grams, max(most, sum(e == n for e in ends[:-1]))  # the latter: an insertion before the end mark


def listed(word: str, frequent: dict[str, int]) -> list[tuple[str, int]]:
    """(gram, place) of the shortest lists that must be merged for *word*: near words share at least |grams| - affected of
    them, so they meet in one of the affected + 1 rarest of either (equally rare ones in the order of grams and places)."""
    grams, affected = decompose(word, frequent)
    by = sorted((frequent.get(g, 0), g, p) for p, g in enumerate(grams))
    return [(g, p) for _, g, p in by[:affected + 1]]


def _rows(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches (gram, size, place, longer, word) of bounded size."""
    names, kinds = ("gram", "size", "place", "longer", "word"), (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 60 + len(row[0]) + len(row[4])
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names=names)


def _lists(words: Iterable[str], frequent: dict[str, int]) -> Iterator[tuple]:
    """(gram, size, place, longer, word): a word is in its own lists, and, to meet words one longer, in theirs."""
    for word in words:
        size = len(word)
        for g, p in listed(f"^{word}$", frequent):
            yield from ((g, size, p, False, word), (g, size + 1, p, True, word), (g, size + 1, p + 1, True, word))


def _halves(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows of long lists once for each half that a near word must have: one edit leaves the first or the last one whole."""
    for g, size, p, longer, word in rows:
        for short, kind in [(size - 1, "+")] if longer else [(size, "="), (size - 1, "+")]:  # words of one length, or with those one shorter
            h = short // 2
            yield f"{g} {kind}{word[:h]}<", size, p, longer, word
            yield f"{g} {kind}>{word[len(word) - (short - h):]}", size, p, longer, word


def _matrix(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def near_pairs(own: list[str], shorter: list[str]) -> set[tuple[str, str]]:
    """Pairs at distance one among distinct words *own* of one length, and of them with *shorter* ones of one letter less.

    Few words are compared directly; of more, those are compared that agree once a column is left out, found by sorting.
    """
    out: set[tuple[str, str]] = set()
    if not own or len(own) + len(shorter) < 2:
        return out
    a, b = _matrix(own), _matrix(shorter) if shorter else np.zeros((0, len(own[0]) - 1), np.uint8)
    width = a.shape[1]
    if len(own) * (len(own) + len(shorter)) * width <= 1 << 16:
        i, j = np.nonzero(np.triu((a[:, None, :] != a[None, :, :]).sum(axis=2) == 1))
        out.update((own[x], own[y]) for x, y in zip(i.tolist(), j.tolist()))
        if shorter:
            left, right = a[:, None, :-1] == b[None, :, :], a[:, None, 1:] == b[None, :, :]
            lead, tail = np.minimum.accumulate(left, axis=2).sum(axis=2), np.minimum.accumulate(right[:, :, ::-1], axis=2).sum(axis=2)
            i, j = np.nonzero(lead + tail >= width - 1)
            out.update((own[x], shorter[y]) for x, y in zip(i.tolist(), j.tolist()))
        return out
    kind = np.dtype((np.void, max(1, width - 1)))
    tails = np.ascontiguousarray(b).view(kind).ravel()
    for column in range(width):
        cut = np.ascontiguousarray(np.delete(a, column, axis=1)).view(kind).ravel()
        every = np.concatenate([cut, tails])
        code = np.unique(every, return_inverse=True)[1].ravel()
        by = np.argsort(code, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(code[by])) + 1):
            if len(group) > 1:
                mine, theirs = [own[x] for x in group if x < len(own)], [shorter[x - len(own)] for x in group if x >= len(own)]
                out.update((x, y) for k, x in enumerate(mine) for y in mine[k + 1:])
                out.update((x, y) for x in mine for y in theirs)
    return out


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of each list, of rows sorted by list; a list may go over batches."""
    held: tuple | None = None
    own: set[str] = set()
    shorter: set[str] = set()

    def pairs(found: set[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], names=["a", "b"])

    for batch in batches:
        found: set[tuple[str, str]] = set()
        for *key, longer, word in zip(*(batch.column(c).to_pylist() for c in ("gram", "size", "place", "longer", "word"))):
            if tuple(key) != held:
                found |= near_pairs(sorted(own), sorted(shorter))
                held, own, shorter = tuple(key), set(), set()
            (shorter if longer else own).add(word)
        yield pairs(found)
    yield pairs(near_pairs(sorted(own), sorted(shorter)))


def near_words(words: DataFrame, frequent: int = FREQUENT, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b): every pair of *words* (word, distinct, MIN_LENGTH code points or more of the run alphabet) at distance one, once.

    Only lists that the bounds on affected grams leave are merged: two words near each other meet in at least one of them.
    A list is dealt by its gram, its place and the word's length. One of over *long_list* words is dealt out once more by
    the first and the last halves of its words (lists of different length by the halves of the shorter one), one of which
    near words share beside the gram; so no list is left out and none is searched pair by pair.
    """
    grams = frequent_grams(words, frequent)
    known = words.sparkSession.sparkContext.broadcast(grams)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(_lists((w for b in batches for w in b.column("word").to_pylist()), known.value))

    def halve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(_halves(row for b in batches for row in zip(*(b.column(c).to_pylist() for c in (*keys, "longer", "word")))))

    schema, keys = "gram string, size int, place int, longer boolean, word string", ["gram", "size", "place"]
    lists = words.select("word").mapInArrow(spread, schema)
    sizes = lists.groupBy(*keys).agg(F.count("*").alias("words"), F.count_if(~F.col("longer")).alias("own"))
    lists = materialize(lists.join(sizes.filter("own > 0 and words > 1"), keys))
    short, long = (lists.filter(c).select(*keys, "longer", "word") for c in (f"words <= {long_list}", f"words > {long_list}"))
    dealt = short.unionByName(long.mapInArrow(halve, schema)).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_merge, "a string, b string").distinct()


def variants(counts: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words in *counts* (word, n) with *min_count* occurrences or more.

    n_near counts the words at distance exactly one; form is the most frequent of them (ties: the first in code-point
    order) if it is at least *ratio* times as frequent, else null, as is form_n. root is where forms lead from the word, or
    the word itself. Forms grow by *ratio* each step, so they lead nowhere twice; they are followed by doubling.
    """
    words = materialize(counts.filter(F.col("n") >= min_count).select("word", "n"))
    pairs = near_words(words, **options)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    best = both.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best"))
    best = best.select(F.col("a").alias("word"), "n_near", F.col("best.b").alias("form"), (-F.col("best.less")).alias("form_n"))
    whole = words.join(best, "word", "left")
    formed = F.col("form_n") >= ratio * F.col("n")
    whole = materialize(whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("form")).alias("form"),
                                     F.when(formed, F.col("form_n")).alias("form_n")))
    roots = whole.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return whole.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
