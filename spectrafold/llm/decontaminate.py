"""Benchmark decontamination by winnowing: fingerprints of word k-grams are joined, hits are extended word by word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.batches import LOWER, WORD_BYTES, chunks, filled, flat, mix, narrow, released, rows_of, span_hashes, spans, window_min
from spectrafold.session import materialize

#: Words of a window; a shared span of so many words is always found.
WINDOW = 10
#: Words of a fingerprinted k-gram. Every WINDOW words hold WINDOW - K + 1 of them, of which the least hash is kept.
K = 5
#: Bits of the filter that is broadcast: this many for each benchmark fingerprint, within the two bounds.
FILTER_BITS_EACH, FILTER_BITS_LEAST, FILTER_BITS_MOST = 512, 1 << 20, 1 << 26

_CANDIDATE = "hash long, pos int, before array<string>, after array<string>"


def _gram_hashes(words: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k-gram at each word, and whether it lies within its row (ends: end of the row of each word)."""
    n = len(words)
    grams, fits = np.zeros(n, np.uint64), np.arange(n) + k <= ends
    if n >= k:
        total = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            total += mix(words[j:n - k + 1 + j] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64)))
        grams[:n - k + 1] = mix(total + np.uint64(k))
    return grams, fits


def winnow(grams: np.ndarray, fits: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Positions whose k-gram has the least hash of some *width* neighbouring k-grams of its row (all ties; a row with
    fewer k-grams keeps its least). Equal spans of *width* k-grams keep equal positions, whatever stands around them."""
    grams = np.where(fits, grams, np.uint64(2**64 - 1))
    n = len(grams)
    least = window_min(np.r_[grams, np.full(width - 1, 2**64 - 1, np.uint64)], width)  # of grams[i : i + width]
    last = np.minimum(np.arange(n) + width - 1, n - 1)
    inside = (row[last] == row) & fits[last]
    kept = np.zeros(n, bool)
    for j in range(min(width, n)):
        kept[j:] |= inside[:n - j] & (grams[j:] == least[:n - j])
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if n else np.zeros(0, np.int64)
    if n:  # rows with fewer k-grams have no full window
        count = np.add.reduceat(fits.astype(np.int64), first)
        low = np.minimum.reduceat(grams, first)
        short = (count > 0) & (count < width)
        lens = np.diff(np.r_[first, n])
        kept |= np.repeat(short, lens) & fits & (grams == np.repeat(low, lens))
    return np.flatnonzero(kept & fits)


def _words(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(bytes in lower case, start, end, row, first word of the row, end word of the row) of all words."""
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends = spans(data, offsets, WORD_BYTES)
    row = rows_of(starts, offsets)
    count = np.bincount(row, minlength=len(texts))
    stop = np.cumsum(count)
    return data, starts, ends, row, (stop - count)[row], stop[row], count


def _fingerprint_rows(batches: Iterable[pa.RecordBatch], classes: list[tuple[int, int]], seen: np.ndarray | None, ids: str, base: bool) -> Iterator[pa.RecordBatch]:
    """Rows of (ids..., n_words, hash, pos, before, after): a row for each k-gram kept, and first, if *base*, one for the text.

    classes: (k, width) pairs; seen: bits of the benchmark's hashes; other k-grams of the documents can't match.
    """
    for batch in batches:
        texts = filled(batch.column("text"), "")
        for low, high in chunks(texts):
            part = texts.slice(low, high - low)
            data, starts, ends, row, first, stop, count = _words(part)
            hashes = span_hashes(data, starts, ends)
            at, found = [], []
            for k, width in classes:
                grams, fits = _gram_hashes(hashes, stop, k)
                kept = winnow(grams, fits, row, width) if width > 1 else np.flatnonzero(fits)
                if seen is not None:
                    slot = grams[kept] & np.uint64(len(seen) * 8 - 1)
                    kept = kept[(seen[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                at.append(kept)
                found.append(grams[kept])
            at, found = np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.uint64)])
            raw = data.tobytes()

            def text(a: int, b: int) -> list[str]:
                return [raw[s:e].decode() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]

            before = [text(max(f, i - WINDOW + K), i)[::-1] for f, i in zip(first[at].tolist(), at.tolist())]
            after = [text(i, min(e, i + WINDOW)) for e, i in zip(stop[at].tolist(), at.tolist())]
            source, pos, values = row[at], at - first[at], found.view(np.int64)
            if base:
                n = high - low
                spread = batch.column("key").slice(low, n).to_numpy()
                source, pos = np.r_[np.arange(n), source], np.r_[np.full(n, -1), pos]
                values, before, after = np.r_[spread, values], [None] * n + before, [None] * n + after
            rows = batch.slice(low, high - low).take(pa.array(source))
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [rows.column(ids), rows.column("key"), pa.array(count[source]), pa.array(values), pa.array(pos, pa.int32()),
                 pa.array(before, kind), pa.array(after, kind)],
                names=[ids, "key", "n_words", "hash", "pos", "before", "after"])


def _prefix(a: Column, b: Column) -> Column:
    """How many leading entries of two arrays are equal."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differ == 0, F.greatest(F.size(a), F.size(b))).otherwise(differ - 1).cast("int")


def benchmark_fingerprints(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(hash, pos, before, after, need, items): fingerprints of the items, items of one text together.

    need: words that have to agree, WINDOW or those of a shorter item. Items without words have no fingerprint.
    """
    items = benchmark.select(F.col(f"`{id_column}`").alias("item_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    items = items.filter("text is not null").groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    items = items.select("text", "items", F.xxhash64("text").alias("key"))

    def of(classes):
        def run(batches):
            return _fingerprint_rows(batches, classes, None, "items", False)
        return run

    schema = f"items array<{benchmark.schema[id_column].dataType.simpleString()}>, key long, n_words long, {_CANDIDATE}"
    fps = items.mapInArrow(of([(K, WINDOW - K + 1)]), schema).filter(f"n_words >= {WINDOW}")
    for k in range(1, K + 1):
        size = f"n_words = {k}" if k < K else f"n_words between {K} and {WINDOW - 1}"
        fps = fps.unionByName(items.mapInArrow(of([(k, 1)]), schema).filter(f"pos = 0 and {size}"))
    return fps.select("hash", "pos", "before", "after", F.least("n_words", F.lit(WINDOW)).cast("int").alias("need"), "items")


def _bits(fps: DataFrame) -> np.ndarray:
    """A bit filter of all hashes; its size follows their number but has a bound, beyond which it only lets more pass."""
    n = fps.count()
    bits = 1 << int(np.clip(np.ceil(np.log2(max(1, n * FILTER_BITS_EACH))), np.log2(FILTER_BITS_LEAST), np.log2(FILTER_BITS_MOST)))
    octets = fps.select(F.col("hash").bitwiseAND(F.lit(bits - 1)).alias("slot")).select(
        F.shiftright("slot", 3).cast("int").alias("at"), F.expr("shiftleft(1, cast(slot & 7 as int))").alias("bit"))
    found = octets.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[found["at"].to_numpy()] = found["bit"].to_numpy().astype(np.uint8)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, key, n_words, n_hit, items, spans) of every document: what it shares with benchmark items.

    A window is WINDOW consecutive words of an item (all words of a shorter one); document words inside an occurrence are
    hit. items: ids of items with an occurring window; spans: word ranges (end exclusive) of the occurrences. Winnowing
    (least hash of each WINDOW - K + 1 neighbouring K-grams) keeps a common fingerprint of every shared window; joined
    fingerprints are extended by comparing words, so no hash decides alone. key is a hash of id and text: repeated rows
    with one id and different texts stay apart, equal rows give as many equal rows. Null and empty texts have no words and
    no hits; a null id is kept. An empty benchmark gives documents without hits.

    The bit filter that tasks get has at most 8 MB whatever the benchmark's size; the join deals both sides by hash and
    splits a hot one (adaptive execution), as a passage that very many documents share has few fingerprints.
    """
    fps = materialize(benchmark_fingerprints(benchmark, item_id, item_text))
    seen = _bits(fps)
    kept = [r[0] for r in fps.filter(f"need < {WINDOW}").select(F.least("need", F.lit(K))).distinct().collect()]
    classes = [(K, WINDOW - K + 1), *((k, 1) for k in sorted(kept))]
    texts = narrow(docs, id_column, text_column).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        return _fingerprint_rows(batches, classes, seen, "doc_id", True)

    rows = texts.mapInArrow(released(run), f"doc_id {kind}, key long, n_words long, {_CANDIDATE}")
    items = fps.select("hash", *[F.col(c).alias(f"i_{c}") for c in ("pos", "before", "after")], "need", "items")
    met = rows.join(items, "hash", "left")
    left, right = _prefix(F.col("before"), F.col("i_before")), _prefix(F.col("after"), F.col("i_after"))
    left = F.when(F.col("need") < WINDOW, 0).otherwise(left)
    run_ = F.least(left + right, F.when(F.col("need") < WINDOW, F.col("need")).otherwise(F.lit(2 * WINDOW)))
    met = met.withColumn("left", F.when(F.col("pos") >= 0, left)).withColumn("run", F.when(F.col("pos") >= 0, run_))
    hit = F.col("run") >= F.col("need")
    begin = F.col("pos") - F.col("left")
    met = met.select("doc_id", "key", "n_words", "pos", F.when(hit, F.struct(begin.alias("start"), (begin + F.col("run")).alias("end"))).alias("span"),
                     F.when(hit, F.col("items")).alias("items"))
    found = met.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.sum(F.when(F.col("pos") < 0, 1).otherwise(0)).alias("rows"),
                                             F.sort_array(F.collect_set("span")).alias("spans"),
                                             F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["to"], x["end"]).alias("to"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["to"], x["start"]))).alias("n")),
        lambda s: s["n"])
    found = found.select("doc_id", "key", "n_words", covered.alias("n_hit"), "items", "spans", "rows")
    return found.withColumn("row", F.explode(F.expr("array_repeat(0, cast(rows as int))"))).drop("row", "rows")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **names) -> DataFrame:
    """The rows of *docs* without a benchmark window, all columns as they are; repeated rows stay."""
    hits = contamination(docs, benchmark, id_column, text_column, **names).filter("n_hit > 0").select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    same = F.col(f"`{id_column}`").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`").cast("string")) == F.col("_key"))
    return docs.join(hits, same, "left_anti")
