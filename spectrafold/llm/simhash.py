"""SimHash near-duplicates: fingerprints, links of at most four differing bits by pigeonhole blocks, classes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.batches import map_texts, narrow
from spectrafold.llm.components import connected_components
from spectrafold.session import materialize

SHINGLE = 4
MAX_BITS = 4
#: The fingerprint is cut into this many blocks; pairs of at most MAX_BITS differing bits agree on SAME of them.
BLOCKS = 6
SAME = BLOCKS - MAX_BITS
SEED = 42
#: A bucket with more fingerprints is dealt out anew, by the blocks of the bits that its own block doesn't fix.
HOT_BUCKET = 1 << 16
_ALL = (1 << 64) - 1


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text (see :func:`fingerprints`)."""
    words = text.encode().lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - shingle + 1)
    ends = starts[min(shingle, len(words)):]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for low in range(0, n, 1 << 14):
        part = [digest(body[a:b - 1], SEED) for a, b in zip(starts[low:low + (1 << 14)], ends[low:low + (1 << 14)])]
        octets = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_column(texts: pa.Array, shingle: int = SHINGLE) -> dict:
    return {"fp": np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64).view(np.int64)}


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row: a bit is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42).

    A-Z are lower-cased, words are runs without ASCII white space, shingles are *shingle* words (repeats count; the whole
    sequence if it is shorter). No words, empty or null: zero. Repeated rows stay.
    """
    return map_texts(narrow(docs, id_column, text_column), partial(_fingerprint_column, shingle=shingle), "fp long")


def block_masks(free: int, blocks: int = BLOCKS, same: int = SAME) -> list[int]:
    """Masks of every choice of *same* blocks out of *blocks* nearly equal ones of the bits of *free*."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    cut = [sum(int(b) for b in part) for part in np.array_split(np.array(bits, object), min(blocks, len(bits)))]
    if len(cut) < blocks:
        return [0]
    return [sum(c) for c in combinations(cut, same)]


def links(fps: np.ndarray, max_bits: int = MAX_BITS, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect distinct fingerprints exactly as the links of at most *max_bits* differing bits do.

    Each class is searched from its first member: whoever is close to a member found joins and leaves the rest, so a dense
    class costs little more than its size, and a star comes out of it, never all pairs.
    """
    rest, found = fps, []
    while len(rest):
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            step = max(1, cells // len(rest))
            near = np.zeros(len(rest), bool)
            for low in range(0, len(front), step):
                near |= (np.bitwise_count(front[low:low + step, None] ^ rest[None, :]) <= max_bits).any(axis=0)
            front, rest = rest[near], rest[~near]
            found.append((front, np.full(len(front), root)))
    return np.concatenate([a for a, _ in found] or [fps[:0]]), np.concatenate([b for _, b in found] or [fps[:0]])


def _bucket_edges(batches: Iterable[pa.RecordBatch], max_bits: int, lags: int = 16) -> Iterator[pa.RecordBatch]:
    """Edges within each bucket (rows sorted by mask and block); a bucket may go over batches."""
    held: list[tuple[np.ndarray, ...]] = []

    def edges(mask: np.ndarray, block: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((np.diff(mask) != 0) | (np.diff(block) != 0)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(fp)]
        size, left, right = ends - starts, [], []
        few = np.repeat(size <= lags, size)
        small, group = fp[few], np.repeat(np.arange(len(size)), size)[few]
        for lag in range(1, min(lags, len(small))):
            near = (group[lag:] == group[:-lag]) & (np.bitwise_count(small[lag:] ^ small[:-lag]) <= max_bits)
            left.append(small[lag:][near])
            right.append(small[:-lag][near])
        for i in np.flatnonzero(size > lags):
            a, b = links(fp[starts[i]:ends[i]], max_bits)
            left.append(a)
            right.append(b)
        a, b = (np.concatenate(x or [fp[:0]]).view(np.int64) for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("mask", "block", "fp")))
        mask, block, _ = held[-1]
        change = np.flatnonzero((mask != mask[-1]) | (block != block[-1]))
        if not len(change) and (len(held) == 1 or (held[-2][0][-1] == mask[-1] and held[-2][1][-1] == block[-1])):
            continue  # all of one bucket so far
        whole = change[-1] + 1 if len(change) else 0
        rest = tuple(x[whole:] for x in held[-1])
        held[-1] = tuple(x[:whole] for x in held[-1])
        yield edges(*(np.concatenate(x) for x in zip(*held)))
        held = [rest]
    if held:
        yield edges(*(np.concatenate(x) for x in zip(*held)))


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("mask"))
    return keyed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("block"), "fp")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_edges(fps: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b): edges whose components are those of the distinct fingerprints *fps* (fp) linked at MAX_BITS or fewer bits.

    Close pairs agree on two of six blocks, so they meet in one of the 15 buckets that each fingerprint goes to; buckets are
    verified by Hamming distance. A bucket of over *hot_bucket* fingerprints is dealt again by the blocks of the bits that
    it leaves free (15 times as many rows, 128 or more times as many buckets), which spreads it over all tasks.
    """
    masks = block_masks(_ALL)
    counted = _keyed(fps, masks).selectExpr("*", "count(1) over (partition by mask, block) as size")

    def run(batches):
        return _bucket_edges(batches, MAX_BITS)

    cold = counted.filter(f"size between 2 and {hot_bucket}").select("mask", "block", "fp").sortWithinPartitions("mask", "block")
    finer = [(m, sub) for m in masks for sub in block_masks(_ALL & ~m)]
    pairs = F.array(*[F.struct(F.lit(_signed(m)).cast("long").alias("m"), F.lit(_signed(m | s)).cast("long").alias("deep")) for m, s in finer])
    hot = counted.filter(f"size > {hot_bucket}").select("fp", "mask").select(
        "fp", F.explode(F.transform(F.filter(pairs, lambda p: p["m"] == F.col("mask")), lambda p: p["deep"])).alias("mask"))
    hot = hot.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("block"), "fp").distinct()
    hot = hot.selectExpr("*", "count(1) over (partition by mask, block) as size").filter("size > 1")
    hot = hot.select("mask", "block", "fp").sortWithinPartitions("mask", "block")
    found = cold.mapInArrow(run, "a long, b long").unionByName(hot.mapInArrow(run, "a long, b long"))
    return found.distinct()


def _classes(prints: DataFrame) -> DataFrame:
    """The rows of *prints* (fp, ...) with the root fingerprint of their class."""
    nodes = prints.select("fp").distinct()
    roots = connected_components(near_edges(nodes), "a", "b").withColumnRenamed("node", "fp")
    return prints.join(nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "fp")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the least doc_id that links of at most four bits reach.

    Rows of one fingerprint are one node from the start, so copies make no pairs. Rows with a null id stay; they have the
    least id of the others in their class, or null if there is none. Empty and null texts have fingerprint zero and are
    linked like others; repeated rows stay. An empty table gives an empty table.
    """
    prints = materialize(fingerprints(docs, id_column, text_column))
    placed = _classes(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each class of near-duplicates, with the columns of *docs*: that of the least id.

    A row is known by its id and a hash of all its columns (but maps), so several rows of one id with different texts stand
    for their own classes, and the choice among them is the same whenever it is made. A row with a null id stands for a
    class only if no other has an id. Of rows that agree in all columns one stays.
    """
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    keyed = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"), F.xxhash64(*hashed).alias("_key"))
    prints = materialize(map_texts(keyed, _fingerprint_column, "fp long"))
    first = _classes(prints).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key"))).alias("_first"))
    first = first.select(F.col("_first.doc_id").alias("_kept_id"), F.col("_first._key").alias("_kept_key"))
    marked = docs.withColumn("_key", F.xxhash64(*hashed))
    same = F.col(f"`{id_column}`").eqNullSafe(F.col("_kept_id")) & (F.col("_key") == F.col("_kept_key"))
    return marked.join(first, same, "left_semi").dropDuplicates([id_column, "_key"]).drop("_key")
