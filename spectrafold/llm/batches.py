"""Arrow batches of texts as flat byte arrays: the vectorized basis of the operators that run numpy inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are held as numpy arrays at a time; a single longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes handed on after which unused memory is given back.
RELEASE_BYTES = 1 << 25


def narrow(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only the two columns an operator needs, named ``doc_id`` and ``text``: extra columns can't clash."""
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))


def filled(column: pa.Array, value: str | bytes) -> pa.Array:
    """*column* with *value* for nulls; without nulls it is not copied."""
    return pc.fill_null(column, value) if column.null_count else column


def released(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """*run* for mapInArrow, giving memory that Arrow keeps for later back to the system after each batch it has handed on."""
    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, size = pa.default_memory_pool(), 0
        for out in run(batches):
            size += out.nbytes
            yield out
            if size > RELEASE_BYTES:
                pool.release_unused()
                size = 0
        pool.release_unused()

    return wrapped


def map_texts(docs: DataFrame, fn: Callable[[pa.Array], dict], schema: str, text_column: str = "text",
              keep_text: bool = False) -> DataFrame:
    """Adds to each row the columns that *fn* computes from its text (null: empty), batch by batch.

    *fn(texts)* gets an Arrow string array without nulls and returns a dict of columns of the same length; *schema* lists
    the added columns. The text itself is returned only with *keep_text*.
    """
    kept = [c for c in docs.columns if keep_text or c != text_column]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(text_column), "")
            for low, high in chunks(texts):
                added = fn(texts.slice(low, high - low))
                part = batch.slice(low, high - low)
                columns = {c: part.column(c) for c in kept} | added
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()],
                                                 names=list(columns))

    return docs.mapInArrow(released(run), f"{fields}, {schema}" if kept else schema)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without nulls; offsets has one entry more than rows."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most *limit* bytes each, or of a single row."""
    if not len(texts):
        return
    ends = flat(texts)[1][1:]
    low, n = 0, len(texts)
    while low < n:
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield low, high
        low = high


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of bytes that *table* (256 booleans) admits; none crosses a row."""
    inside = table[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begin[first], stop[last] = inside[first], inside[last]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each position lies in."""
    return np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each non-empty span (spans ordered and disjoint)."""
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    before = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    values = BYTE_VALUES[data[within + np.repeat(starts, lengths)]] * powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(values, before) + lengths.astype(np.uint64))


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each full window of *width* entries, by doubling."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


#: Bytes of words once A-Z are lower-cased: digits, a-z and everything that is not ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
