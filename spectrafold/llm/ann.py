"""Nearest neighbours by collision counting: query-centred windows on sorted projections, widened by virtual rehashing."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Projections; a window at radius R takes what lies within WIDTH * R of the query's value.
PROJECTIONS, WIDTH = 128, 1.37
#: Radii (distances of unit vectors) that are tried in turn; at the last one everything is verified.
RADII = (0.25, 1.15, 1.3, 1.45, 2.0)
#: A vector at distance R misses the threshold of radius R with a chance of about 5 %; nearer ones seldom do.
SLACK = 1.65
#: Vectors in a block (a task's index), and queries that meet it at a time.
BLOCK_ROWS, QUERY_ROWS = 8192, 512
#: Bytes of packed queries that a task holds while blocks stream by, and streams at least (if there are as many blocks).
HELD_BYTES, STREAMS = 32 * 1024 * 1024, 64
#: Binary columns of a packed block: 64-bit integers, and vectors of doubles.
PACKED = ("ids", "tells", "copies", "vectors")


def _miss_rate(width: float) -> float:
    return math.erfc(width / math.sqrt(2))


#: Collisions that make a vector a candidate.
THRESHOLD = math.floor(PROJECTIONS * (1 - _miss_rate(WIDTH)) - SLACK * math.sqrt(PROJECTIONS * _miss_rate(WIDTH) * (1 - _miss_rate(WIDTH))))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two that brings the largest component to between 0.5 and 1: cosines stay, squares fit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


class Index:
    """A block of vectors with an array of ids, sorted by value, for each projection. *keys* tell rows of one id apart,
    *copies* say how many rows are equal in both; by default each id has one row."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keys: np.ndarray | None = None, copies: np.ndarray | None = None, seed: int = 17):
        vectors = _scaled(vectors)
        self.keys, self.copies = (np.zeros(len(ids), np.int64) if keys is None else keys), (np.ones(len(ids), np.int64) if copies is None else copies)
        self.ids, self.vectors, self.norms = ids, vectors, _norms(vectors)
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], PROJECTIONS))
        values = (vectors / self.norms[:, None]) @ self.lines
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(values.T, self.order, axis=1)

    def candidates(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Vectors that lie in enough of the windows low[j]:high[j] of the sorted arrays; the smaller side is counted."""
        n = len(self.ids)
        if 2 * int((high - low).sum()) <= n * PROJECTIONS:
            inside = np.concatenate([o[a:b] for o, a, b in zip(self.order, low.tolist(), high.tolist())])
            return np.flatnonzero(np.bincount(inside, minlength=n) >= THRESHOLD)
        outside = np.concatenate([part for o, a, b in zip(self.order, low.tolist(), high.tolist()) for part in (o[:a], o[b:])])
        return np.flatnonzero(np.bincount(outside, minlength=n) <= PROJECTIONS - THRESHOLD)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, query_keys: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, cosines) of the *k* nearest rows found of each query, its own row left out."""
        queries = _scaled(queries)
        norms, query_keys = _norms(queries), np.zeros(len(query_ids), np.int64) if query_keys is None else query_keys
        at = (queries / norms[:, None]) @ self.lines
        low, high = (np.stack([np.stack([np.searchsorted(s, at[:, j] + sign * WIDTH * r, side) for j, s in enumerate(self.sorted)], axis=1)
                               for r in RADII[:-1]]) for sign, side in ((-1, "left"), (1, "right")))
        for i, own in enumerate(query_ids):
            for level, radius in enumerate(RADII):
                found = self.candidates(low[level, i], high[level, i]) if level < len(RADII) - 1 and len(self.ids) > k else np.arange(len(self.ids))
                found = found[(self.ids[found] != own) | (self.keys[found] != query_keys[i]) | (self.copies[found] > 1)]
                score = (self.vectors[found] * queries[i]).sum(axis=1) / (self.norms[found] * norms[i])
                if level == len(RADII) - 1 or (2 - 2 * score <= radius * radius).sum() >= min(k, len(self.ids)):
                    break
            best = np.lexsort((self.ids[found], -score))[:k]
            rows = found[best]
            times = self.copies[rows] - ((self.ids[rows] == own) & (self.keys[rows] == query_keys[i]))
            best = np.repeat(best, np.minimum(times, k))[:k]
            yield int(own), self.ids[found[best]], score[best]


class Best:
    """The *k* nearest rows found so far of each of some queries, nearest first, ties by id."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, copies: np.ndarray, k: int):
        self.of, self.k = (ids, keys, copies), k
        self.near, self.score = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -np.inf)

    def add(self, found: Iterable[tuple[np.ndarray, np.ndarray]]) -> None:
        """*found*: (ids, cosines) of each query, in the order of the queries."""
        for i, (ids, score) in enumerate(found):
            ids, score = np.concatenate([self.near[i], ids]), np.concatenate([self.score[i], score])
            by = np.lexsort((ids, -score))[:self.k]
            self.near[i], self.score[i] = ids[by], score[by]

    def rows(self) -> pa.RecordBatch:
        at, place = np.nonzero(self.score > -np.inf)
        columns = [*(x[at] for x in self.of), self.near[at, place], self.score[at, place]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "tell", "copies", "vec_id", "score"])


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ids, tells, copies, vectors, all binary): a row for each group of bounded size, in the order of ids and tells."""
    def pack(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        whole = {c: part[c].to_numpy(np.int64) for c in ("id", "tell", "copies")}
        by = np.lexsort((whole["tell"], whole["id"]))
        vectors = np.stack(part["vector"].to_numpy())[by].astype("<f8")
        return pd.DataFrame([[*group, *(x[by].tobytes() for x in whole.values()), vectors.tobytes()]], columns=[*keys, *PACKED])

    fields = ", ".join([f"{k} long" for k in keys] + [f"{c} binary" for c in PACKED])
    return rows.groupBy(*keys).applyInPandas(pack, fields)


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which *queries* holds, its *k* nearest others by cosine.

    *queries* is a condition on the columns of *vectors*. Scores are exact, in double precision on the given vectors; ties
    go to the smaller id. Rows with a null id and vectors that are not :func:`usable` take no part; only vectors of the query's
    length are compared. With fewer than *k* others all are returned. Rows that share an id are rows of their own: candidates
    of each other, and each of them that is a query has its own *k* rows in the result.

    Equal rows are counted first; the others are dealt by a hash of id and vector into blocks of about BLOCK_ROWS. Blocks and
    packed queries meet where tasks read them: a task holds some queries and indexes the blocks of a stream one by one, and
    the queries' *k* best of the stream are ranked. What is shuffled grows with the rows, not with the pairs, and nothing is
    broadcast. A window holds what is within WIDTH * R of the query on a projection, for radius R in RADII; vectors in at
    least THRESHOLD windows are verified; the search of a block ends when *k* of them are within R.
    """
    given = vectors.withColumn("__query", F.coalesce(queries, F.lit(False)))
    rows = given.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"), "__query")
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("size", F.size("vector").cast("long"))
    rows = rows.groupBy("id", "vector", "size").agg(F.count("*").alias("copies"), F.max("__query").alias("__query")).withColumn("tell", F.xxhash64("vector"))
    counts = {r["size"]: (r["n"], r["q"]) for r in rows.groupBy("size").agg(F.count("*").alias("n"), F.count_if("__query").alias("q")).collect()}
    blocks, parts = ({s: max(1, -(-c[i] // most)) for s, c in counts.items()} for i, most in ((0, BLOCK_ROWS), (1, QUERY_ROWS)))

    def dealt(number: dict[int, int]) -> Column:
        pairs = [F.lit(x) for s, n in number.items() for x in (s, n)] or [F.lit(0).cast("long"), F.lit(1)]
        return F.pmod(F.xxhash64("id", "tell"), F.create_map(*pairs)[F.col("size")].cast("long"))

    data = _packed(rows.select("size", dealt(blocks).alias("block"), "id", "tell", "copies", "vector"), ["size", "block"])
    asked = _packed(rows.filter("__query").select("size", dealt(parts).alias("part"), "id", "tell", "copies", "vector"), ["size", "part"])
    streams = max(1, min(sum(blocks.values()), max(STREAMS, 2 * vectors.sparkSession.sparkContext.defaultParallelism)))
    shares = max(1, -(-sum(8 * (s + 3) * q for s, (_, q) in counts.items()) // HELD_BYTES))

    def spread(packed: DataFrame, by: str, n: int) -> DataFrame:
        return packed.repartitionById(n, F.pmod(F.col("size") + F.col(by), F.lit(n)).cast("int"))

    asked = spread(asked, "part", shares).select("size", "part", *[F.col(c).alias(f"q_{c}") for c in PACKED])
    met = spread(data, "block", streams).join(asked.hint("shuffle_replicate_nl"), "size")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, best = None, None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                size, block, part = (batch.column(c)[row].as_py() for c in ("size", "block", "part"))

                def read(side: str) -> list[np.ndarray]:  # copies, as views would keep the whole batch
                    return [np.frombuffer(batch.column(side + c)[row].as_buffer(), "<f8" if c == "vectors" else "<i8").copy() for c in PACKED]

                if held != (size, block):
                    ids, tells, copies, body = read("")
                    held, index = (size, block), Index(ids, body.reshape(-1, size), tells, copies)
                q_ids, q_tells, q_copies, q_body = read("q_")
                if (size, part) not in best:
                    best[size, part] = Best(q_ids, q_tells, q_copies, k)
                best[size, part].add(found for _, *found in index.search(q_ids, q_body.reshape(-1, size), k, q_tells))
        for some in best.values():
            yield some.rows()

    found = met.mapInArrow(run, "query_id long, tell long, copies long, vec_id long, score double")
    rank = "cast(row_number() over (partition by query_id, tell order by score desc, vec_id) as int) as rank"
    ranked = found.selectExpr("query_id", "copies", rank, "vec_id", "score").filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.expr("array_repeat(0, cast(copies as int))")).alias("copy")).drop("copy")
