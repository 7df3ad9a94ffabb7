"""Hard negatives by anchor spanning-tree bounds: scores at a parent anchor bound those at its children."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.session import materialize

#: Rows and bytes of vectors in a block at most, and anchors of a tree (all about: they are dealt by hash).
BLOCK_ROWS, BLOCK_BYTES, TREE_ANCHORS = 8192, 1 << 22, 256
#: Labels are dealt into at most so many cells, which blocks and trees don't cross.
CELLS = 1024
#: Columns of a packed block or tree; of an anchor also its positives.
PACKED = ("ids", "tells", "labels", "copies", "vectors")
_WIDTHS = {2: "<i2", 4: "<i4", 8: "<i8"}


def dot(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact integer inner products, kept within 64 bits."""
    most = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))) * max(abs(int(vector.max(initial=0))), abs(int(vector.min(initial=0)))) * max(1, len(vector))
    if most < 1 << 53:
        return (rows.astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return rows @ vector
    return np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in rows.astype(object) @ vector.astype(object)], np.int64)


def spanning_tree(vectors: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(node, parent, length) of a minimum spanning tree, parents first; the first node has parent -1."""
    x = vectors.astype(np.float64)
    squares = (x * x).sum(axis=1)
    near, parent, left = np.full(len(x), np.inf), np.full(len(x), -1), np.ones(len(x), bool)
    for k in range(len(x)):
        i = int(np.argmin(np.where(left, near, np.inf))) if k else 0
        left[i] = False
        # products of large components round: the length is taken anew from the difference
        yield i, int(parent[i]), float(np.sqrt(((x[i] - x[parent[i]]) ** 2).sum())) if k else 0.0
        far = np.sqrt(np.maximum(0, squares + squares[i] - 2 * (x @ x[i])))
        closer = left & ((far < near) | (parent < 0))
        near[closer], parent[closer] = far[closer], i


class Part:
    """A block of rows, or the anchors of a tree."""

    def __init__(self, size: int, ids: np.ndarray, tells: np.ndarray, labels: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        self.ids, self.tells, self.labels, self.copies, self.vectors = ids, tells, labels, copies, vectors.reshape(len(ids), size).astype(np.int64)
        x = self.vectors.astype(np.float64)
        self.norms = np.sqrt((x * x).sum(axis=1))

    def first(self, rows: np.ndarray, scores: np.ndarray, most: int, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best *most* among *rows*, each as often as it occurs; of the row *own* once less."""
        by = np.lexsort((self.ids[rows], -scores))[:most + 1]
        times = np.minimum(self.copies[rows[by]] - (rows[by] == own), most)
        by = np.repeat(by, times)[:most]
        return self.ids[rows[by]], scores[by]


def walk(anchors: Part, block: Part) -> Iterator[tuple[int, np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]]:
    """(anchor, low, high, rescore): bounds on its scores with all rows of *block*, and a function that gives the exact ones
    of some rows and tightens their bounds. |score(child) - score(parent)| is at most the edge times the row's norm, so
    bounds of a child start from its parent's; each rescored row starts from its exact score again."""
    low, high = (np.empty((len(anchors.ids), len(block.ids))) for _ in range(2))
    for i, parent, length in spanning_tree(anchors.vectors):
        round_off = 1e-12 * (anchors.norms[i] + length) * block.norms + 1e-6

        def rescore(rows: np.ndarray, i: int = i, round_off: np.ndarray = round_off) -> np.ndarray:
            exact = dot(block.vectors[rows], anchors.vectors[i])
            low[i, rows], high[i, rows] = exact - round_off[rows], exact + round_off[rows]
            return exact

        if parent < 0:
            rescore(np.arange(len(block.ids)))
        else:
            reach = length * (1 + 1e-9) * block.norms + round_off
            low[i], high[i] = low[parent] - reach, high[parent] + reach
        yield i, low[i], high[i], rescore


def _kth(x: np.ndarray, k: int) -> float:
    """The k-th largest."""
    return float(np.partition(x, len(x) - k)[len(x) - k])


def positives(anchors: Part, block: Part, k: int, tally: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, ids, scores): its *k* best others of one label in the block."""
    for i, low, high, rescore in walk(anchors, block):
        own = np.flatnonzero((block.ids == anchors.ids[i]) & (block.tells == anchors.tells[i]))
        own = int(own[0]) if len(own) else -1
        rows = np.flatnonzero(block.labels == anchors.labels[i])
        rows = rows[(rows != own) | (block.copies[rows] > 1)]
        if len(rows) > k:
            rows = rows[high[rows] >= _kth(low[rows], k)]
        if tally is not None:
            tally.append((len(rows), len(block.ids)))
        yield i, *block.first(rows, rescore(rows), k, own)


def negatives(anchors: Part, block: Part, windows: list[list[tuple[int, int]]], k: int, tally: list | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, number of the window, ids, scores): the *k* best rows of other labels with a score in the window, both ends
    included. Rows whose bounds overlap no window, or that *k* others surely beat in each, are not rescored."""
    for i, low, high, rescore in walk(anchors, block):
        other, needed = block.labels != anchors.labels[i], np.zeros(len(block.ids), bool)
        for a, b in set(windows[i]):
            over = other & (high >= a) & (low <= b)
            sure = low[over & (low >= a) & (high <= b)]
            needed |= over & (high >= _kth(sure, k)) if len(sure) > k else over
        rows = np.flatnonzero(needed)
        if tally is not None:
            tally.append((len(rows), len(block.ids)))
        scores = rescore(rows)
        for w, (a, b) in enumerate(windows[i]):
            inside = (scores >= a) & (scores <= b)
            yield i, w, *block.first(rows[inside], scores[inside], k)


def _packed(rows: DataFrame, keys: list[str], also: list[str]) -> DataFrame:
    """A row for each group of bounded size: (keys, PACKED, also), 64-bit integers and vectors of the least width as bytes."""
    def pack(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "tell"])
        vectors = np.stack([np.asarray(v, np.int64) for v in part["vector"]])
        fits = next(t for w, t in _WIDTHS.items() if w == 8 or (-(1 << 8 * w - 1) <= vectors.min(initial=0) and vectors.max(initial=0) < 1 << 8 * w - 1))
        whole = [part[c].to_numpy(np.int64).tobytes() for c in ("id", "tell", "label", "copies")]
        lists = [np.concatenate([[len(x), *x] for x in part[c]]).astype(np.int64).tobytes() for c in also]
        return pd.DataFrame([[*group, *whole, vectors.astype(fits).tobytes(), *lists]], columns=[*keys, *PACKED, *also])

    return rows.groupBy(*keys).applyInPandas(pack, ", ".join([f"{k} long" for k in keys] + [f"{c} binary" for c in (*PACKED, *also)]))


def _lists(body: np.ndarray, n: int) -> list[list[int]]:
    """The lists that were packed one after the other, each behind its length."""
    out, at, values = [], 0, body.tolist()
    for _ in range(n):
        out.append(values[at + 1:at + 1 + values[at]])
        at += 1 + values[at]
    return out


def _meet(blocks: DataFrame, trees: DataFrame, also: list[str], run: Callable, schema: str) -> DataFrame:
    """Applies run(size, anchors, block, lists of also) to each tree that is listed for a block, and returns its batches.

    Blocks and trees of one block come to one task, the block first; trees pass by one at a time."""
    keys, columns = ["size", "block"], [*PACKED, *also]
    none = [F.lit(None).cast("binary").alias(c) for c in also]
    rows = blocks.select(*keys, F.lit(0).alias("kind"), *PACKED, *none).unionByName(trees.select(*keys, F.lit(1).alias("kind"), *columns))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                size, number = batch.column("size")[row].as_py(), batch.column("block")[row].as_py()
                ids, tells, labels, copies = (np.frombuffer(batch.column(c)[row].as_buffer(), "<i8") for c in PACKED[:4])
                body = batch.column("vectors")[row].as_buffer()
                vectors = np.frombuffer(body, _WIDTHS.get(body.size // max(1, len(ids) * size), "<i8"))
                part = Part(size, ids, tells, labels, copies, vectors)
                if batch.column("kind")[row].as_py() == 0:
                    key, block = (size, number), part
                elif key == (size, number):
                    yield from run(part, block, [_lists(np.frombuffer(batch.column(c)[row].as_buffer(), "<i8"), len(ids)) for c in also])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(meet, schema)


def _batch(names: list[str], columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c or [np.zeros(0)]).astype(np.int64)) for c in columns], names=names)


def grid(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def mine(vectors: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256,
         id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row for which *anchors* holds
    and each of its *n_positives* best others of its label, the *n_negatives* best rows of other labels whose score is
    *least* to *most* hundredths of the positive's.

    A score is the inner product of the vectors' components times *scale*, rounded down; ties go to the smaller id. Results
    are exact; beyond 64 bits components and scores stay at the ends of that range. Labels are integers. Rows with a null id,
    label, vector or component, or with a component that isn't finite, take no part; only vectors of the anchor's length are
    compared. Rows that share an id, equal ones too, are rows of their own, and each of them that is an anchor has its own
    results. Without positives, or without rows in the window, there is no row.

    Equal rows are counted, and the others dealt by label and hash into blocks and, the anchors, into trees of bounded size.
    A tree meets the blocks of its labels for the positives and all blocks for the negatives, in each of which the best are
    found; these few are ranked. Work is anchors times rows by nature; bounds spare the inner products that can't matter.
    """
    row = vectors.withColumn("__anchor", F.coalesce(anchors, F.lit(False)))
    row = row.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("long").alias("label"), F.col(f"`{vector_column}`").alias("given"), "__anchor")
    finite = F.forall("given", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    row = row.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    row = row.select("id", "label", grid(F.col("given"), scale).alias("vector"), "__anchor").groupBy("id", "label", "vector").agg(
        F.count("*").alias("copies"), F.max("__anchor").alias("anchor"))
    row = materialize(row.select("*", F.size("vector").cast("long").alias("size"), F.xxhash64("label", "vector").alias("tell")))
    cells = min(CELLS, max(1, row.count() // BLOCK_ROWS))
    row = row.withColumn("cell", F.pmod(F.xxhash64("label"), F.lit(cells)))
    # blocks and trees are numbered through for each length of vectors
    parts, n_blocks, n_trees = [], {}, {}
    for r in sorted(row.groupBy("size", "cell").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).collect()):
        rows = min(BLOCK_ROWS, max(1, BLOCK_BYTES // max(1, 8 * r["size"])))
        b, t = -(-r["n"] // rows), -(-r["a"] // TREE_ANCHORS)
        parts.append((r["size"], r["cell"], n_blocks.get(r["size"], 0), b, n_trees.get(r["size"], 0), t))
        n_blocks[r["size"]], n_trees[r["size"]] = n_blocks.get(r["size"], 0) + b, n_trees.get(r["size"], 0) + t
    spark = row.sparkSession
    parts = spark.createDataFrame(parts, "size long, cell long, first_block long, n_blocks long, first_tree long, n_trees long")
    totals = spark.createDataFrame(list(n_blocks.items()), "size long, blocks long")
    row, turn = row.join(parts, ["size", "cell"]), F.xxhash64("id", "tell")
    blocks = materialize(_packed(row.select("*", (F.col("first_block") + F.pmod(turn, F.col("n_blocks"))).alias("block")), ["size", "block"], []))
    asked = row.filter("anchor").withColumn("tree", F.col("first_tree") + F.pmod(turn, F.col("n_trees")))

    def of_label(part: Part, block: Part, _: list) -> Iterator[pa.RecordBatch]:
        found = [(i, ids, scores) for i, ids, scores in positives(part, block, n_positives)]
        yield _batch(["id", "tell", "p_id", "score"], [[np.repeat(part.ids[i], len(x)) for i, x, _ in found], [np.repeat(part.tells[i], len(x)) for i, x, _ in found],
                                                       [x for _, x, _ in found], [s for _, _, s in found]])

    trees = _packed(asked, ["size", "first_block", "n_blocks", "tree"], [])
    trees = trees.withColumn("block", F.explode(F.expr("sequence(first_block, first_block + n_blocks - 1)")))
    near = _meet(blocks, trees, [], of_label, "id long, tell long, p_id long, score long")
    near = near.selectExpr("*", "row_number() over (partition by id, tell order by score desc, p_id) as place").filter(F.col("place") <= n_positives)
    near = near.groupBy("id", "tell").agg(F.sort_array(F.collect_list(F.struct("place", "p_id", "score"))).alias("best"))
    near = near.select("id", "tell", F.col("best.p_id").alias("p_ids"), F.col("best.score").alias("p_scores"))
    asked = asked.join(near, ["id", "tell"])

    def of_others(part: Part, block: Part, lists: list) -> Iterator[pa.RecordBatch]:
        p_ids, p_scores = lists
        windows = [[(-(-least * s // 100), most * s // 100) for s in x] for x in p_scores]
        found = [(i, w, ids, scores) for i, w, ids, scores in negatives(part, block, windows, n_negatives) if len(ids)]
        many = [len(x) for *_, x, _ in found]

        def each(values: list[int]) -> list[np.ndarray]:
            return [np.repeat(np.array(values, np.int64), many)]

        yield _batch(["id", "tell", "copies", "place", "positive_id", "positive_score", "negative_id", "negative_score"], [
            *(each([int(x[i]) for i, *_ in found]) for x in (part.ids, part.tells, part.copies)), each([w for _, w, *_ in found]),
            each([p_ids[i][w] for i, w, *_ in found]), each([p_scores[i][w] for i, w, *_ in found]), [x for *_, x, _ in found], [s for *_, s in found]])

    trees = _packed(asked, ["size", "tree"], ["p_ids", "p_scores"]).join(totals, "size")
    trees = trees.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    schema = "id long, tell long, copies long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _meet(blocks, trees, ["p_ids", "p_scores"], of_others, schema)
    rank = "cast(row_number() over (partition by id, tell, place order by negative_score desc, negative_id) as int) as rank"
    found = found.selectExpr("*", rank).filter(F.col("rank") <= n_negatives).withColumn("copy", F.explode(F.expr("array_repeat(0, cast(copies as int))")))
    return found.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
