"""Preprocessing that is fitted on the training rows of a fold and replayed on the rest.

``fit(rows, by)`` returns a fitted step whose *state* is a small DataFrame with one row per key of *by*;
``transform(rows)`` replays it and never refits. Sums over rows are partial aggregates per task (JVM-side
vector sums), so a key that holds a third of the rows is summed by many tasks. With ``hold_out="fold"`` the
rows carry the fold they are *tested* in, and the state of a fold is fitted on all other folds: one pass
over the rows gives every fold's state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.functions import kernels
from spectrafold.functions.batches import as_lists, from_matrix, matrix, widths
from spectrafold.operators.ordering import with_values
from spectrafold.session import BROADCAST_BYTES, materialize

#: Rows of one key that a task holds at once where states are too large to broadcast.
ROWS_PER_TASK = 20_000


def key_schema(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)


def moments(rows: DataFrame, by: Sequence[str], column: str = "intensities") -> DataFrame:
    """Per key: n, element-wise mean and population variance (NULL keys allowed only for an empty *by*)."""
    vector = array_to_vector(F.col(column))
    metrics = Summarizer.metrics("count", "mean", "variance").summary(vector)
    out = rows.groupBy(*by).agg(metrics.alias("_m"))
    n = F.col("_m.count")
    return out.select(
        *by, n.cast("long").alias("n"), vector_to_array("_m.mean").alias("mean"),
        F.transform(vector_to_array("_m.variance"), lambda v: v * (n - 1) / n).alias("var"))


def leave_one_out(stats: DataFrame, by: Sequence[str], hold_out: str) -> DataFrame:
    """Merge the moments of all other folds: state rows per (by, hold_out) from one row per test fold."""
    by = list(by)
    schema = key_schema(stats, by) + f"{hold_out} {stats.schema[hold_out].dataType.simpleString()}, n long, mean array<double>, var array<double>"

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(dtype=float)
        mean, var = np.stack(pdf["mean"].to_list()), np.stack(pdf["var"].to_list())
        keep = 1.0 - np.eye(len(n))  # row f: every fold but f
        total = keep @ n
        centre = (keep @ (n[:, None] * mean)) / total[:, None]
        second = keep @ (n[:, None] * (var + mean**2)) / total[:, None] - centre**2
        out = pdf[[*by, hold_out]].copy()
        out["n"], out["mean"], out["var"] = total.astype(np.int64), list(centre), list(np.maximum(second, 0.0))
        return out

    return stats.groupBy(*by).applyInPandas(merge, schema)


def train_moments(rows: DataFrame, by: Sequence[str], hold_out: str | None, column: str) -> tuple[DataFrame, list[str]]:
    """(moments of the training rows, the key columns of the state)."""
    if hold_out is None:
        return moments(rows, by, column), list(by)
    return leave_one_out(moments(rows, [*by, hold_out], column), by, hold_out), [*by, hold_out]


def array_bytes(state: DataFrame, by: Sequence[str]) -> Column:
    """Bytes of the arrays of a state row."""
    arrays = [f for f in state.schema.fields if f.dataType.typeName() == "array" and f.name not in by]
    return sum((F.size(F.flatten(f.name) if f.dataType.elementType.typeName() == "array" else F.col(f.name)) * 8 for f in arrays), F.lit(64))


StateKernel = Callable[[np.ndarray, dict], np.ndarray]


def replay(rows: DataFrame, state: DataFrame, by: Sequence[str], kernel: StateKernel, column: str = "intensities",
           output: str | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``kernel(spectra, state of their key)`` per Arrow batch; rows without a state row are an error.

    *state* must be materialized: its size is measured. Below *limit* every executor gets it once; beyond it
    rows meet their state in salted groups of bounded size.
    """
    by, output = list(by), output or column
    fields = [f.name for f in state.schema.fields if f.name not in by]
    arrays = [f.name for f in state.schema.fields if f.dataType.typeName() == "array" and f.name not in by]
    measured = state.agg(F.coalesce(F.sum(array_bytes(state, by)), F.lit(0)).cast("long")).first()[0]
    keep = [c for c in rows.columns if c != output]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"`{output}` array<double>"])

    def run(batch: pa.RecordBatch | pa.Table, lookup: dict) -> pa.Table:
        lists = as_lists(batch.column(column))
        keys = list(zip(*[batch.column(c).to_pylist() for c in by])) if by else [()] * len(lists)
        code = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        codes = np.array([code[k] for k in keys], dtype=np.int64)
        n = widths(lists)
        parts, order = [], []
        for key, i in code.items():
            if key not in lookup:
                raise KeyError(f"no fitted state for {dict(zip(by, key))}")
            for width in np.unique(n[codes == i]):
                at = np.flatnonzero((codes == i) & (n == width))
                order.append(at)
                parts.append(pa.array([None] * len(at), type=pa.list_(pa.float64())) if width < 0
                             else from_matrix(kernel(matrix(lists, at, int(width)), lookup[key])))
        back = np.argsort(np.concatenate(order), kind="stable") if order else np.array([], dtype=np.int64)
        done = pa.chunked_array(parts, type=pa.list_(pa.float64())).combine_chunks().take(pa.array(back))
        return pa.table([batch.column(c) for c in keep] + [done], names=[*keep, output])

    def to_state(row) -> dict:
        return {f: np.array(row[f]) if f in arrays else row[f] for f in fields}

    if measured <= limit:
        lookup = {tuple(r[c] for c in by): to_state(r) for r in state.collect()}
        shared = rows.sparkSession.sparkContext.broadcast(lookup)

        def over_batches(batches):
            for batch in batches:
                if batch.num_rows:
                    yield from run(batch, shared.value).to_batches()

        return rows.mapInArrow(over_batches, schema)

    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_salts", F.ceil(F.col("_n") / ROWS_PER_TASK).cast("int"))
    spread = F.concat_ws("|", *[F.col(c).cast("string") for c in rows.columns if c != column and not rows.schema[c].dataType.typeName() in ("array", "map")])
    salted = with_values(rows, sizes, by, ["_salts"]).withColumn(
        "_salt", F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int")).drop("_salts")
    copies = state.join(sizes, by).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts", "_n")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], type=left.schema.field(c).type) for c in keep]
                            + [pa.array([], type=pa.list_(pa.float64()))], names=[*keep, output])
        found = {tuple(r[c] for c in by): to_state(r) for r in right.to_pylist()}
        return run(left, found)

    return salted.groupBy(*by, "_salt").cogroup(copies.groupBy(*by, "_salt")).applyInArrow(meet, schema)


#: Bytes of spectra that a kernel gets at a time: its own arrays are some ten times as large.
SLICE_BYTES = 1024 * 1024


def replay_all(rows: DataFrame, chains: dict[str, Sequence], column: str = "intensities", limit: int = BROADCAST_BYTES) -> DataFrame | None:
    """Every chain of steps run on *column* into the column that names it, all in one pass: a task needs one Python worker,
    which holds a batch and works on slices of at most SLICE_BYTES. None if states are too large to broadcast or have
    different keys.

    A step is a kernel (matrix -> matrix) or a :class:`FittedStep`.
    """
    fitted = [step for steps in chains.values() for step in steps if isinstance(step, FittedStep)]
    if len({tuple(step.by) for step in fitted}) > 1 or sum(step.size() for step in fitted) > limit:
        return None
    by = fitted[0].by if fitted else []
    spark = rows.sparkSession
    plain = {name: [(step.kernel, spark.sparkContext.broadcast(step.lookup())) if isinstance(step, FittedStep) else (step, None)
                    for step in steps] for name, steps in chains.items()}
    keep = [c for c in rows.columns if c not in chains]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c}` array<double>" for c in chains])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = as_lists(batch.column(column))
        keys = list(zip(*[batch.column(c).to_pylist() for c in by])) if by else [()] * len(lists)
        code = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        codes, n = np.array([code[k] for k in keys], dtype=np.int64), widths(lists)
        parts, order = {name: [] for name in plain}, []
        for key, i in code.items():
            for width in np.unique(n[codes == i]):
                found = np.flatnonzero((codes == i) & (n == width))
                step = max(1, SLICE_BYTES // (8 * max(int(width), 1)))
                for at in (found[low : low + step] for low in range(0, len(found), step)):
                    order.append(at)
                    for name, steps in plain.items():
                        if width < 0:
                            parts[name].append(pa.array([None] * len(at), type=pa.list_(pa.float64())))
                            continue
                        x = matrix(lists, at, int(width))
                        for kernel, state in steps:
                            if state is not None and key not in state.value:
                                raise KeyError(f"no fitted state for {dict(zip(by, key))}")
                            x = kernel(x) if state is None else kernel(x, state.value[key])
                        parts[name].append(from_matrix(x))
        back = pa.array(np.argsort(np.concatenate(order), kind="stable"))
        done = [pa.chunked_array(v, type=pa.list_(pa.float64())).combine_chunks().take(back) for v in parts.values()]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *done], names=[*keep, *plain])

    def over_batches(batches):
        for batch in batches:
            if batch.num_rows:
                yield run(batch)

    return rows.mapInArrow(over_batches, schema)


class FittedStep:
    """A fitted step: its materialized state and the kernel that replays it."""

    def __init__(self, state: DataFrame, by: Sequence[str], kernel: StateKernel, column: str):
        self.state, self.by, self.kernel, self.column = state, list(by), kernel, column
        self._size, self._lookup = None, None

    def transform(self, rows: DataFrame, output: str | None = None) -> DataFrame:
        return replay(rows, self.state, self.by, self.kernel, self.column, output)

    def size(self) -> int:
        """Bytes of the state's arrays."""
        if self._size is None:
            self._size = self.state.agg(F.coalesce(F.sum(array_bytes(self.state, self.by)), F.lit(0)).cast("long")).first()[0]
        return self._size

    def lookup(self) -> dict:
        """The state by key, for states of a measured, small size."""
        if self._lookup is None:
            fields = [f for f in self.state.schema.fields if f.name not in self.by]
            self._lookup = {tuple(r[c] for c in self.by): {
                f.name: np.array(r[f.name]) if f.dataType.typeName() == "array" else r[f.name] for f in fields} for r in self.state.collect()}
        return self._lookup


class MSC:
    """Multiplicative scatter correction against the mean training spectrum, fitted on a region."""

    def __init__(self, start: float = 0.0, end: float = 1.0):
        self.start, self.end = start, end

    def fit(self, rows: DataFrame, by: Sequence[str] = (), hold_out: str | None = None, column: str = "intensities") -> FittedStep:
        stats, keys = train_moments(rows, by, hold_out, column)
        start, end = self.start, self.end
        return FittedStep(materialize(stats.select(*keys, F.col("mean").alias("reference"))), keys,
                          lambda x, s: kernels.msc(x, s["reference"], start, end), column)


class EMSC:
    """Extended MSC: intercept, reference and a polynomial of the axis."""

    def __init__(self, poly_order: int = 4):
        self.poly_order = poly_order

    def fit(self, rows: DataFrame, by: Sequence[str] = (), hold_out: str | None = None, column: str = "intensities") -> FittedStep:
        stats, keys = train_moments(rows, by, hold_out, column)
        order = self.poly_order
        return FittedStep(materialize(stats.select(*keys, F.col("mean").alias("reference"))), keys,
                          lambda x, s: kernels.emsc(x, s["reference"], order), column)


class StandardScaler:
    """Per-channel z-score with the population standard deviation; a constant channel is only centred."""

    def fit(self, rows: DataFrame, by: Sequence[str] = (), hold_out: str | None = None, column: str = "intensities") -> FittedStep:
        stats, keys = train_moments(rows, by, hold_out, column)
        scale = F.transform("var", lambda v: F.when(v > 0, F.sqrt(v)).otherwise(F.lit(1.0)))
        return FittedStep(materialize(stats.select(*keys, "mean", scale.alias("scale"))), keys,
                          lambda x, s: (x - s["mean"]) / s["scale"], column)


# ---------------------------------------------------------------- sums of outer products


def gram_rows(rows: DataFrame, by: Sequence[str], left, right, extra: Sequence[str], columns: Sequence[str],
              budget: int = 256 * 1024 * 1024) -> DataFrame:
    """Sum over the rows of each key of ``left(batch)' @ right(batch)``: one output row per matrix row.

    Each task adds up its own rows (a matrix per key it meets, flushed when they exceed *budget* bytes); the
    partial matrices are summed row by row with partial vector aggregates. ``left``/``right`` map a dict of
    batch matrices and the key to matrices; *extra* names the scalar columns of the batch they need.
    """
    by = list(by)
    schema = key_schema(rows, by) + "i int, row array<double>"
    names = [*by, "i", "row"]

    def partial(batches):
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def flush():
            for key, m in held.items():
                cols = [pa.array([k] * len(m), type=t) for k, t in zip(key, types)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(len(m), dtype=np.int32)), from_matrix(m)], names=names)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(c).type for c in by]
            keys = list(zip(*[batch.column(c).to_pylist() for c in by])) if by else [()] * batch.num_rows
            code = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            codes = np.array([code[k] for k in keys])
            lists = {c: as_lists(batch.column(c)) for c in columns}
            scalars = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in extra}
            for key, i in code.items():
                at = np.flatnonzero(codes == i)
                data = {c: matrix(v, at, int(widths(v)[at[0]])) for c, v in lists.items()}
                data.update({c: v[at] for c, v in scalars.items()})
                m = left(data, key).T @ right(data, key)
                held[key] = held[key] + m if key in held else m
            if sum(m.nbytes for m in held.values()) > budget:
                yield from flush()
        yield from flush()

    parts = rows.select(*by, *extra, *columns).mapInArrow(partial, schema)
    return parts.groupBy(*by, "i").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("row")))).alias("row"))


def assemble(pdf: pd.DataFrame) -> np.ndarray:
    """The matrix whose rows are the ``row`` arrays in ``i`` order."""
    return np.stack(pdf.sort_values("i")["row"].to_list())


class LVSE:
    """Scores on the leading singular vectors of every axis region, standardized on the training rows.

    A spectrum is cut into its regions first, so a task adds up one small covariance per region instead of
    one over the whole axis.
    """

    def __init__(self, n_regions: int = 16, k: int = 4):
        self.n_regions, self.k = n_regions, k

    def regions(self, column: str):
        """The spectrum as an array of nearly equal runs, the longer ones first."""
        x = F.col(column)
        r = F.least(F.lit(self.n_regions), F.size(x))
        short, longer = F.floor(F.size(x) / r).cast("int"), F.pmod(F.size(x), r)
        return F.transform(F.sequence(F.lit(0), r - 1), lambda i: F.slice(
            x, i * short + F.least(i, longer) + 1, short + F.when(i < longer, 1).otherwise(0)))

    def fit(self, rows: DataFrame, by: Sequence[str] = (), hold_out: str | None = None, column: str = "intensities") -> FittedStep:
        keys = [*by, hold_out] if hold_out else list(by)
        k = self.k
        # products of the distances to one spectrum, so a large common offset costs no digits
        pilot = rows.groupBy(*by).agg(F.min(column).alias("_pilot"))
        shifted = with_values(rows, pilot, by, ["_pilot"]).withColumn(column, F.zip_with(column, "_pilot", lambda a, b: a - b))
        pieces = shifted.select(*keys, F.posexplode(self.regions(column)).alias("region", column))
        pilots = pilot.select(*by, F.posexplode(self.regions("_pilot")).alias("region", "_pilot"))

        def design(data, _):
            x = data[column]
            return np.column_stack([np.ones(len(x)), x])

        sums = gram_rows(pieces, [*keys, "region"], design, design, (), (column,))
        names = [*keys, "region", "mean", "scale", "axes"]
        schema = key_schema(rows, keys) + "region int, mean array<double>, scale array<double>, axes array<double>"

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            groups = [g for _, g in pdf.groupby(hold_out)] if hold_out else [pdf]
            mats = [assemble(g) for g in groups]
            total = sum(mats)
            out = []
            for g, m in zip(groups, mats):
                s = total - m if hold_out else m
                n, mean = s[0, 0], s[0, 1:] / s[0, 0]
                cov = s[1:, 1:] / n - np.outer(mean, mean)
                var, mean = np.diag(cov), mean + np.asarray(g["_pilot"].iloc[0], float)
                scale = np.where(var > 1e-12 * mean**2, np.sqrt(np.maximum(var, 0.0)), 1.0)
                _, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
                axes = vectors[:, ::-1][:, : max(1, min(k, len(mean), int(n)))].T
                axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
                out.append([*g[[*keys, "region"]].iloc[0], mean.tolist(), scale.tolist(), axes.ravel().tolist()])
            return pd.DataFrame(out, columns=names)

        solved = sums.join(pilots, [*by, "region"]).groupBy(*by, "region").applyInPandas(solve, schema)
        joined = solved.groupBy(*[F.col(c) for c in keys]).agg(
            F.array_sort(F.collect_list(F.struct("region", "mean", "scale", "axes"))).alias("r"))
        state = materialize(joined.select(
            *keys, F.flatten("r.mean").alias("mean"), F.flatten("r.scale").alias("scale"), F.flatten("r.axes").alias("axes"),
            F.transform("r.mean", lambda m: F.size(m)).alias("width"),
            F.transform("r.axes", lambda m: F.size(m)).alias("length")))

        def project(x: np.ndarray, s: dict) -> np.ndarray:
            z = (x - s["mean"]) / s["scale"]
            cuts, ends = np.cumsum(s["width"])[:-1], np.cumsum(s["length"])[:-1]
            return np.concatenate([
                part @ axes.reshape(-1, part.shape[1]).T
                for part, axes in zip(np.split(z, cuts, axis=1), np.split(s["axes"], ends))], axis=1)

        return FittedStep(state, keys, project, column)


class GCU:
    """Non-negative factorization of the training spectra (shifted to be non-negative); output = the weights.

    Alternating least squares: with the parts fixed, every row solves its own non-negative problem inside its
    task; the parts are updated from two small sums over all rows (weights' weights, weights' spectra). One
    iteration is one distributed aggregation for all keys together. Keys whose parts would exceed the
    broadcast bound together are fitted in chunks. With left-out folds a row is in the training rows of every other fold.
    The state's ``converged`` says whether the loss had stopped falling by *tol* of the energy within *max_iter* iterations.
    """

    def __init__(self, rho: int = 16, seed: int = 0, max_iter: int = 500, tol: float = 1e-4):
        self.rho, self.seed, self.max_iter, self.tol = rho, seed, max_iter, tol

    def fit(self, rows: DataFrame, by: Sequence[str] = (), hold_out: str | None = None, column: str = "intensities") -> FittedStep:
        by = list(by)
        if hold_out is not None:
            folds = rows.groupBy(*by).agg(F.collect_set(hold_out).alias("_folds"))
            rows = with_values(rows, folds, by, ["_folds"]).withColumn("_left_out", F.explode("_folds"))
            rows = rows.where(F.col("_left_out") != F.col(hold_out)).select(*by, F.col("_left_out").alias(hold_out), column)
            by = [*by, hold_out]
        rows = materialize(rows.select(*by, column))  # read once per iteration
        low = rows.groupBy(*by).agg(
            F.min(F.array_min(column)).alias("shift"), F.count(F.lit(1)).alias("n"), F.max(F.size(column)).alias("p")).collect()
        per_key = max(8 * self.rho * max(r["p"] for r in low), 1)
        size = max(1, BROADCAST_BYTES // per_key)
        spark, state = rows.sparkSession, None
        for first in range(0, len(low), size):
            chunk = low[first : first + size]
            part = rows
            if len(low) > size:
                wanted = spark.createDataFrame([tuple(r[c] for c in by) for r in chunk], key_schema(rows, by).rstrip(", "))
                part = rows.join(F.broadcast(wanted), by, "left_semi")
            done = self._fit_chunk(part, by, column, {tuple(r[c] for c in by): (r["shift"], r["n"]) for r in chunk})
            state = done if state is None else state.unionByName(done)
        return FittedStep(state, by, lambda x, s: kernels.nonneg_weights(np.maximum(x - s["shift"], 0.0), s["parts"]), column)

    def _fit_chunk(self, rows: DataFrame, by: list[str], column: str, stats: dict) -> DataFrame:
        spark, rho, seed = rows.sparkSession, self.rho, self.seed
        schema = key_schema(rows, by) + "i int, row array<double>, loss double"
        names = [*by, "i", "row", "loss"]

        def shifted(data, key):
            return np.maximum(data[column] - stats[key][0], 0.0)

        def key_of(pdf):
            return tuple(pdf[c].iloc[0] for c in by)

        def as_rows(key, h, loss):
            return pd.DataFrame([[*key, i, r.tolist(), float(loss)] for i, r in enumerate(h)], columns=names)

        def start(pdf: pd.DataFrame) -> pd.DataFrame:
            """Non-negative halves of the leading eigenvectors of X'X, plus a little seeded noise."""
            key, m = key_of(pdf), assemble(pdf)
            rank = max(1, min(rho, len(m), stats[key][1]))
            h = np.random.default_rng(seed).random((rank, len(m))) * 1e-2 + 1e-3
            value, vector = np.linalg.eigh(m)
            for j in range(rank):
                v = vector[:, -1 - j]
                up, down = np.maximum(v, 0.0), np.maximum(-v, 0.0)
                h[j] += (up if up @ up >= down @ down else down) * np.sqrt(max(value[-1 - j], 0.0) / stats[key][1])
            return as_rows(key, h, np.trace(m))

        def collect(df: DataFrame) -> tuple[dict, dict]:
            found: dict[tuple, dict[int, list]] = {}
            loss: dict[tuple, float] = {}
            for r in df.collect():
                key = tuple(r[c] for c in by)
                found.setdefault(key, {})[r["i"]] = r["row"]
                loss[key] = r["loss"]
            return {key: np.array([h[i] for i in range(len(h))]) for key, h in found.items()}, loss

        grams = gram_rows(rows, by, shifted, shifted, (), (column,))
        parts, energy = collect(grams.groupBy(*by).applyInPandas(start, schema))

        def iteration(shared):
            def weights(data, key):
                return kernels.nonneg_weights(shifted(data, key), shared.value[key])

            def both(data, key):
                return np.column_stack([weights(data, key), shifted(data, key)])

            def update(pdf: pd.DataFrame) -> pd.DataFrame:
                key, m = key_of(pdf), assemble(pdf)
                ww, wx, h = m[:, : len(m)], m[:, len(m) :], shared.value[key].copy()
                loss = energy[key] - 2 * np.sum(wx * h) + np.sum((ww @ h) * h)
                for _sweep in range(20):
                    for j in range(len(h)):
                        if ww[j, j] > 0:
                            h[j] = np.maximum(h[j] + (wx[j] - ww[j] @ h) / ww[j, j], 0.0)
                return as_rows(key, h, loss)

            sums = gram_rows(rows, by, weights, both, (), (column,))
            return collect(sums.groupBy(*by).applyInPandas(update, schema))

        previous, gain = dict(energy), {key: float("inf") for key in parts}
        for _ in range(self.max_iter):
            parts, loss = iteration(spark.sparkContext.broadcast(parts))
            gain = {key: (previous[key] - loss[key]) / max(energy[key], 1e-300) for key in parts}
            previous = loss
            if max(gain.values()) < self.tol:
                break
        data = [(*key, float(stats[key][0]), [r.tolist() for r in h], float(previous[key]), gain[key] < self.tol) for key, h in parts.items()]
        return materialize(spark.createDataFrame(
            data, key_schema(rows, by) + "shift double, parts array<array<double>>, loss double, converged boolean"))
