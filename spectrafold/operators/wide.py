"""Linear models for wide spectra: no (channels x channels) matrix is ever formed.

A fit asks for products of the training rows' centred cross products with a few vectors, and goes on when it has them.
A pass answers the open fits of all folds at once: rows lie packed in blocks, a block is multiplied with the vectors
of its key, and the sums are partial aggregates. A fit's state is some hundred vectors of one fold, whatever the rows;
between passes it is a table, and the driver sees how many fits are open and how large their vectors are, no more.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.functions.batches import as_lists, from_matrix, matrix, widths
from spectrafold.operators import estimators as est
from spectrafold.operators.fitted import gram_rows, key_schema
from spectrafold.session import BROADCAST_BYTES, materialize

#: Bytes of the spectra of one block, and of the sums a task holds before it hands them on.
BLOCK_BYTES, HELD_BYTES = 16 * 1024 * 1024, 256 * 1024 * 1024


class Sums(est.MeanSums):
    """What one pass tells of a fold's training rows: counts, sums, squares and the products with the targets."""

    def __init__(self, m: np.ndarray, c: int):
        p = (m.shape[1] - 1 - c) // 2
        super().__init__(m[0, 0], m[0, 1:1 + p], m[0, 1 + p:1 + p + c], m[1:, 1:1 + p].T, m[1:, 1 + p:1 + p + c])
        self.x_squares = m[0, 1 + p + c:] - self.n * self.x_mean**2


# ---------------------------------------------------------------- fits


class Components:
    """Partial least squares, a product for each component; the recurrence is that of ``estimators.pls``."""

    def __init__(self, k: int, scale: bool):
        self.k, self.scale = k, scale

    def start(self, m: Sums) -> None:
        self.m, self.loop = m, est.PlsLoop(m, m.x_squares, self.k, self.scale)

    def ask(self) -> np.ndarray | None:
        r = self.loop.direction()
        return None if r is None else (r / self.loop.sx)[:, None]

    def answer(self, product: np.ndarray) -> None:
        self.loop.deflate(product[:, 0] / self.loop.sx)

    def model(self):
        return self.m.with_intercept(self.loop.coef())


class Krylov:
    """A basis grown by products of its newest *block* vectors, until what is wanted of the cross products lies in it.

    It starts from the products with the targets and random vectors (of a fixed seed), is kept orthonormal in full, and
    ends early when the training rows have no further directions.
    """

    def __init__(self, block: int, tol: float):
        self.block, self.tol = block, tol

    def start(self, m: Sums) -> None:
        self.m = m
        self.scale = max(float(m.x_squares.max()), 0.0)
        random = np.random.default_rng(0).standard_normal((m.p, max(self.block - m.c, 1)))
        size = np.linalg.norm(m.xy, axis=0)
        self.basis = self.products = np.empty((m.p, 0))
        self._grow(np.column_stack([m.xy[:, size > 0] / size[size > 0], random / np.linalg.norm(random, axis=0)]), 1e-10)

    def _grow(self, new: np.ndarray, floor: float) -> None:
        """The directions of *new* outside the basis (and above *floor*) are asked for next."""
        for _ in range(2):
            new = new - self.basis @ (self.basis.T @ new)
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        u = u[:, s > floor][:, :max(min(self.m.p, int(self.m.n) - 1) + self.m.c + self.block - self.basis.shape[1], 0)]
        u = u - self.basis @ (self.basis.T @ u)
        self.new = np.linalg.qr(u)[0] if u.shape[1] else u

    def ask(self) -> np.ndarray | None:
        return None if not self.new.shape[1] or (self.products.shape[1] and self.enough()) else self.new

    def answer(self, product: np.ndarray) -> None:
        self.basis, self.products = np.column_stack([self.basis, self.new]), np.column_stack([self.products, product])
        small = self.basis.T @ self.products
        self.value, self.vector = np.linalg.eigh((small + small.T) / 2)
        self._grow(product, max(float(self.value[-1]), self.scale) * 1e-14)


class RidgeFit(Krylov):
    """The solution within the basis; done when its residual is at most *tol* of the right side, or lost in rounding."""

    def __init__(self, alpha: float, block: int, tol: float):
        super().__init__(block, tol)
        self.alpha = alpha

    def _weights(self) -> np.ndarray:
        return self.vector @ ((self.vector.T @ (self.basis.T @ self.m.xy)) / (self.value + self.alpha)[:, None])

    def enough(self) -> bool:
        z = self._weights()
        rest = np.linalg.norm(self.m.xy - self.products @ z - self.alpha * (self.basis @ z), axis=0)
        rounding = 1e-14 * self.value[-1] * np.linalg.norm(z, axis=0)
        return bool((rest <= np.maximum(self.tol * np.linalg.norm(self.m.xy, axis=0), rounding)).all())

    def model(self):
        return self.m.with_intercept(self.basis @ self._weights())


class AxesFit(Krylov):
    """A model on the *k* leading principal axes; done when each axis' residual is at most *tol* of its own value, or
    lost in the rounding of the largest."""

    def __init__(self, k: int, rule, block: int, tol: float):
        super().__init__(block, tol)
        self.k, self.rule = k, rule

    def _axes(self) -> tuple[np.ndarray, np.ndarray]:
        k = max(1, min(self.k, self.m.p, int(self.m.n) - 1, len(self.value)))
        keep = self.value[::-1][:k] > max(self.value[-1], 0.0) * 1e-13
        return self.vector[:, ::-1][:, :k][:, keep], self.value[::-1][:k][keep]

    def enough(self) -> bool:
        vector, value = self._axes()
        if len(self.value) < min(self.k, self.m.p, int(self.m.n) - 1):
            return False
        rest = np.linalg.norm(self.products @ vector - (self.basis @ vector) * value, axis=0)
        return bool((rest <= np.maximum(self.tol * value, 1e-13 * self.value[-1])).all())

    def model(self):
        vector, value = self._axes()
        return self.rule(self.m, self.basis @ vector, value)


def ridge(alpha: float = 1.0, block: int = 16, tol: float = 1e-10):
    """Ridge regression, as ``estimators.ridge``."""
    return partial(RidgeFit, alpha, block, tol)


def pcr(k: int = 20, block: int = 16, tol: float = 1e-9):
    """Principal component regression, as ``estimators.pcr``."""
    return partial(AxesFit, k, est.regress_on_axes, block, tol)


def pca_lda(k: int = 30, block: int = 16, tol: float = 1e-9):
    """Discriminant analysis on principal component scores, as ``estimators.pca_lda``."""
    return partial(AxesFit, k, est.discriminate_on_axes, block, tol)


def pls(k: int = 10, scale: bool = True):
    """Partial least squares, as ``estimators.pls``."""
    return partial(Components, k, scale)


# ---------------------------------------------------------------- passes


def packed(rows: DataFrame, by: Sequence[str], column: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """The spectra of each key in blocks of about *limit* bytes: by, rows, x (row after row, little-endian doubles)."""
    by = list(by)
    names = [*by, "rows", "x"]

    def run(batches):
        held: dict[tuple, list[np.ndarray]] = {}
        types: list[pa.DataType] = []

        def block(key):
            x = np.concatenate(held.pop(key))
            cells = [pa.array([k], type=t) for k, t in zip(key, types)]
            return pa.RecordBatch.from_arrays([*cells, pa.array([len(x)], pa.int32()), pa.array([x.astype("<f8").tobytes()], pa.binary())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(c).type for c in by]
            keys = list(zip(*[batch.column(c).to_pylist() for c in by]))
            code = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            codes, lists = np.array([code[k] for k in keys]), as_lists(batch.column(column))
            for key, i in code.items():
                at = np.flatnonzero(codes == i)
                x = matrix(lists, at, int(widths(lists)[at[0]]))
                step = max(1, limit // max(8 * x.shape[1], 1))
                for start in range(0, len(x), step):
                    more = x[start:start + step].copy()
                    if sum(part.nbytes for part in held.get(key, ())) + more.nbytes > limit and key in held:
                        yield block(key)
                    held.setdefault(key, []).append(more)
            while sum(part.nbytes for parts in held.values() for part in parts) > HELD_BYTES:
                yield block(max(held, key=lambda k: sum(part.nbytes for part in held[k])))
        for key in list(held):
            yield block(key)

    return rows.select(*by, column).mapInArrow(run, key_schema(rows, by) + "rows int, x binary")


def products(blocks: DataFrame, asks: DataFrame, keys: Sequence[str], fold: str, held_bytes: int = HELD_BYTES) -> DataFrame:
    """For each vector that a fold asks for (``asks``: keys, array of (fold, ask)): its product with the centred cross
    products of the rows of the other folds, as an array over the channels: keys, fold, j, part.

    An ask holds the vectors and, as a last row, their products with the training mean.
    """
    keys = list(keys)
    names = [*keys, fold, "j", "part"]

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def flush():
            for key, m in held.items():
                cells = [pa.array([k] * m.shape[1], type=t) for k, t in zip(key, types)]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(np.arange(m.shape[1], dtype=np.int32)), from_matrix(m.T)], names=names)
            held.clear()

        for batch in batches:
            types = [batch.schema.field(c).type for c in (*keys, fold)]
            columns = [batch.column(c) for c in (*keys, fold, "rows", "x", "asks")]
            for i in range(batch.num_rows):
                *key, own, n, raw, asked = (c[i].as_py() for c in columns)
                x = np.frombuffer(raw, "<f8").reshape(n, -1)
                for other in asked:
                    if other["fold"] == own:
                        continue
                    v = np.frombuffer(other["ask"], "<f8").reshape(x.shape[1] + 1, -1)
                    m = x.T @ (x @ v[:-1] - v[-1])
                    at = (*key, other["fold"])
                    held[at] = held[at] + m if at in held else m
                if sum(m.nbytes for m in held.values()) > held_bytes:
                    yield from flush()
        yield from flush()

    parts = blocks.join(asks, keys).mapInArrow(run, key_schema(blocks, [*keys, fold]) + "j int, part array<double>")
    return parts.groupBy(*keys, fold, "j").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))


#: Attributes of a fit that are objects themselves.
PARTS = {"m": Sums, "loop": est.PlsLoop}


def saved(fit, pilot: np.ndarray) -> bytes:
    """What a fit has learnt, as plain arrays and numbers: the classes travel with the query, not with the table."""
    learnt = {name: vars(value) if name in PARTS else value for name, value in vars(fit).items() if not callable(value)}
    return pickle.dumps((learnt, pilot))


def restored(solver, raw: bytes) -> tuple:
    fit, (learnt, pilot) = solver(), pickle.loads(raw)
    for name, value in learnt.items():
        if name in PARTS:
            part = object.__new__(PARTS[name])
            vars(part).update(value)
            value = part
        setattr(fit, name, value)
    return fit, pilot


def _row(key: Sequence, fit, pilot: np.ndarray) -> list:
    """A fit as a row of the state: with an open ask, or with its model."""
    ask = fit.ask()
    if ask is not None:
        return [*key, saved(fit, pilot), np.vstack([ask, fit.m.x_mean @ ask]).astype("<f8").tobytes(), None, None]
    coef, intercept = fit.model()
    return [*key, None, None, coef.ravel().tolist(), (intercept - pilot @ coef).tolist()]


def fit_wide(rows: DataFrame, solver, keys: Sequence[str] = est.KEYS, fold: str = "fold", column: str = "intensities",
             passes: int = 200, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One linear model per (keys, fold), trained on the other folds, as ``estimators.fit_linear`` gives them.

    A fit still open after *passes* passes over the rows raises; none is cut short in silence. The vectors asked for are
    broadcast where they were measured to have at most *broadcast_bytes*; else blocks meet them by a shuffle.
    """
    keys = list(keys)
    by = [*keys, fold]
    rows, outputs = est.from_pilot(rows, keys, column)

    def outcomes(data, _):
        return np.column_stack([np.ones(len(data["target"])), data["target"]])

    def everything(data, _):
        x = data[column]
        return np.column_stack([np.ones(len(x)), x, data["target"], x * x])

    names = [*by, "fit", "ask", "coef", "intercept"]
    schema = key_schema(rows, by) + "fit binary, ask binary, coef array<double>, intercept array<double>"

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        c, pilot, key = int(pdf["_c"].iloc[0]), np.asarray(pdf["_pilot"].iloc[0], float), list(pdf[keys].iloc[0])
        parts = {f: np.stack(g.sort_values("i")["row"].to_list()) for f, g in pdf.groupby(fold)}
        total, out = sum(parts.values()), []
        for f, own in parts.items():
            fit = solver()
            fit.start(Sums(total - own, c))
            out.append(_row([*key, f], fit, pilot))
        return pd.DataFrame(out, columns=names)

    def go_on(key: tuple, before: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if before["fit"].iloc[0] is None:
            return before[names]
        fit, pilot = restored(solver, before["fit"].iloc[0])
        fit.answer(np.stack(parts.sort_values("j")["part"].to_list(), axis=1))
        return pd.DataFrame([_row(key, fit, pilot)], columns=names)

    blocks = materialize(packed(rows, by, column))
    sums = gram_rows(rows, by, outcomes, everything, (), (column, "target"))
    state = materialize(sums.join(outputs, keys).groupBy(*keys).applyInPandas(begin, schema))
    for done in range(passes + 1):
        still, size = state.agg(F.count("ask"), F.coalesce(F.sum(F.length("ask")), F.lit(0))).first()
        if not still:
            return state.select(*by, "coef", "intercept")
        if done == passes:
            break
        asks = state.where(F.col("ask").isNotNull()).groupBy(*keys).agg(
            F.collect_list(F.struct(F.col(fold).alias("fold"), "ask")).alias("asks"))  # one for each fold
        found = products(blocks, F.broadcast(asks) if size <= broadcast_bytes else asks, keys, fold)
        state = materialize(state.groupBy(*by).cogroup(found.groupBy(*by)).applyInPandas(go_on, schema))
    raise RuntimeError(f"{still} fits need more than {passes} passes; a larger block or penalty needs fewer")


def cross_val_wide(rows: DataFrame, solver, classify: bool, keys: Sequence[str] = est.KEYS, fold: str = "fold",
                   column: str = "intensities", **limits) -> DataFrame:
    """``estimators.cross_val_linear`` for spectra of very many channels."""
    return est.predict_linear(rows, fit_wide(rows, solver, keys, fold, column, **limits), classify, keys, fold, column)
