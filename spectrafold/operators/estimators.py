"""Estimators whose training is an aggregation, cross-validated on fold tables.

Linear models need the cross products of [1, x, y] only. Each row is read once: its products go to the sums of
its own test fold, and the training sums of a fold are the total minus its own part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.operators.fitted import assemble, gram_rows, key_schema, replay
from spectrafold.operators.ordering import HOT_ROWS, hash_order, hash_rank, with_values
from spectrafold.session import materialize

KEYS = ("task", "repeat")


def with_folds(spectra: DataFrame, folds: DataFrame, id_column: str = "spectrum_id") -> DataFrame:
    """Every spectrum once per repeat, with the fold it is tested in."""
    return spectra.join(folds, [c for c in ("task", id_column) if c in spectra.columns and c in folds.columns])


def one_hot(rows: DataFrame, label: str = "label", by: Sequence[str] = ("task",), id_column: str = "spectrum_id",
            hot_rows: int = HOT_ROWS) -> DataFrame:
    """``target`` = indicator array over the sorted classes of the row's key, ``classes`` = those classes."""
    by = list(by)
    classes = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_c")).groupBy(*by).agg(
        F.sort_array(F.collect_list(label)).alias("classes"), F.sum("_c").alias("_n"))
    out = with_values(rows, classes, by, ["classes"])
    return out.withColumn("target", F.transform("classes", lambda c: (c == F.col(label)).cast("double")))


def numeric_target(rows: DataFrame, column: str = "y") -> DataFrame:
    return rows.withColumn("target", F.array(F.col(column).cast("double"))).withColumn("classes", F.lit(None).cast("array<string>"))


# ---------------------------------------------------------------- solvers on cross products


class MeanSums:
    """Counts, means and the products with the targets of a fold's training rows."""

    def __init__(self, n: float, x_sum: np.ndarray, y_sum: np.ndarray, xy: np.ndarray, yy: np.ndarray):
        self.n, self.p, self.c = n, len(x_sum), len(y_sum)
        self.x_mean, self.y_mean = x_sum / n, y_sum / n
        self.xy = xy - n * np.outer(self.x_mean, self.y_mean)
        self.yy = yy - n * np.outer(self.y_mean, self.y_mean)
        self.class_sums, self.class_n = xy, y_sum

    def with_intercept(self, coef: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return coef, self.y_mean - self.x_mean @ coef


class Moments(MeanSums):
    """Training sums of [1, x, y] split into the parts the solvers need."""

    def __init__(self, m: np.ndarray, c: int):
        super().__init__(m[0, 0], m[0, 1:-c], m[0, -c:], m[1:-c, -c:], m[-c:, -c:])
        self.xx = m[1:-c, 1:-c] - self.n * np.outer(self.x_mean, self.x_mean)

    def components(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Leading principal axes and their sums of squares; directions without variance are left out."""
        k = max(1, min(k, self.p, int(self.n) - 1))
        value, vector = np.linalg.eigh(self.xx)
        value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
        keep = value > max(value[0], 0.0) * 1e-13
        return vector[:, keep], value[keep]


Solver = Callable[[Moments], tuple[np.ndarray, np.ndarray]]


def ridge(alpha: float = 1.0) -> Solver:
    """Ridge regression with an unpenalized intercept."""
    return lambda m: m.with_intercept(np.linalg.solve(m.xx + alpha * np.eye(m.p), m.xy))


def regress_on_axes(m: MeanSums, axes: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squares on the scores of principal axes with the sums of squares *value*."""
    return m.with_intercept(axes @ ((axes.T @ m.xy) / value[:, None]))


def discriminate_on_axes(m: MeanSums, axes: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear discriminants on the scores of principal axes: log posteriors up to a constant."""
    n_c = np.maximum(m.class_n, 1e-300)
    centres = axes.T @ (m.class_sums / n_c - m.x_mean[:, None])  # components x classes
    within = np.diag(value) - (centres * m.class_n) @ centres.T
    pooled = within / max(m.n - (m.class_n > 0).sum(), 1)
    direction = np.linalg.pinv(pooled, hermitian=True) @ centres
    prior = np.where(m.class_n > 0, np.log(n_c / m.n), -1e3)
    coef = axes @ direction
    return coef, prior - 0.5 * np.sum(centres * direction, axis=0) - m.x_mean @ coef


def pcr(k: int = 20) -> Solver:
    """Least squares on the first principal component scores."""
    return lambda m: regress_on_axes(m, *m.components(k))


class PlsLoop:
    """The components of partial least squares on standardized x and y, one by one: ``direction`` gives the next
    component's rotation (none: done), ``deflate`` takes its product with the standardized cross products."""

    def __init__(self, m: MeanSums, x_squares: np.ndarray, k: int, scale: bool):
        unit = lambda ss: np.where(ss > 1e-300, np.sqrt(np.maximum(ss, 0) / max(m.n - 1, 1)), 1.0)
        self.sx = unit(x_squares) if scale else np.ones(m.p)
        self.sy = unit(np.diag(m.yy)) if scale else np.ones(m.c)
        self.xy, self.least = m.xy / np.outer(self.sx, self.sy), 1e-14 * np.sum(x_squares / self.sx**2)
        self.left = max(1, min(k, m.p, int(m.n) - 1))
        self.rotations, self.loadings, self.weights = [], [], []

    def direction(self) -> np.ndarray | None:
        if not self.left:
            return None
        if self.xy.shape[1] == 1:
            w = self.xy[:, 0].copy()
        else:
            _, vec = np.linalg.eigh(self.xy.T @ self.xy)
            w = self.xy @ vec[:, -1]
        norm = np.linalg.norm(w)
        if norm < 1e-12:
            return None
        w /= norm
        self.r = w.copy()
        for p, done in zip(self.loadings, self.rotations):
            self.r -= (p @ w) * done
        return self.r

    def deflate(self, xr: np.ndarray) -> None:
        tt = self.r @ xr
        if tt <= self.least:
            self.left = 0
            return
        p, q = xr / tt, self.xy.T @ self.r / tt
        self.xy = self.xy - tt * np.outer(p, q)
        self.left -= 1
        self.rotations.append(self.r)
        self.loadings.append(p)
        self.weights.append(q)

    def coef(self) -> np.ndarray:
        if not self.rotations:
            return np.zeros(self.xy.shape)
        return np.array(self.rotations).T @ np.array(self.weights) * self.sy[None, :] / self.sx[:, None]


def pls(k: int = 10, scale: bool = True) -> Solver:
    """Partial least squares by the kernel algorithm on the cross products of standardized x and y."""

    def solve(m: Moments):
        loop = PlsLoop(m, np.diag(m.xx), k, scale)
        xx = m.xx / np.outer(loop.sx, loop.sx)
        while (r := loop.direction()) is not None:
            loop.deflate(xx @ r)
        return m.with_intercept(loop.coef())

    return solve


def pca_lda(k: int = 30) -> Solver:
    """Linear discriminant analysis on principal component scores; the scores are log posteriors up to a constant."""
    return lambda m: discriminate_on_axes(m, *m.components(k))


def from_pilot(rows: DataFrame, keys: Sequence[str], column: str) -> tuple[DataFrame, DataFrame]:
    """(*rows* as distances to one spectrum of their key, that spectrum and the number of outputs by key)."""
    outputs = rows.groupBy(*keys).agg(F.max(F.size("target")).alias("_c"), F.min(column).alias("_pilot"))
    return with_values(rows, outputs, keys, ["_pilot"]).withColumn(column, F.zip_with(column, "_pilot", lambda a, b: a - b)), outputs


def fit_linear(rows: DataFrame, solver: Solver, keys: Sequence[str] = KEYS, fold: str = "fold", column: str = "intensities") -> DataFrame:
    """One linear model per (keys, fold), trained on the other folds: coef (channels x outputs, flat), intercept.

    Products are summed of the distances to one spectrum of the key, so a large common offset costs no digits. A task holds
    a (channels + outputs)^2 matrix for each fold of a key; ``wide.fit_wide`` holds none.
    """
    keys = list(keys)
    rows, outputs = from_pilot(rows, keys, column)

    def design(data, _):
        x = data[column]
        return np.column_stack([np.ones(len(x)), x, data["target"]])

    sums = gram_rows(rows, [*keys, fold], design, design, (), (column, "target"))
    schema = key_schema(rows, [*keys, fold]) + "coef array<double>, intercept array<double>"
    names = [*keys, fold, "coef", "intercept"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        c, pilot = int(pdf["_c"].iloc[0]), np.asarray(pdf["_pilot"].iloc[0], float)
        parts = {f: assemble(g) for f, g in pdf.groupby(fold)}
        total = sum(parts.values())
        out = []
        for f, own in parts.items():
            coef, intercept = solver(Moments(total - own, c))
            out.append([*pdf[keys].iloc[0], f, coef.ravel().tolist(), (intercept - pilot @ coef).tolist()])
        return pd.DataFrame(out, columns=names)

    # A group holds one (1 + channels + outputs)^2 matrix per fold.
    return materialize(sums.join(outputs, keys).groupBy(*keys).applyInPandas(solve, schema))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predict_linear(rows: DataFrame, models: DataFrame, classify: bool, keys: Sequence[str] = KEYS, fold: str = "fold",
                   column: str = "intensities") -> DataFrame:
    """Predictions of every row by the model of the fold it is tested in."""
    keys = list(keys)

    def score(x: np.ndarray, s: dict) -> np.ndarray:
        out = x @ s["coef"].reshape(x.shape[1], -1) + s["intercept"]
        return softmax(out) if classify else out

    done = replay(rows, models, [*keys, fold], score, column, "_out")
    done = done.drop(column, "target")
    if classify:
        return done.withColumnRenamed("_out", "proba")
    return done.withColumn("y_pred", F.col("_out")[0]).drop("_out", "classes")


def cross_val_linear(rows: DataFrame, solver: Solver, classify: bool, keys: Sequence[str] = KEYS, fold: str = "fold",
                     column: str = "intensities") -> DataFrame:
    """Fit on the other folds, predict the own fold: one prediction per row and repeat."""
    return predict_linear(rows, fit_linear(rows, solver, keys, fold, column), classify, keys, fold, column)


def cross_val_dummy(rows: DataFrame, keys: Sequence[str] = KEYS, fold: str = "fold", id_column: str = "spectrum_id",
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """``proba``: the mean target (class shares, or the mean of a numeric target) over the other folds."""
    keys = list(keys)
    sums = rows.groupBy(*keys, fold).agg(F.count(F.lit(1)).alias("_n"), vector_to_array(Summarizer.sum(array_to_vector("target"))).alias("_s"))
    total = sums.groupBy(*keys).agg(F.sum("_n").alias("_all"), vector_to_array(Summarizer.sum(array_to_vector("_s"))).alias("_t"))
    share = F.zip_with("_t", "_s", lambda a, b: (a - b) / (F.col("_all") - F.col("_n")))
    state = sums.join(total, keys).withColumn("proba", share)
    return with_values(rows, state, [*keys, fold], ["proba"]).drop("target", "intensities")


# ---------------------------------------------------------------- any estimator


def cross_validate(rows: DataFrame, fit: Callable, predict: Callable, *, k: int = 3, classify: bool = False,
                   keys: Sequence[str] = KEYS, fold: str = "fold", id_column: str = "spectrum_id",
                   column: str = "intensities", max_train: int = 200_000, test_rows: int = 20_000) -> DataFrame:
    """A user's estimator on every (keys, fold): ``model = fit(X, y)``, ``predict(model, X)`` -> values or an
    (n, classes) probability matrix.

    A classifier is fitted on at most *max_train* labelled rows of a fold's training set, those with the least hashes; a
    regressor on all, so its training set must fit a worker. Every test row is predicted, in parts of about *test_rows*
    rows that each meet the fitted (pickled) model. A fold that fails is reported in ``error`` and the others go on; a
    classifier without probabilities fails.
    """
    keys = list(keys)
    by = [*keys, fold]
    used = rows.select(*keys, F.col(fold).cast("int").alias("_own"), id_column, column, "target")
    train = used.withColumn(fold, F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col(fold) != F.col("_own")).drop("_own")
    if classify:
        train = hash_rank(train, by, hash_order("train", id_column), id_column, "_position", at_most=max_train).drop("_position")
    names = [*by, "model", "error"]

    def learn(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        try:
            x, y = np.stack(part[column].to_list()), np.stack(part["target"].to_list())
            return pd.DataFrame([[*key, cloudpickle.dumps(fit(x, y.argmax(axis=1) if classify else y[:, 0])), None]], columns=names)
        except Exception as e:  # one failing fold must not end the others
            return pd.DataFrame([[*key, None, repr(e)]], columns=names)

    models = materialize(train.groupBy(*by).applyInPandas(learn, key_schema(rows, keys) + f"{fold} int, model binary, error string"))
    test = used.select(*keys, F.col("_own").alias(fold), id_column, column)
    parts = test.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / float(test_rows)).cast("int").alias("_parts"))
    test = with_values(test, parts, by, ["_parts"]).withColumn("_part", F.pmod(F.xxhash64(id_column), F.col("_parts")).cast("int"))
    places = parts.select(*[F.col(c).alias(c) for c in by], F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))  # new column identities
    fitted = models.where(F.col("error").isNull()).join(places, by)
    columns = [*by, id_column, "y_pred", "proba", "error"]

    def score(key: tuple, part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(model):
            return pd.DataFrame([], columns=columns)
        try:
            out = np.asarray(predict(cloudpickle.loads(model["model"].iloc[0]), np.stack(part[column].to_list())), dtype=float)
            if classify and out.ndim != 2:
                raise ValueError("the classifier gives no probabilities")
            values = [None] * len(part) if classify else list(out.ravel())
            proba = list(out) if classify else [None] * len(part)
            return pd.DataFrame([[*key[:-1], i, v, p, None] for i, v, p in zip(part[id_column], values, proba)], columns=columns)
        except Exception as e:
            return pd.DataFrame([[*key[:-1], None, None, None, repr(e)]], columns=columns)

    schema = key_schema(rows, keys) + f"{fold} int, {id_column} long, y_pred double, proba array<double>, error string"
    scored = test.groupBy(*by, "_part").cogroup(fitted.groupBy(*by, "_part")).applyInPandas(score, schema)
    failed = models.where(F.col("error").isNotNull()).select(
        *by, F.lit(None).cast("long").alias(id_column), F.lit(None).cast("double").alias("y_pred"),
        F.lit(None).cast("array<double>").alias("proba"), "error")
    broken = scored.where(F.col("error").isNotNull()).dropDuplicates([*by, "error"])
    return scored.where(F.col("error").isNull()).unionByName(broken).unionByName(failed)


# ---------------------------------------------------------------- weighted ensemble


def cawpe_ensemble(validation: DataFrame, test: DataFrame, components: Sequence[str], *, alpha: float = 4.0,
                   keys: Sequence[str] = ("task", "fold"), id_column: str = "spectrum_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Probabilities of the components weighted by validation accuracy^alpha (all zero: equally), normalized.

    Inputs: keys, model, id, y_true, proba. Only folds all components finished; components on different rows
    raise.
    """
    from spectrafold.functions.metrics import full_proba, predicted_class

    keys, need = list(keys), len(components)
    wanted = F.col("model").isin(*components)
    hit = (predicted_class(F.col("proba")) == F.col("y_true").cast("int")).cast("double")
    weights = validation.where(wanted).groupBy(*keys, "model").agg(F.pow(F.avg(hit), F.lit(float(alpha))).alias("_w"))
    fold = W.partitionBy(*keys)  # at most one row per component
    weights = weights.withColumn("_k", F.count(F.lit(1)).over(fold)).withColumn("_sum", F.sum("_w").over(fold)).where(
        F.col("_k") == need).withColumn("_w", F.when(F.col("_sum") == 0, 1.0).otherwise(F.col("_w"))).select(*keys, "model", "_w")
    rows = test.where(wanted).select(*keys, "model", id_column, "y_true", full_proba(F.col("proba")).alias("_p"))
    sizes = rows.groupBy(*keys, "model").agg(F.count(F.lit(1)).alias("_n"))
    complete = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") == need).select(*keys)
    table = weights.join(sizes, [*keys, "model"]).join(complete, keys)
    rows = with_values(rows, table, [*keys, "model"], ["_w"]).where(F.col("_w").isNotNull())
    mixed = rows.groupBy(*keys, id_column).agg(
        F.max("y_true").alias("y_true"), F.count(F.lit(1)).alias("_k"),
        vector_to_array(Summarizer.sum(array_to_vector(F.transform("_p", lambda p: p * F.col("_w"))))).alias("_s"))
    total = F.aggregate("_s", F.lit(0.0), lambda a, v: a + v)
    proba = F.transform("_s", lambda v: v / F.when(total == 0, 1.0).otherwise(total))
    checked = F.when(F.col("_k") == need, proba).otherwise(
        F.raise_error(F.lit("the components were run on different rows")).cast("array<double>"))
    return mixed.select(*keys, id_column, "y_true", checked.alias("proba"))


def ensemble_times(results: DataFrame, components: Sequence[str], keys: Sequence[str] = ("task", "fold")) -> DataFrame:
    """Train and inference times of an ensemble: the sums over its components, on folds all of them finished."""
    return results.where(F.col("model").isin(*components)).groupBy(*keys).agg(
        F.sum("time_train_s").alias("time_train_s"), F.sum("time_infer_s").alias("time_infer_s"),
        F.count_distinct("model").alias("_k")).where(F.col("_k") == len(components)).drop("_k")
