"""Elo ratings: a Bradley-Terry fit over task-weighted head-to-head results, with a task bootstrap."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.operators.ordering import hash_order, with_values
from spectrafold.operators.ranking import as_cells, pair_scores
from spectrafold.session import materialize

SCALE = 400.0
RIDGE = 1e-6
#: Cells of the (rounds x models x models) table a task adds up at once.
PAIR_CELLS = 4_000_000


def poisson_weights(task: Column, rounds: int, seed: int) -> Column:
    """How often each bootstrap round draws a task: Poisson(1) from a hash, independent of partitioning."""
    bounds, p, total = [], math.exp(-1.0), 0.0
    for k in range(12):
        total += p
        bounds.append(total)
        p /= k + 1

    def draw(u: Column) -> Column:
        out = F.when(u < bounds[0], 0.0)
        for k, b in enumerate(bounds[1:], 1):
            out = out.when(u < b, float(k))
        return out.otherwise(float(len(bounds)))

    # 40 bits of the hash, once for each round.
    unit = lambda r: F.conv(F.substring(hash_order(seed, r, task), 1, 10), 16, 10).cast("double") / float(1 << 40)
    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), unit), draw)


def fit_ratings(score: np.ndarray, n: np.ndarray, iterations: int = 100) -> np.ndarray:
    """Bradley-Terry strengths (logits) from pairwise scores: Newton's method with a tiny ridge.

    ``score[i, j]`` is the weighted number of wins of i over j (ties half), ``n[i, j]`` of their battles.
    """
    k = len(n)
    theta = np.zeros(k)
    total = n.sum()
    if total == 0:
        return theta
    score, n = score / total, n / total

    def objective(t):
        d = t[:, None] - t[None, :]
        return np.sum(score * np.logaddexp(0.0, -d)) + 0.5 * RIDGE * t @ t

    value = objective(theta)
    for _ in range(iterations):
        p = 1.0 / (1.0 + np.exp(-(theta[:, None] - theta[None, :])))
        gradient = (n * p - score).sum(axis=1) + RIDGE * theta
        curvature = n * p * (1 - p)
        hessian = np.diag(curvature.sum(axis=1) + RIDGE) - curvature
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-8:
            trial = theta - size * step
            trial_value = objective(trial)
            if trial_value <= value + 1e-18:
                break
            size /= 2
        moved = np.abs(size * step).max()
        theta, value = trial, trial_value
        if moved < 1e-10:
            break
    return theta - theta.mean()


def learnable_draw(results: DataFrame) -> DataFrame:
    """Tasks without any learnable model count as draws: every error there becomes the same."""
    known = results.groupBy("dataset").agg(F.max(F.coalesce("learnable", F.lit(False))).alias("_any"), F.count(F.lit(1)).alias("_n"))
    rows = with_values(results, known, ["dataset"], ["_any"])
    return rows.withColumn("metric_error", F.when(F.col("_any"), F.col("metric_error")).otherwise(0.0)).drop("_any")


def weighted_cells(rows: DataFrame, rounds: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Cells of :func:`pair_scores`: every task has the same total weight, times its draws per round.

    *rows*: *by*, dataset, fold, model, error. Rounds are cut into chunks so that one task's (round, model, model)
    sums stay small.
    """
    cells = as_cells(rows, [*by, "dataset", "fold"])
    cells = cells.withColumn("_pairs", F.size("models") * (F.size("models") - 1) / 2.0).where(F.col("_pairs") > 0)
    per_task = cells.groupBy(*by, "dataset").agg(F.sum("_pairs").alias("_all"))
    cells = with_values(cells, per_task, [*by, "dataset"], ["_all"])
    n_models = rows.select("model").distinct().agg(F.count(F.lit(1))).scalar()
    width = F.greatest(F.lit(1), F.floor(F.lit(PAIR_CELLS) / (n_models * n_models)).cast("int"))
    cells = cells.withColumn("_w", poisson_weights(F.col("dataset"), rounds, seed)).withColumn("_width", width)
    return cells.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(rounds) / F.col("_width")).cast("int") - 1))).select(
        *by, "chunk", "models", "errors",
        F.transform(F.slice("_w", F.col("chunk") * F.col("_width") + 1, F.col("_width")), lambda d: d / F.col("_all")).alias("weights"),
        "_width")


def elo(results: DataFrame, *, reference_model: str | None = "RF", rounds: int = 200, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """(model, elo, elo_plus, elo_minus): median over bootstrap rounds and the distance to the 97.5 / 2.5 %
    points, with the reference model at 1000. A model without any battle gets 1000. With *by* each group has its own ratings.

    Each (dataset, fold) is a comparison of the models present. Rounds are fitted on executors; a worker sees
    one round's pair table.
    """
    by = list(by)
    rows = materialize(results.groupBy(*by, "dataset", "fold", "model").agg(F.min("metric_error").alias("error")))
    names = rows.select(*by, "model").distinct()
    cells = weighted_cells(rows, rounds, seed, by)
    n_models = rows.select("model").distinct().agg(F.count(F.lit(1))).scalar()
    width = F.greatest(F.lit(1), F.floor(F.lit(PAIR_CELLS) / (n_models * n_models)).cast("int"))
    pairs = pair_scores(cells, [*by, "chunk"]).withColumn("round", F.col("chunk") * width + F.col("round"))

    def rate(pdf: pd.DataFrame) -> pd.DataFrame:
        models = sorted(set(pdf["model_i"]) | set(pdf["model_j"]))
        at = {m: i for i, m in enumerate(models)}
        i, j = pdf["model_i"].map(at).to_numpy(), pdf["model_j"].map(at).to_numpy()
        score, n = np.zeros((len(models),) * 2), np.zeros((len(models),) * 2)
        score[i, j], n[i, j] = pdf["score"], pdf["n"]
        rating = 1000.0 + SCALE / math.log(10.0) * fit_ratings(score, n)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in by}, "round": pdf["round"].iloc[0], "model": models, "rating": rating})

    typed = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in by)
    rated = pairs.groupBy(*by, "round").applyInPandas(rate, f"{typed}round int, model string, rating double")
    # One rating per round and model: the percentile of a model is over at most `rounds` values.
    points = materialize(rated.groupBy(*by, "model").agg(F.percentile("rating", F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975))).alias("q")))
    at = points.where(F.lit(False) if reference_model is None else F.col("model") == reference_model).groupBy(*by).agg(F.max(F.col("q")[0]).alias("_at"))
    shift = F.coalesce(1000.0 - F.col("_at"), F.lit(0.0))
    out = with_values(points, at, by, ["_at"]).select(
        *by, "model", (F.col("q")[0] + shift).alias("elo"), (F.col("q")[2] - F.col("q")[0]).alias("elo_plus"),
        (F.col("q")[0] - F.col("q")[1]).alias("elo_minus"))
    return names.join(out, [*by, "model"], "left").select(
        *by, "model", F.coalesce("elo", F.lit(1000.0)).alias("elo"), F.coalesce("elo_plus", F.lit(0.0)).alias("elo_plus"),
        F.coalesce("elo_minus", F.lit(0.0)).alias("elo_minus"))
