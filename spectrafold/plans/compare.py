"""A user's results against the reference: coverage, merge, choice of metric, imputation and the board in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.operators import ranking, results
from spectrafold.session import materialize


@dataclass
class Comparison:
    """What :func:`compare` finds: the board, the filled rows behind it, what the own models ran, and rows off the protocol."""

    board: DataFrame
    filled: DataFrame
    coverage: DataFrame
    outside: DataFrame


def standings(filled: DataFrame) -> DataFrame:
    """One row per model without ratings: normalized score, rank, improvability, win rate, tasks and imputed share."""
    imputed = filled.groupBy("model").agg((F.avg(F.col("imputed").cast("double")) * 100).alias("imputed_pct"))
    errors = ranking.per_task(filled)
    return ranking.standing(errors).join(ranking.winrate(ranking.winrate_matrix(errors)), "model").join(imputed, "model")


def compare(
    own: DataFrame, reference: DataFrame, protocol: DataFrame, *, fold_metrics: DataFrame | None = None, classification: str | None = None,
    regression: str | None = None, replace: bool = False, tasks: str = "all", reference_model: str = "RF",
    max_imputed_pct: float = 50.0, ratings: bool = True, rounds: int = 200,
) -> Comparison:
    """Rank the models of *own* (tidy per-fold results) among those of *reference* on the tasks of *protocol*.

    *fold_metrics* replaces metric columns of the own rows; *classification* and *regression* choose the ranking metric;
    *replace* lets own rows take the place of reference models of the same name; ``tasks="own"`` keeps the tasks that the own
    models ran. Missing cells are filled with *reference_model*, which must have results. With *ratings* the board has Elo
    ratings from *rounds* bootstrap rounds.
    """
    kept, outside = results.load_own_results(own, protocol)
    if fold_metrics is not None:
        kept = results.attach_fold_metrics(kept, fold_metrics)
    covered = results.coverage(kept, protocol)
    merged = results.merge_reference(kept, reference, replace=replace, tasks=tasks)
    if classification or regression:
        merged = results.select_metric(merged, classification=classification, regression=regression)
    if merged.where(F.col("model") == reference_model).isEmpty():
        raise ValueError(f"the reference model {reference_model!r} has no results to fill cells with")
    filled = materialize(results.impute_missing(merged, reference_model=reference_model, max_imputed_pct=max_imputed_pct))
    board = standings(filled)
    if ratings:
        from spectrafold.operators.elo import elo

        board = board.join(elo(filled, reference_model=reference_model, rounds=rounds), "model")
    return Comparison(board.withColumn("own", F.col("model").isin([r[0] for r in kept.select("model").distinct().collect()])), filled, covered, outside)
