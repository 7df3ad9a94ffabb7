"""Scores and ranks of models over tasks: normalized score, average rank, win rates, fronts, leaderboards.

Per-fold rows are averaged per (task, model) first; from there a task has at most one row per model.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.operators.ordering import HOT_ROWS, best_before, exact_median, with_values
from spectrafold.operators.results import impute_missing
from spectrafold.session import materialize


def per_task(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean error per (dataset, model) over folds; a table of such errors (dataset, model, error) is handed back."""
    if "metric_error" not in results.columns:
        return results
    return results.groupBy(*by, "dataset", "model").agg(F.avg("metric_error").alias("error"))


def scaled_score(error: Column, best: Column, median: Column) -> Column:
    """best = 1, median = 0, clipped at 0; if the median equals the best (1e-12), 1 for errors up to the median and 0 above."""
    gap = median - best
    return F.when(gap > 1e-12, F.greatest((median - error) / gap, F.lit(0.0))).otherwise((error <= median).cast("double"))


def normalized_scores(errors: DataFrame) -> DataFrame:
    """:func:`scaled_score` per (dataset, model)."""
    stats = errors.groupBy("dataset").agg(F.min("error").alias("_best"), F.median("error").alias("_median"))
    score = scaled_score(F.col("error"), F.col("_best"), F.col("_median"))
    return errors.join(stats, "dataset").select("dataset", "model", "error", score.alias("score"))


def normalized_score(results: DataFrame) -> DataFrame:
    """Mean normalized score per model."""
    return normalized_scores(per_task(results)).groupBy("model").agg(F.avg("score").alias("normalized_score"))


def task_ranks(errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average rank (ties share their mean position), best error and improvability per (dataset, model)."""
    task = W.partitionBy(*by, "dataset")
    first = F.rank().over(task.orderBy("error"))
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, "dataset", "error"))
    best = F.min("error").over(task)
    return errors.withColumn("rank", first + (ties - 1) / 2.0).withColumn("best", best).withColumn(
        "improvability", F.when(F.col("error") == 0, 0.0).otherwise((1 - F.col("best") / F.col("error")) * 100.0))


def mean_ranks(results: DataFrame) -> DataFrame:
    """Mean average rank and improvability per model over tasks."""
    return task_ranks(per_task(results)).groupBy("model").agg(
        F.avg("rank").alias("rank"), F.avg("improvability").alias("improvability"))


def standing(errors: DataFrame, by: Sequence[str] = (), rounds: int = 0, seed: int = 42) -> DataFrame:
    """Normalized score, average rank, improvability and number of tasks per model (within *by*); with *rounds* also the
    distance from its mean improvability to the 97.5 and 2.5 % points over a bootstrap of tasks.

    A task's models meet once, in one exchange; from there a model's columns are one aggregate. All rounds are summed in it:
    a row carries its task's draws as a vector.
    """
    from spectrafold.operators.elo import poisson_weights

    rows = task_ranks(errors, by).withColumn("_median", F.median("error").over(W.partitionBy(*by, "dataset")))
    rows = rows.withColumn("score", scaled_score(F.col("error"), F.col("best"), F.col("_median")))
    found = [F.avg("score").alias("normalized_score"), F.avg("rank").alias("rank"), F.avg("improvability").alias("_mean"),
             F.count(F.lit(1)).alias("n_tasks")]
    if not rounds:
        return rows.groupBy(*by, "model").agg(*found).withColumnRenamed("_mean", "improvability")
    rows = rows.withColumn("_w", poisson_weights(F.col("dataset"), rounds, seed))
    value = F.transform("_w", lambda w: w * F.col("improvability"))
    sums = rows.groupBy(*by, "model").agg(
        *found, vector_to_array(Summarizer.sum(array_to_vector(value))).alias("_v"),
        vector_to_array(Summarizer.sum(array_to_vector("_w"))).alias("_n"))
    means = sums.withColumn("_q", F.sort_array(F.filter(F.zip_with("_v", "_n", lambda v, n: F.when(n > 0, v / n)), lambda m: m.isNotNull())))
    at = lambda p: F.get("_q", F.least(F.floor(F.size("_q") * p).cast("int"), F.size("_q") - 1))
    return means.withColumn("improvability_plus", F.greatest(at(0.975) - F.col("_mean"), F.lit(0.0))).withColumn(
        "improvability_minus", F.greatest(F.col("_mean") - at(0.025), F.lit(0.0))).withColumnRenamed("_mean", "improvability").drop("_v", "_n", "_q")


def improvability_interval(results: DataFrame, rounds: int = 200, seed: int = 42) -> DataFrame:
    """Distance from a model's mean improvability to its 97.5 and 2.5 % points over a bootstrap of tasks."""
    return standing(per_task(results), (), rounds, seed).select("model", "improvability_plus", "improvability_minus")


# ---------------------------------------------------------------- pairs of models

TILE = 512
BUDGET = 256 * 1024 * 1024


def pair_scores(cells: DataFrame, keys: Sequence[str] = ("chunk",), tile: int = TILE, budget: int = BUDGET) -> DataFrame:
    """Weighted head-to-head sums: (*keys*, round, model_i, model_j, score, n) for i != j.

    *cells*: *keys*, models ARRAY<STRING>, errors ARRAY<DOUBLE>, weights ARRAY<DOUBLE> (one per round). A cell
    is one comparison of the models it lists. Pairs are never rows: a task adds up model x model matrices
    for its cells (in tiles, flushed when they exceed *budget*) and emits each pair once.
    """
    keys = list(keys)
    typed = "".join(f"`{k}` {cells.schema[k].dataType.simpleString()}, " for k in keys)
    schema = f"{typed}round int, model_i string, model_j string, score double, n double"

    def widen(pair, rounds, size):
        """The (score, n) matrices of a tile with room for *size* models."""
        if pair is not None and pair[0].shape[1] >= size:
            return pair
        new = np.zeros((2, rounds, size, size))
        if pair is not None:
            new[:, :, : pair[0].shape[1], : pair[0].shape[1]] = pair
        return new[0], new[1]

    def add_up(batches):
        codes: dict[str, int] = {}
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        kinds: list[pa.DataType] = []

        def flush():
            names = np.array(list(codes), dtype=object)
            for (of, bi, bj), (score, n) in held.items():
                r, i, j = np.nonzero(n)
                off = i + bi * tile != j + bj * tile
                r, i, j = r[off], i[off], j[off]
                yield pa.RecordBatch.from_arrays([
                    *[pa.array([v] * len(r), kind) for v, kind in zip(of, kinds)], pa.array(r.astype(np.int32)),
                    pa.array(names[i + bi * tile], pa.string()), pa.array(names[j + bj * tile], pa.string()),
                    pa.array(score[r, i, j]), pa.array(n[r, i, j])],
                    names=[*keys, "round", "model_i", "model_j", "score", "n"])
            held.clear()

        for batch in batches:
            kinds = [batch.column(k).type for k in keys]
            cell_keys = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            models, errors, weights = (batch.column(c).to_pylist() for c in ("models", "errors", "weights"))
            for of, ms, es, ws in zip(cell_keys, models, errors, weights):
                at = np.array([codes.setdefault(m, len(codes)) for m in ms])
                e, w = np.array(es, dtype=float), np.array(ws, dtype=float)
                for bi in np.unique(at // tile):
                    for bj in np.unique(at // tile):
                        left, right = at // tile == bi, at // tile == bj
                        need = min(tile, max(16, 1 << (len(codes) - 1).bit_length()))
                        score, n = held[of, bi, bj] = widen(held.get((of, bi, bj)), len(w), need)
                        ei, ej = e[left][:, None], e[right][None, :]
                        won = (ei < ej) + 0.5 * (ei == ej)
                        box = np.ix_(np.arange(len(w)), at[left] - bi * tile, at[right] - bj * tile)
                        score[box] += w[:, None, None] * won
                        n[box] += w[:, None, None]
                if sum(a.nbytes + b.nbytes for a, b in held.values()) > budget:
                    yield from flush()
        yield from flush()

    parts = cells.select(*keys, "models", "errors", "weights").mapInArrow(add_up, schema)
    return parts.groupBy(*keys, "round", "model_i", "model_j").agg(F.sum("score").alias("score"), F.sum("n").alias("n"))


def as_cells(rows: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    """One row per comparison (*keys*): its models and errors. A model occurs once, so a row is as long as the
    list of models."""
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("model", F.col(error).alias("e")))).alias("_p"))
    return packed.select(*keys, F.col("_p.model").alias("models"), F.col("_p.e").alias("errors"))


def winrate_matrix(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(model_i, model_j, winrate): share of shared tasks where i has the lower mean error, ties count half."""
    cells = as_cells(per_task(results, by), [*by, "dataset"]).withColumn("chunk", F.lit(0)).withColumn("weights", F.array(F.lit(1.0)))
    return pair_scores(cells, [*by, "chunk"]).select(
        *by, "model_i", "model_j", (F.col("score") / F.col("n")).alias("winrate"), F.col("n").cast("long").alias("n_tasks"))


def winrate(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean win rate of a model over its opponents."""
    return matrix.groupBy(*by, F.col("model_i").alias("model")).agg(F.avg("winrate").alias("winrate"))


def battles(results: DataFrame) -> DataFrame:
    """Per pair of models (by name): wins of the first, ties, wins of the second over (dataset, fold) cells."""
    cells = as_cells(results.groupBy("dataset", "fold", "model").agg(F.min("metric_error").alias("error")), ["dataset", "fold"])
    scores = pair_scores(cells.withColumn("chunk", F.lit(0)).withColumn("weights", F.array(F.lit(1.0))))
    c = F.col
    pairs = scores.groupBy(F.least("model_i", "model_j").alias("model_i"), F.greatest("model_i", "model_j").alias("model_j")).agg(
        F.sum(F.when(c("model_i") < c("model_j"), c("score"))).alias("_i"), F.max("n").alias("n_battles"))
    # With W wins, T ties and n battles the score is W + T/2.
    return pairs.select("model_i", "model_j", c("_i").alias("score_i"), (c("n_battles") - c("_i")).alias("score_j"),
                        c("n_battles").cast("long").alias("n_battles"))


# ---------------------------------------------------------------- leaderboards

TIMES = ("time_train_s", "time_infer_s", "time_total_s", "infer_per_1k_s", "time_total_per_1k_s")


def median_times(filled: DataFrame, n_splits: int = 3, *, hot_rows: int = HOT_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Exact medians of the measured (not imputed) times per model, also per 1,000 spectra."""
    real = filled.where(~F.col("imputed")) if "imputed" in filled.columns else filled
    c = F.col
    real = real.withColumn("time_total_s", c("time_train_s") + c("time_infer_s"))
    names = list(TIMES[:3])
    if "num_instances" in filled.columns:
        real = real.withColumn("infer_per_1k_s", c("time_infer_s") / (c("num_instances") / n_splits) * 1000.0).withColumn(
            "time_total_per_1k_s", c("time_total_s") / c("num_instances") * 1000.0)
        names = list(TIMES)
    long = real.unpivot([*by, "model"], names, "measure", "seconds")
    medians = exact_median(long, [*by, "model", "measure"], "seconds", "median", hot_rows=hot_rows)
    return medians.groupBy(*by, "model").agg(
        *[F.max(F.when(c("measure") == m, c("median"))).alias(f"median_{m}") for m in names])


#: The column that holds a row's task group on boards.
GROUP = "evaluated_on"


def in_groups(results: DataFrame, groups: Sequence[str]) -> DataFrame:
    """*results* once for each of *groups* (task types, ``all``) that a row counts in. Models that ran some of the task types
    only don't count in ``all``."""
    types = results.groupBy("model").agg(F.count_distinct("task").alias("_t"))
    n_types = results.agg(F.count_distinct("task")).scalar()
    rows = with_values(results, types.withColumn("_whole", F.col("_t") == n_types), ["model"], ["_whole"])
    counts_in = [F.when(F.col("task") == g, F.lit(g)) for g in groups if g != "all"]
    if "all" in groups:
        counts_in.append(F.when(F.col("_whole"), F.lit("all")))
    return rows.withColumn(GROUP, F.explode(F.array_compact(F.array(*counts_in)))).drop("_whole")


def group_boards(results: DataFrame, groups: Sequence[str], *, reference_model: str = "RF", max_imputed_pct: float = 50.0,
                 rounds: int = 200, n_splits: int = 3, references: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(boards without ratings, filled results) of *groups*, both with the group as a key: one plan for all of them."""
    by = [GROUP]
    # Every column of the boards reads these rows; compute them once.
    filled = materialize(impute_missing(in_groups(results, groups), reference_model=reference_model, max_imputed_pct=max_imputed_pct, by=by))
    errors = per_task(filled, by)
    imputed = filled.groupBy(*by, "model").agg((F.avg(F.col("imputed").cast("double")) * 100).alias("imputed_pct"))
    keys = [*by, "model"]
    board = (
        standing(errors, by, rounds).join(winrate(winrate_matrix(errors, by), by), keys)
        .join(median_times(filled, n_splits, hot_rows=hot_rows, by=by), keys, "left").join(imputed, keys)
        .withColumn("is_reference", F.col("model").isin(*references) if references else F.lit(False)))
    return materialize(board), filled


def score_group(results: DataFrame, group: str = "all", *, reference_model: str = "RF", rounds: int = 200, **kwargs) -> tuple[DataFrame, DataFrame]:
    """(leaderboard, filled results) of one task group (all / classification / regression).

    For ``all`` a model that ran one task type only is left out here; see :func:`add_subset_models`.
    """
    from spectrafold.operators.elo import elo

    board, filled = group_boards(results, [group], reference_model=reference_model, rounds=rounds, **kwargs)
    ratings = elo(filled, reference_model=reference_model, rounds=rounds)
    return board.join(ratings, "model"), filled.drop(GROUP)


def add_subset_models(board: DataFrame, filled: DataFrame, subsets: dict[str, tuple[DataFrame, DataFrame]], *,
                      reference_model: str = "RF", rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """Add models that ran one task type only to the all-tasks board.

    Ratings are fitted again on all rows together; the other columns come from the model's own group.
    """
    from spectrafold.operators.elo import elo

    ranked = board.select("model")
    extra_rows, extra_cells = None, None
    for name, (sub, cells) in subsets.items():
        single = sub.select("model").join(ranked, "model", "left_anti")
        rows = sub.join(single, "model", "left_semi").withColumn("evaluated_on", F.lit(name))
        part = cells.join(single, "model", "left_semi")
        extra_rows = rows if extra_rows is None else extra_rows.unionByName(rows, allowMissingColumns=True)
        extra_cells = part if extra_cells is None else extra_cells.unionByName(part, allowMissingColumns=True)
    if extra_rows is None:
        return board, filled
    everything = materialize(filled.unionByName(extra_cells, allowMissingColumns=True))
    ratings = elo(everything, reference_model=reference_model, rounds=rounds)
    merged = board.unionByName(extra_rows, allowMissingColumns=True).drop("elo", "elo_plus", "elo_minus")
    return merged.join(ratings, "model"), everything


def score_all(results: DataFrame, groups: Sequence[str] = ("classification", "regression"), *, reference_model: str = "RF",
              rounds: int = 200, **kwargs) -> DataFrame:
    """The leaderboards of every task group in one table with a ``group`` column.

    The group is a key through all steps, so their number does not grow with the groups. Models that are on a group's board
    but not on that of all tasks join the latter as in :func:`add_subset_models`.
    """
    from spectrafold.operators.elo import elo

    keys = [GROUP, "model"]
    boards, filled = group_boards(materialize(results), [*groups, "all"], reference_model=reference_model, rounds=rounds, **kwargs)
    part = F.col(GROUP) != "all"
    added = boards.where(part).join(boards.where(~part).select("model"), "model", "left_anti")
    cells = filled.join(added.select(*keys), keys, "left_semi").withColumn(GROUP, F.lit("all"))
    ratings = elo(filled.unionByName(cells), reference_model=reference_model, rounds=rounds, by=[GROUP]).withColumnRenamed(GROUP, "group")
    rows = boards.withColumn("group", F.col(GROUP)).unionByName(added.withColumn("group", F.lit("all")))
    return rows.join(ratings, ["group", "model"])


def split_references(board: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranked models, reference systems)."""
    flag = F.coalesce("is_reference", F.lit(False)) if "is_reference" in board.columns else F.lit(False)
    return board.where(~flag), board.where(flag)


def by_release(board: DataFrame) -> DataFrame:
    """Ranked models with a release date, with their position: oldest first, same day best first."""
    dated = split_references(board)[0].where(F.col("release_date").isNotNull())
    return dated.withColumn("position", F.row_number().over(W.orderBy("release_date", F.desc("elo"), "model")))


def record_holders(board: DataFrame) -> DataFrame:
    """Models that beat every earlier one in release order."""
    ordered = by_release(board)
    before = F.max("elo").over(W.orderBy("position").rowsBetween(W.unboundedPreceding, -1))
    return ordered.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("elo") > F.col("_before"))).drop("_before")


def select_focus(board: DataFrame, top_k: int | None, always: Sequence[str] = ()) -> DataFrame:
    """The *top_k* best models of every category plus the named ones (all ranked models without *top_k*)."""
    ranked = split_references(board)[0]
    if not top_k:
        return ranked.select("model")
    position = F.row_number().over(W.partitionBy("category").orderBy(F.desc("elo"), "model"))
    keep = F.col("_i") <= top_k
    if always:
        keep = keep | F.col("model").isin(*always)
    return ranked.withColumn("_i", position).where(keep).select("model")


def pareto_front(df: DataFrame, x: str, y: str, higher_is_better: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Rows with a strictly better *y* than every row of lower *x* (equal *x*: the better one first)."""
    value = F.col(y) if higher_is_better else -F.col(y)
    rows = best_before(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, x, value)
    over = W.partitionBy(*by, "_range").orderBy(F.col(x), value.desc(), F.col("model")).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_best", F.greatest(F.max(value).over(over), "_earlier")).where(
        F.col("_best").isNull() | (value > F.col("_best"))).drop("_best", "_range", "_earlier")


def near_pareto(df: DataFrame, x: str, y: str, tolerance: float = 0.1, higher_is_better: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Rows within *tolerance* of the best *y* reached at the same or lower *x* (as-of: a running maximum)."""
    value = F.col(y) if higher_is_better else -F.col(y)
    rows = best_before(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, x, value)
    upto = W.partitionBy(*by, "_range").orderBy(x).rangeBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("gap", F.greatest(F.max(value).over(upto), "_earlier") - value).where(
        F.col("gap") <= tolerance).drop("_range", "_earlier")


def pareto_selection(boards: DataFrame, x: str = "median_time_total_per_1k_s", y: str = "normalized_score", tolerance: float = 0.1) -> DataFrame:
    """Models near the front of any task type (of all tasks when there is no board per type)."""
    near = near_pareto(split_references(boards)[0], x, y, tolerance, by=["group"])
    typed = near.where(F.col("group") != "all")
    has_types = boards.where(F.col("group") != "all").agg(F.count(F.lit(1)) > 0).scalar()
    return typed.unionByName(near.where((F.col("group") == "all") & ~has_types)).select("model").distinct()


# ---------------------------------------------------------------- the older board


def legacy_scores(metrics: DataFrame, metric: str, higher_is_better: bool) -> DataFrame:
    """(model, key, norm_score, rank): seed means scaled to best = 1, median = 0, clipped to 0..1; minimum
    rank; keys with one model are skipped."""
    value = F.col(metric) if higher_is_better else -F.col(metric)
    mean = metrics.where(F.col(metric).isNotNull()).groupBy("model", "key").agg(F.avg(value).alias("_e"))
    stats = mean.groupBy("key").agg(F.median("_e").alias("_median"), F.max("_e").alias("_best"), F.count(F.lit(1)).alias("_k")).where(
        F.col("_k") >= 2)
    gap = F.col("_best") - F.col("_median")
    score = F.when(gap > 0, F.least(F.greatest((F.col("_e") - F.col("_median")) / gap, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    rank = F.rank().over(W.partitionBy("key").orderBy(F.desc("_e")))
    return mean.join(stats, "key").select("model", "key", score.alias("norm_score"), rank.cast("double").alias("rank"))


def legacy_leaderboard(scores: DataFrame) -> DataFrame:
    """Mean score and rank per model; a missing (model, key) counts as score 0 and the key's worst rank + 1."""
    # Missing pairs need no completion: their scores are 0, their ranks sum to (all penalties - own penalties).
    keys = scores.groupBy("key").agg((F.max("rank") + 1).alias("_penalty"))
    n_keys = keys.agg(F.count(F.lit(1))).scalar()
    penalties = keys.agg(F.sum("_penalty")).scalar()
    own = scores.join(keys, "key").groupBy("model").agg(
        F.sum("norm_score").alias("_score"), F.sum("rank").alias("_rank"), F.sum("_penalty").alias("_pen"))
    score = F.col("_score") / n_keys
    return own.select(
        F.col("model").alias("model_id"), F.round(score, 4).alias("score"),
        F.round((F.col("_rank") + penalties - F.col("_pen")) / n_keys, 1).alias("avg_rank"),
        F.round((1 - score) * 100, 1).alias("improvability"))


def leaderboard_rank(board: DataFrame, score: str = "score", tie: str = "model_id") -> DataFrame:
    """Sorted by score with the position in front."""
    ranked = board.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), tie)))
    return ranked.select("rank", *board.columns)


def add_results(metrics: DataFrame, model: str, new: DataFrame, metric: str, higher_is_better: bool) -> DataFrame:
    """The older board with one more model: append its per-seed metrics and score everyone again."""
    rows = new.withColumn("model", F.lit(model)).select("seed", "key", "model", metric)
    both = metrics.select("seed", "key", "model", metric).unionByName(rows)
    return legacy_leaderboard(legacy_scores(both, metric, higher_is_better))


def merge_meta(board: DataFrame, meta: DataFrame) -> DataFrame:
    """Display columns of *meta* on ``model_id``; the id stands in for a missing display name."""
    out = board.join(meta, "model_id", "left")
    name = F.coalesce("display_name", "model_id") if "display_name" in meta.columns else F.col("model_id")
    return out.withColumn("display_name", name)


# ---------------------------------------------------------------- significance


def chi2_tail(x: float, df: float) -> float:
    """P(chi-squared with *df* degrees of freedom > x): regularized incomplete gamma function."""
    a, half = df / 2.0, x / 2.0
    if half <= 0:
        return 1.0
    front = math.exp(-half + a * math.log(half) - math.lgamma(a))
    if half < a + 1:  # series
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= half / k
            total += term
        return max(0.0, 1.0 - front * total)
    b, c, d = half + 1 - a, 1e300, 1.0 / (half + 1 - a)  # continued fraction
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b if an * d + b else 1e-300)
        c = b + an / c if c else 1e300
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return front * h


def studentized_range_quantile(q: float, k: int) -> float:
    """Quantile of the range of *k* independent standard normals (infinite degrees of freedom)."""
    z = np.linspace(-8.5, 8.5, 3401)
    density = np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    grid = np.linspace(-30, 30, 24001)
    phi = np.array([0.5 * (1 + math.erf(v / np.sqrt(2))) for v in grid])
    cdf = lambda v: np.interp(v, grid, phi)
    prob = lambda r: np.trapezoid(k * density * (cdf(z + r) - cdf(z)) ** (k - 1), z)
    low, high = 0.0, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if prob(mid) < q else (low, mid)
    return (low + high) / 2


def complete_tasks(errors: DataFrame) -> DataFrame:
    """Errors on the tasks for which every model has one."""
    n_models = errors.groupBy("model").count().agg(F.count(F.lit(1))).scalar()
    full = errors.groupBy("dataset").agg(F.count("error").alias("_k")).where(F.col("_k") == n_models).select("dataset")
    return errors.join(full, "dataset", "left_semi")


def friedman(results: DataFrame) -> tuple[DataFrame, dict]:
    """(mean rank per model on complete tasks, Friedman statistic with tie correction and its p-value)."""
    ranks = task_ranks(complete_tasks(per_task(results)))
    mean = ranks.groupBy("model").agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("_n"))
    tied = ranks.groupBy("dataset", "error").agg(F.count(F.lit(1)).cast("double").alias("_t")).agg(
        F.coalesce(F.sum(F.pow("_t", F.lit(3.0)) - F.col("_t")), F.lit(0.0))).scalar()
    s = mean.agg(F.count(F.lit(1)), F.max("_n"), F.sum(F.col("mean_rank") * F.col("mean_rank")), tied).first()
    k, n = s[0], s[1] or 0
    if n < 5 or k < 2:
        raise ValueError(f"{n} complete tasks and {k} models; the test needs at least 5 tasks and 2 models")
    chi2 = 12.0 * n / (k * (k + 1)) * s[2] - 3.0 * n * (k + 1)
    correction = 1.0 - s[3] / (n * k * (k * k - 1.0))
    chi2 = chi2 / correction if correction > 0 else 0.0
    return mean.drop("_n"), {"models": k, "tasks": n, "chi2": chi2, "pvalue": chi2_tail(chi2, k - 1)}


def critical_difference(results: DataFrame, alpha: float = 0.05) -> tuple[DataFrame, DataFrame, dict]:
    """(mean ranks with position, maximal runs of models within the critical difference, test summary)."""
    mean, test = friedman(results)
    k, n = test["models"], test["tasks"]
    cd = studentized_range_quantile(1 - alpha, k) / np.sqrt(2.0) * np.sqrt(k * (k + 1) / (6.0 * n))
    test = {**test, "cd": float(cd), "alpha": alpha}
    ordered = mean.withColumn("position", F.row_number().over(W.orderBy("mean_rank", "model")))
    runs = ordered.withColumn("last", F.expr(
        f"max(position) OVER (ORDER BY mean_rank RANGE BETWEEN CURRENT ROW AND {float(cd)!r}D FOLLOWING)"))
    before = F.max("last").over(W.orderBy("position").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("_before", before).where(
        (F.col("last") > F.col("position")) & (F.col("_before").isNull() | (F.col("last") > F.col("_before"))))
    return ordered, runs.select(F.col("position").alias("first"), "last"), test
