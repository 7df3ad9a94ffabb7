"""Metrics per (task, fold, model) from prediction tables, as two-level aggregates.

Predictions are counted by truth and prediction first (:func:`prediction_cells`), with partial aggregation in the map
tasks; all metrics come from these cells. Nothing runs before the plan does, and a (task, fold, model) with a third of
all rows is not one task's work. NULL means "does not apply".
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrafold.functions.arrays import dot, let
from spectrafold.functions.metrics import FLOAT32_EPS, METRICS, full_proba, predicted_class, total_proba
from spectrafold.operators.ordering import HOT_ROWS, ordered

KEYS = ("task", "fold", "model")
LABEL_METRICS = ("accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro",
                 "precision_weighted", "recall_weighted", "f1_weighted", "mcc", "cohen_kappa")


def ratio(a, b) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def prediction_cells(predictions: DataFrame, keys: Sequence[str] = KEYS, task_type: str | None = None) -> DataFrame:
    """(keys, y_true, y_pred or proba or both, regression, n): how often each key has each truth and prediction.

    All metrics are functions of these counts, and counts of parts of the rows add up, so they are also what a stream keeps.
    *task_type* says what all rows are (only the column it needs is read), else ``problem_type`` does. Whether a cell is of a
    regression is an aggregate on purpose: a filter on it stays above the exchange, which both kinds then share; and rows with
    a null key, truth or prediction, which take no part, are left out before it for the same reason.
    """
    used = [x for x in {"classification": ["proba"], "regression": ["y_pred"]}.get(task_type, ["y_pred", "proba"]) if x in predictions.columns]
    kind = F.lit(task_type == "regression") if task_type else F.col("problem_type") == "regression"
    plain = {x for x in ("y_true", *used) if x == "proba" or predictions.schema[x].dataType == T.DoubleType()}  # no needless alias: it would tell branches apart
    rows = predictions.select(*keys, *[x if x in plain else F.col(x).cast("double").alias(x) for x in ("y_true", *used)], kind.alias("regression"))
    there = {"y_pred": F.col("regression"), "proba": ~F.col("regression")}
    given = reduce(lambda a, b: a | b, [there[x] & F.col(x).isNotNull() for x in used]) if not task_type else F.col(used[0]).isNotNull()
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*keys, "y_true")]) & given)
    return rows.groupBy(*keys, "y_true", *used).agg(F.max("regression").alias("regression"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- labels


def confusion(predictions: DataFrame, keys: Sequence[str] = KEYS, normalize: str | None = None,
              y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Counts by (y_true, y_pred); *normalize* over the true class, the predicted class or all rows."""
    out = predictions.groupBy(*keys, y_true, y_pred).agg(F.count(F.lit(1)).alias("n"))
    if normalize is None:
        return out
    over = {"true": [y_true], "pred": [y_pred], "all": []}[normalize]
    return out.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys, *over)))


def class_table(counts: DataFrame, keys: Sequence[str] = KEYS, y_true: str = "y_true", y_pred: str = "y_pred",
                sums: Sequence[str] = ()) -> DataFrame:
    """Per class of the true and predicted labels: tp, support (true rows), predicted rows, and *sums* over the true rows."""
    zero = F.lit(0).cast("long")
    true = F.struct(F.col(y_true).alias("label"), F.col("n").alias("support"), zero.alias("predicted"),
                    F.when(F.col(y_true) == F.col(y_pred), F.col("n")).otherwise(zero).alias("tp"), *[F.col(x) for x in sums])
    predicted = F.struct(F.col(y_pred).alias("label"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp"),
                         *[F.lit(0.0).alias(x) for x in sums])
    return counts.select(*keys, F.explode(F.array(true, predicted)).alias("s")).groupBy(*keys, F.col("s.label").alias("label")).agg(
        *[F.sum(f"s.{x}").alias(x) for x in ("tp", "support", "predicted", *sums)])


def classification_report(predictions: DataFrame, keys: Sequence[str] = KEYS, **names) -> DataFrame:
    """Precision, recall, F1 and support per class; a division by zero counts as 0."""
    c = F.col
    return class_table(confusion(predictions, keys, **names), keys, **names).select(
        *keys, "label", ratio(c("tp"), c("predicted")).alias("precision"), ratio(c("tp"), c("support")).alias("recall"),
        ratio(2 * c("tp"), c("support") + c("predicted")).alias("f1"), "support")


def label_metrics(counts: DataFrame, keys: Sequence[str] = KEYS, sums: Sequence[str] = ()) -> DataFrame:
    """All label metrics from a confusion table, and its columns *sums* added up."""
    c = F.col
    precision, recall = ratio(c("tp"), c("predicted")), ratio(c("tp"), c("support"))
    f1 = ratio(2 * c("tp"), c("support") + c("predicted"))
    s = F.sum("support")
    big = lambda name: c(name).cast("double")  # noqa: E731  (products of counts exceed a BIGINT)
    correct, cross = F.sum("tp"), F.sum(big("support") * big("predicted"))
    pp, tt = F.sum(big("predicted") * big("predicted")), F.sum(big("support") * big("support"))
    weighted = lambda m: F.sum(m * c("support")) / s
    agg = class_table(counts, keys, sums=sums).groupBy(*keys).agg(
        *[F.sum(x).alias(x) for x in sums],
        s.alias("n_test"), correct.alias("_correct"), cross.alias("_cross"), pp.alias("_pp"), tt.alias("_tt"),
        F.avg(F.when(c("support") > 0, recall)).alias("balanced_accuracy"),
        F.avg(precision).alias("precision_macro"), F.avg(recall).alias("recall_macro"), F.avg(f1).alias("f1_macro"),
        weighted(precision).alias("precision_weighted"), weighted(recall).alias("recall_weighted"),
        weighted(f1).alias("f1_weighted"))
    n = c("n_test").cast("double")
    spread = F.sqrt(n * n - c("_pp")) * F.sqrt(n * n - c("_tt"))
    chance = c("_cross") / (n * n)
    return agg.select(
        *keys, "n_test", (c("_correct") / n).alias("accuracy"), "balanced_accuracy", "precision_macro", "recall_macro",
        "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted",
        ratio(c("_correct") * n - c("_cross"), spread).alias("mcc"),
        F.when(chance == 1, F.lit(None)).otherwise((c("_correct") / n - chance) / (1 - chance)).alias("cohen_kappa"), *sums)


# ---------------------------------------------------------------- probabilities


def auc_of_cells(cells: DataFrame, keys: Sequence[str] = KEYS, average: str = "macro", *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """:func:`roc_auc` of :func:`prediction_cells`."""
    keys, c = list(keys), F.col
    several = F.size("proba") > 2
    scores = cells.select(*keys, "y_true", "n", several.alias("_many"), F.when(several, total_proba(c("proba"))).otherwise(1.0).alias("_t"),
                          F.posexplode(F.when(F.size("proba") == 2, F.slice("proba", 2, 1)).otherwise(c("proba"))).alias("_pos", "_s"))
    scores = scores.withColumns({"_class": F.when(c("_many"), c("_pos")).otherwise(1), "_score": c("_s") / c("_t")})
    scores = scores.select(*keys, "_class", "_score", "n", F.when(c("y_true") == c("_class"), c("n")).otherwise(F.lit(0).cast("long")).alias("p"))
    run = ordered(scores, [*keys, "_class"], {"s": "_score"}, ["n", "p"], hot_rows=hot_rows)
    below = c("s_n_before") - c("s_p_before") + (c("s_n_ties") - c("s_p_ties")) / 2.0
    per_class = run.groupBy(*keys, "_class").agg(F.sum(c("p") * below).alias("_u"), F.sum("p").cast("double").alias("_pos"), F.sum("n").cast("double").alias("_all"))
    auc = per_class.withColumn("_neg", c("_all") - c("_pos")).withColumn("_auc", F.when((c("_pos") > 0) & (c("_neg") > 0), c("_u") / (c("_pos") * c("_neg"))))
    weight = F.lit(1.0) if average == "macro" else c("_pos")
    return auc.groupBy(*keys).agg(
        F.when(F.count("_auc") == F.count(F.lit(1)), F.sum(c("_auc") * weight) / F.sum(weight)).alias("roc_auc"))


def roc_auc(predictions: DataFrame, keys: Sequence[str] = KEYS, average: str = "macro", *,
            y_true: str = "y_true", proba: str = "proba", hot_rows: int = HOT_ROWS) -> DataFrame:
    """ROC AUC from ranks of scores: binary, or one-vs-rest averaged over classes.

    NULL when a class has no test row or the fold has one class only.
    """
    rows = predictions.select(*keys, F.col(y_true).alias("y_true"), F.col(proba).alias("proba"))
    return auc_of_cells(prediction_cells(rows, keys, "classification"), keys, average, hot_rows=hot_rows)


def probability_losses(y: Column, proba: Column) -> Column:
    """Per row a struct: ll (log loss, clipped at float32 epsilon, not renormalized), b (Brier score, squared
    errors summed over classes) and rl (log loss of the renormalized row)."""
    clip = lambda p, e: F.greatest(F.least(p, F.lit(1.0 - e)), F.lit(e))
    parts = lambda p, t, own: F.struct(
        (-F.log(clip(own, FLOAT32_EPS))).alias("ll"),
        (dot(p, p) / (t * t) - 2.0 * own / t + 1.0).alias("b"),  # sum of (share - hit)^2
        (-F.log(clip(own / t, 2.0**-52))).alias("rl"))
    return let(full_proba(proba), lambda p: let(total_proba(p), lambda t: let(
        F.element_at(p, y.cast("int") + 1), lambda own: parts(p, t, own))))


def classification_of_cells(cells: DataFrame, keys: Sequence[str] = KEYS, *, average: str = "macro", hot_rows: int = HOT_ROWS) -> DataFrame:
    """:func:`classification_metrics` of :func:`prediction_cells`."""
    keys, losses = list(keys), {"_ll": "_l.ll", "_b": "_l.b", "_rl": "_l.rl"}
    rows = cells.select(*keys, F.col("y_true").cast("int").alias("y_true"), predicted_class(F.col("proba")).alias("y_pred"), "n",
                        probability_losses(F.col("y_true"), F.col("proba")).alias("_l"))
    counts = rows.groupBy(*keys, "y_true", "y_pred").agg(F.sum("n").alias("n"), *[F.sum(F.col(x) * F.col("n")).alias(k) for k, x in losses.items()])
    found = label_metrics(counts, keys, tuple(losses))
    found = found.withColumns({name: F.col(x) / F.col("n_test") for name, x in zip(("log_loss", "brier", "log_loss_renormalized"), losses)}).drop(*losses)
    return found.join(auc_of_cells(cells, keys, average, hot_rows=hot_rows), keys)


def classification_metrics(predictions: DataFrame, keys: Sequence[str] = KEYS, *, average: str = "macro", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per key with every classification metric. Input: y_true (class index), proba."""
    return classification_of_cells(prediction_cells(predictions, keys, "classification"), keys, average=average, hot_rows=hot_rows)


# ---------------------------------------------------------------- regression


def regression_of_cells(cells: DataFrame, keys: Sequence[str] = KEYS, *, ranks: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """:func:`regression_metrics` of :func:`prediction_cells`: one pass for means and split points, one for ranks and sums."""
    keys, c = list(keys), F.col
    y, p, n = c("y_true"), c("y_pred"), c("n")
    rows = cells.select(*keys, "y_true", "y_pred", "n", F.abs(y - p).alias("_e"))
    sums = {"n_test": F.sum("n"), "_sum_y": F.sum(y * n), "_sum_p": F.sum(p * n)}
    rows = ordered(rows, keys, {"e": "_e"} | ({"y": "y_true", "p": "y_pred"} if ranks else {}), ["n"], also=sums, hot_rows=hot_rows)
    total, e = c("n_test"), y - p
    dy, dp = y - c("_sum_y") / total, p - c("_sum_p") / total
    mean = lambda x: F.sum(x * n) / F.first("n_test")
    covers = lambda at: (c("e_n_before") < at) & (c("e_n_before") + c("e_n_ties") >= at)
    middle = F.when(covers(F.floor((total + 1) / 2)) | covers(F.floor(total / 2) + 1), c("_e"))
    of_ranks = {}
    if ranks:
        ry, rp = (c(f"{k}_n_before") + (c(f"{k}_n_ties") - total) / 2.0 for k in ("y", "p"))  # average ranks less their mean
        of_ranks = {"_ryp": F.sum(n * ry * rp), "_ryy": F.sum(n * ry * ry), "_rpp": F.sum(n * rp * rp)}
    found = rows.groupBy(*keys).agg(
        F.first("n_test").alias("n_test"), mean(e * e).alias("mse"), mean(F.abs(e)).alias("mae"), F.max("_e").alias("max_error"),
        mean(dy * dy).alias("_vy"), mean(dp * dp).alias("_vp"), mean((dy - dp) * (dy - dp)).alias("_ve"), mean(dy * dp).alias("_cov"), mean(F.abs(y)).alias("_size"),
        F.min(y).alias("_low"), F.max(y).alias("_high"), F.min(p).alias("_plow"), F.max(p).alias("_phigh"),
        (F.sum(F.when(y != 0, F.abs(e / y) * n)) / F.sum(F.when(y != 0, n)) * 100).alias("_mape"),
        ((F.min(middle) + F.max(middle)) / 2).alias("median_ae"), *[x.alias(k) for k, x in of_ranks.items()])
    flat, pflat = c("_low") == c("_high"), c("_plow") == c("_phigh")
    share = lambda part, whole: F.when(~flat, 1 - part / whole).when(part == 0, 1.0).otherwise(0.0)
    spread = F.when(c("n_test") > 1, F.sqrt(c("_vy") * c("n_test") / (c("n_test") - 1)))
    return found.select(
        *keys, "n_test", "mse", F.sqrt("mse").alias("rmse"), "mae", "max_error",
        share(c("mse"), c("_vy")).alias("r2"),
        F.when(~flat & (F.sqrt("_vy") >= 1e-3 * c("_size")), 1 - c("mse") / c("_vy")).alias("r2_guarded"),
        share(c("_ve"), c("_vy")).alias("explained_variance"),
        F.when(~flat & ~pflat, c("_cov") / F.sqrt(c("_vy") * c("_vp"))).alias("pearson_r"),
        F.when(c("mse") > 0, spread / F.sqrt("mse")).alias("rpd"),
        F.coalesce("_mape", F.lit(0.0)).alias("mape"), "median_ae",
        *([F.when((c("_ryy") > 0) & (c("_rpp") > 0), c("_ryp") / F.sqrt(c("_ryy") * c("_rpp"))).alias("spearman_r")] if ranks else []))


def regression_metrics(predictions: DataFrame, keys: Sequence[str] = KEYS, *, ranks: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per key with every regression metric (without *ranks*: no Spearman). Input: y_true, y_pred."""
    return regression_of_cells(prediction_cells(predictions, keys, "regression"), keys, ranks=ranks, hot_rows=hot_rows)


# ---------------------------------------------------------------- both


def registered_metrics(predictions: DataFrame, task_type: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """User-defined metrics of one task type, one row per key."""
    custom = {n: m for n, m in METRICS.items() if m.aggregate is not None and m.task == task_type}
    if not custom:
        raise ValueError(f"no registered metric for {task_type}")
    args = [F.col("y_true"), F.col("y_pred")] + ([F.col("proba")] if task_type == "classification" else [])
    return predictions.groupBy(*keys).agg(*[m.aggregate(*args).alias(n) for n, m in custom.items()])


def metrics_of_cells(cells: DataFrame, keys: Sequence[str] = KEYS, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """:func:`fold_metrics` of :func:`prediction_cells`."""
    keys = list(keys)
    wanted = lambda task: [n for n, m in METRICS.items() if m.aggregate is None and m.task == task]
    r = regression_of_cells(cells.where("regression"), keys, hot_rows=hot_rows).select(*keys, *wanted("regression"))
    if "proba" not in cells.columns:
        return r.select(*keys, *[F.lit(None).cast("double").alias(n) for n in wanted("classification")], *wanted("regression"))
    k = classification_of_cells(cells.where("not regression"), keys, hot_rows=hot_rows).select(*keys, *wanted("classification"))
    return k.unionByName(r, allowMissingColumns=True)


def fold_metrics(predictions: DataFrame, keys: Sequence[str] = KEYS, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per key and every registry metric. ``problem_type`` says which kind a prediction row is; without
    a ``proba`` column there is only regression. The input is read once; every metric comes from its cells."""
    return metrics_of_cells(prediction_cells(predictions, keys), keys, hot_rows=hot_rows)


def compute_metrics(predictions: DataFrame, task_type: str, keys: Sequence[str] = KEYS, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The summary metrics of one task type (weighted averages for classification)."""
    keys = list(keys)
    if task_type == "classification":
        full = classification_metrics(predictions, keys, average="weighted", hot_rows=hot_rows)
        return full.select(*keys, "accuracy", F.col("precision_weighted").alias("precision"), F.col("recall_weighted").alias("recall"),
                           F.col("f1_weighted").alias("f1_score"), "balanced_accuracy", "cohen_kappa",
                           F.col("mcc").alias("matthews_corrcoef"), "roc_auc", F.col("log_loss_renormalized").alias("log_loss"))
    if task_type == "regression":
        full = regression_metrics(predictions, keys, ranks=False, hot_rows=hot_rows)
        return full.select(*keys, "mse", "rmse", "mae", F.col("r2_guarded").alias("r2"), "mape", "explained_variance", "max_error", "median_ae")
    raise ValueError(f"unknown task type {task_type!r}")


def compare_metrics(results: DataFrame, metric: str, keys: Sequence[str] = ("task",), higher_is_better: bool = True) -> DataFrame:
    """Per key over models: best, worst, mean, population std and the ranking (ties by model name)."""
    value = F.col(metric)
    present = results.where(value.isNotNull())
    order = F.struct((-value if higher_is_better else value).alias("v"), "model")
    return present.groupBy(*keys).agg(
        F.min_by("model", order).alias("best_model"), F.min_by(metric, order).alias("best_value"),
        F.max_by("model", order).alias("worst_model"), F.max_by(metric, order).alias("worst_value"),
        F.transform(F.array_sort(F.collect_list(order)), lambda s: s["model"]).alias("ranking"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def probability_warnings(predictions: DataFrame, keys: Sequence[str] = KEYS, tolerance: float = 1e-3) -> DataFrame:
    """Keys whose probability rows stray from a sum of 1 by more than *tolerance*."""
    off = F.abs(total_proba(full_proba(F.col("proba"))) - 1)
    return predictions.groupBy(*keys).agg(F.max(off).alias("max_deviation")).where(F.col("max_deviation") > tolerance)


def validate_predictions(predictions: DataFrame, truth: DataFrame, keys: Sequence[str] = ("seed", "key", "model")) -> DataFrame:
    """Whether each prediction set can be scored: one row per key with a status.

    *predictions*: keys, spectrum_id, y_pred, proba_classes (NULL without probabilities); *truth*: seed, key,
    spectrum_id, y_true, task_type. ``index_mismatch``: the ids differ; ``continuous``: a classifier predicted
    non-integer numbers; ``labels_only``: probability columns are not the fold's classes; else ``ok``.
    """
    keys = list(keys)
    fold = [k for k in keys if k != "model"]
    sizes = truth.groupBy(*fold).agg(F.count(F.lit(1)).alias("n_true"), F.max("task_type").alias("task_type"))
    classes = truth.where(F.col("task_type") == "classification").groupBy(*fold, "y_true").count().groupBy(*fold).agg(
        F.sort_array(F.collect_list(F.col("y_true").cast("string"))).alias("_classes"))
    per_row = predictions.join(truth.select(*fold, "spectrum_id", F.lit(True).alias("_known")), [*fold, "spectrum_id"], "left")
    distinct = per_row.groupBy(*keys, "spectrum_id").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_known").alias("_known"), F.max("y_pred").alias("y_pred"),
        F.max("proba_classes").alias("proba_classes"))
    per_key = distinct.groupBy(*keys).agg(
        F.sum("_c").alias("n_pred"), F.count_if("_known").alias("n_matched"),
        F.count_if(F.col("y_pred") != F.floor("y_pred")).alias("_fractional"),
        F.max(F.sort_array("proba_classes")).alias("_proba"))
    out = per_key.join(sizes, fold, "left").join(classes, fold, "left")
    same = (F.col("n_pred") == F.col("n_true")) & (F.col("n_matched") == F.col("n_true"))
    clf = F.col("task_type") == "classification"
    status = (F.when(~F.coalesce(same, F.lit(False)), "index_mismatch")
              .when(clf & (F.col("_fractional") > 0), "continuous")
              .when(clf & F.col("_proba").isNotNull() & (F.col("_proba") != F.col("_classes")), "labels_only")
              .otherwise("ok"))
    return out.select(*keys, "n_pred", "n_true", "n_matched", status.alias("status"))


def append_new(existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("seed", "key", "model")) -> DataFrame:
    """*existing* plus the rows of *new* whose key it does not hold yet."""
    fresh = new.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)
