"""Preparing per-fold results of many models: loading, merging, metric choice, imputation, quality filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.functions.metrics import metric_names, to_error
from spectrafold.operators.ordering import HOT_ROWS, with_values
from spectrafold.session import materialize, one_of

VARIANTS = ("default", "tuned", "tuned_ensemble")
TIDY_COLUMNS = ("dataset", "fold", "model", "metric_error", "metric", "task", "time_train_s", "time_infer_s")


def last_per_key(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """One row per key, the last in *order*. Rows of a key that stand alike in *order* and differ raise: which one counts
    can't be known. An aggregate with partial combination, so many copies of one key are reduced before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*order) if order else F.lit(0)
    row, told = F.struct(*rest), F.struct(*[c for c in rest if df.schema[c].dataType.typeName() != "map"])
    kept = df.groupBy(*keys, place.alias("_place")).agg(F.min_by(row, told).alias("_row"), F.min(told).alias("_a"), F.max(told).alias("_b"))
    last = kept.groupBy(*keys).agg(F.max_by(F.struct("_row", "_a", "_b"), "_place").alias("_last"))
    where = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    clash = F.raise_error(F.concat(F.lit("several rows stand last and differ: "), where)).cast(last.schema["_last"].dataType["_row"].dataType)
    row = F.when(F.col("_last._a").eqNullSafe(F.col("_last._b")), F.col("_last._row")).otherwise(clash)
    return last.select(*keys, row.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def load_results(
    hpo: DataFrame, *, variant: str = "default", models: Sequence[str] | None = None, targets: DataFrame | None = None,
    exclude_models: Sequence[str] = ("DUMMY",), references: dict[str, str] | None = None, own_prefix: str | None = None,
    n_splits: int = 3, order: str | None = None,
) -> DataFrame:
    """Aggregated tuning results -> one tidy row per (dataset, fold, model).

    *references* maps the ``method`` of reference systems (rows without a config type) to their model key.
    Of duplicate rows the variant beats the default, then rows whose ``ta_name`` starts with *own_prefix*
    win, then the last by the column *order*; rows that still stand alike raise. The winner's missing error stays missing:
    its cell is left out here and filled by :func:`impute_missing`. *models* is the scope; *targets* (dataset, target_idx, num_instances, n_repeats,
    excluded) drops excluded tasks and folds beyond n_repeats x n_splits, and attaches sizes.
    """
    one_of("variant", variant, VARIANTS)
    references = references or {}
    c = F.col
    df = hpo
    if references:
        key = F.create_map(*[F.lit(v) for kv in references.items() for v in kv])
        is_ref = c("config_type").isNull() & c("method").isin(*references)
        df = df.withColumn("method_subtype", F.when(is_ref, "default").otherwise(c("method_subtype"))).withColumn(
            "config_type", F.when(is_ref, F.element_at(key, c("method"))).otherwise(c("config_type")))
    df = df.where(c("config_type").isNotNull() & c("method_subtype").isin("default", variant))
    if exclude_models:
        df = df.where(~c("config_type").isin(*exclude_models))
    if models is not None:
        df = df.where(c("config_type").isin(*models))
    own = c("ta_name").startswith(own_prefix) if own_prefix else F.lit(False)
    df = last_per_key(
        df.withColumn("_pref", (c("method_subtype") == variant).cast("int")).withColumn("_own", F.coalesce(own, F.lit(False)).cast("int")),
        ["dataset", "fold", "config_type"], "_pref", "_own", *([order] if order else []))
    df = df.where(c("metric_error").isNotNull() & ~F.isnan(c("metric_error").cast("double")))
    out = df.select(
        "dataset", c("fold").cast("int").alias("fold"), c("config_type").alias("model"),
        F.greatest(c("metric_error").cast("double"), F.lit(0.0)).alias("metric_error"), "metric",
        F.when(c("problem_type") == "regression", "regression").otherwise("classification").alias("task"),
        c("time_train_s").cast("double").alias("time_train_s"), c("time_infer_s").cast("double").alias("time_infer_s"), "ta_name",
        c("config_type").isin(*references.values()).alias("reference") if references else F.lit(False).alias("reference"),
    )
    if targets is not None:
        kept = targets.where(~c("excluded")).select(
            F.concat_ws("__", "dataset", "target_idx").alias("dataset"), "num_instances", (c("n_repeats") * n_splits).alias("_folds"))
        out = out.join(kept, "dataset").where(c("fold") < c("_folds")).drop("_folds")
    return out


def load_own_results(tidy: DataFrame, protocol: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows on the protocol's tasks and folds with sizes, tasks outside it). Missing columns raise."""
    missing = sorted(set(TIDY_COLUMNS) - set(tidy.columns))
    if missing:
        raise ValueError(f"tidy results are missing columns {missing}")
    if "reference" not in tidy.columns:
        tidy = tidy.withColumn("reference", F.lit(False))
    spec = protocol.select(F.col("task").alias("dataset"), F.col("n_folds").alias("_folds"), F.col("num_instances").alias("_size"))
    outside = tidy.select("dataset").distinct().join(spec, "dataset", "left_anti")
    kept = tidy.drop("num_instances").join(spec, "dataset").where(F.col("fold") < F.col("_folds"))
    return kept.withColumnRenamed("_size", "num_instances").drop("_folds"), outside


def attach_fold_metrics(results: DataFrame, per_fold: DataFrame, order: str | None = None) -> DataFrame:
    """*results* with the metric columns of *per_fold* on (ta_name, dataset, fold); old ones are replaced."""
    keys = ["ta_name", "dataset", "fold"]
    per_fold = last_per_key(per_fold, keys, *([order] if order else []))
    old = [c for c in per_fold.columns if c not in keys and c in results.columns]
    return results.drop(*old).join(per_fold, keys, "left")


def select_metric(results: DataFrame, *, classification: str | None = None, regression: str | None = None) -> DataFrame:
    """Rank by another metric per task type; rows without a value are dropped."""
    error, metric = F.col("metric_error"), F.col("metric")
    for task, name in (("classification", classification), ("regression", regression)):
        if name is None:
            continue
        one_of(f"{task} metric", name, metric_names(task))
        one_of("column of the results", name, results.columns)
        here = F.col("task") == task
        error = F.when(here, to_error(F.col(name), name)).otherwise(error)
        metric = F.when(here, F.lit(name)).otherwise(metric)
    return results.withColumn("metric_error", error).withColumn("metric", metric).where(
        F.col("metric_error").isNotNull() & ~F.isnan("metric_error"))


def coverage(own: DataFrame, protocol: DataFrame) -> DataFrame:
    """Per model and task type: tasks run, in total and complete, and the missing ones."""
    spec = protocol.select(F.col("task").alias("dataset"), F.col("problem_type").alias("task"), F.col("n_folds").alias("_need"))
    totals = spec.groupBy("task").agg(F.count(F.lit(1)).alias("tasks_total"), F.sort_array(F.collect_list("dataset")).alias("_all"))
    folds = own.groupBy("model", "task", "dataset", "fold").count().groupBy("model", "task", "dataset").agg(
        F.count(F.lit(1)).alias("_folds"))
    ran = folds.join(spec, ["dataset", "task"], "left").groupBy("model", "task").agg(
        F.count(F.lit(1)).alias("tasks_run"), F.count_if(F.col("_folds") >= F.col("_need")).alias("tasks_complete"),
        F.collect_set("dataset").alias("_ran"))
    return ran.join(totals, "task").select(
        "model", "task", "tasks_run", "tasks_total", "tasks_complete", F.array_except("_all", "_ran").alias("missing_tasks"))


def merge_reference(own: DataFrame, reference: DataFrame, *, replace: bool = False, tasks: str = "all") -> DataFrame:
    """Own and reference rows together. A shared model name is an error, or replaces the reference's rows;
    ``tasks="own"`` keeps only the tasks the own models ran."""
    one_of("tasks", tasks, ("all", "own"))
    names = own.select("model").distinct()
    if not replace:
        clash = [r[0] for r in names.intersect(reference.select("model").distinct()).orderBy("model").limit(20).collect()]
        if clash:
            raise ValueError(f"{clash} already among the reference models; rename yours or replace them")
    kept = reference.join(names, "model", "left_anti")
    if tasks == "own":
        kept = kept.join(own.select("dataset").distinct(), "dataset", "left_semi")
    shared = [c for c in own.columns if c in reference.columns]
    return kept.unionByName(own.select(*shared), allowMissingColumns=True)


def load_reference(reference: DataFrame, models: Sequence[str] | None = None, exclude: Sequence[str] = ("DUMMY",)) -> DataFrame:
    """Reference rows of the chosen models; an unknown name raises."""
    out = reference
    if models is not None:
        known = {r[0] for r in reference.where(F.col("model").isin(*models)).select("model").distinct().collect()}
        unknown = sorted(set(models) - known)
        if unknown:
            raise ValueError(f"no reference results for {unknown}")
        out = out.where(F.col("model").isin(*models))
    return out.where(~F.col("model").isin(*exclude)) if exclude else out


def impute_missing(results: DataFrame, *, reference_model: str = "RF", max_imputed_pct: float = 50.0, by: Sequence[str] = ()) -> DataFrame:
    """Fill each model's missing (dataset, fold) cells with the reference model's result.

    Cells the reference lacks are dropped for all; models above the limit are dropped; filled rows have
    ``imputed`` and NULL times. One shuffle brings a cell's rows (one per model) together; models and cells are
    never crossed: a cell adds the kept models it lacks, taken from the list of model names. With *by* each of its groups
    is filled on its own.
    """
    keys = [*by, "dataset", "fold"]
    rest = [c for c in results.columns if c not in keys]
    row = F.struct(*rest)
    cells = materialize(results.groupBy(*keys).agg(
        F.collect_list(row).alias("rows"), F.max(F.when(F.col("model") == reference_model, row)).alias("ref")
    ).where(F.col("ref").isNotNull()))  # counted, then read: computed once
    totals = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("_cells"))
    counts = cells.select(*by, F.explode(F.array_distinct("rows.model")).alias("model")).groupBy(*by, "model").agg(F.count(F.lit(1)).alias("_n"))
    if max_imputed_pct >= 100:  # then also models without any of the reference's cells
        counts = results.select(*by, "model").distinct().join(counts, [*by, "model"], "left").na.fill(0, ["_n"])
    kept = with_values(counts, totals, by, ["_cells"]).where(100.0 * (F.col("_cells") - F.col("_n")) / F.col("_cells") <= max_imputed_pct)
    kept = kept.groupBy(*by).agg(F.collect_list("model").alias("_kept"))
    # Times of a filled row are unknown; its other values are the reference's.
    values = lambda r, model, imputed: F.struct(*[
        (model if c == "model" else F.when(~imputed, r[c]) if c in ("time_train_s", "time_infer_s") else r[c]).alias(c)
        for c in rest], imputed.alias("imputed"))
    cells = with_values(cells, kept, by, ["_kept"])
    real = F.transform(F.filter("rows", lambda r: F.array_contains("_kept", r["model"])), lambda r: values(r, r["model"], F.lit(False)))
    gaps = F.transform(F.array_except("_kept", "rows.model"), lambda m: values(F.col("ref"), m, F.lit(True)))
    return cells.select(*keys, F.explode(F.concat(real, gaps)).alias("_r")).select(*keys, "_r.*").select(*results.columns, "imputed")


def task_metadata(results: DataFrame) -> DataFrame:
    """Per task: type, largest fold + 1, largest repeat + 1."""
    return results.groupBy("dataset").agg(
        F.max("problem_type").alias("problem_type"), (F.max("fold") + 1).alias("n_folds"), (F.max("repeat") + 1).alias("n_repeats")
    ).withColumn("task_type", F.when(F.col("problem_type") == "regression", "Supervised Regression").otherwise(
        "Supervised Classification"))


def build_protocol(results: DataFrame, targets: DataFrame) -> DataFrame:
    """Per active target with results: type, metric, number of folds, size and repeats."""
    # Distinct (task, fold) pairs are combined in the map tasks before they are counted.
    folds = results.groupBy("dataset", "fold").agg(F.min("task").alias("task"), F.min("metric").alias("metric"))
    per_task = folds.groupBy("dataset").agg(
        F.min("task").alias("problem_type"), F.min("metric").alias("metric"), F.count(F.lit(1)).alias("n_folds"))
    active = targets.where(~F.col("excluded")).withColumn("_key", F.concat_ws("__", "dataset", "target_idx"))
    return active.join(per_task.withColumnRenamed("dataset", "_key"), "_key").select(
        F.col("_key").alias("task"), "dataset", "target_idx", "target_name", "problem_type", "metric", "num_instances",
        "n_repeats", "n_folds")


def check_metric_consistency(results: DataFrame, columns: Sequence[str] = ("roc_auc", "log_loss", "rmse"),
                             tolerance: float = 1e-6) -> DataFrame:
    """Rows whose stored error differs from the error recomputed from the metric column it names."""
    again = F.coalesce(*[F.when(F.col("metric") == c, to_error(F.col(c), c)) for c in columns])
    gap = F.abs(again - F.col("metric_error"))
    return results.withColumn("gap", gap).where(F.col("gap") > tolerance).select("dataset", "fold", "model", "metric", "metric_error", "gap")


def preprocessing_label(hyperparameters: DataFrame, labels: dict[str, str], column: str = "hyperparameters") -> DataFrame:
    """Per model the enabled steps as a comma list (``none`` without any), from one experiment row per model.

    *hyperparameters*: model, a MAP<STRING, STRING> of parameters; *labels*: switch -> step name.
    """
    on = F.filter(F.map_entries(column), lambda e: e["key"].startswith("prep_") & e["key"].endswith("_enabled")
                  & F.lower(e["value"]).isin("true", "1"))
    names = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    step = lambda e: F.coalesce(F.element_at(names, e["key"]), F.regexp_replace(e["key"], "^prep_|_enabled$", ""))
    text = F.array_join(F.transform(on, step), ", ")
    return hyperparameters.where(F.col(column).isNotNull()).select(
        "model", F.when(text == "", "none").otherwise(text).alias("preprocessing")).groupBy("model").agg(
        F.min("preprocessing").alias("preprocessing"))


# ---------------------------------------------------------------- quality filters

CLASSIFICATION_TYPES = ("binary", "multiclass", "classification")


def scored_rows(results: DataFrame, method_subtype: str | None = "default", exclude: Sequence[str] = ()) -> DataFrame:
    df = results
    if method_subtype is not None and "method_subtype" in df.columns:
        df = df.where(F.col("method_subtype") == method_subtype)
    if exclude:
        df = df.where(~F.col("model").isin(*exclude))
    return df.where(F.col("metric_error").isNotNull() & ~F.isnan("metric_error"))


def trivial_keys(results: DataFrame, *, perfect_clf: float = 0.0, perfect_reg: float = 0.0, min_tie_models: int = 2,
                 tie_decimals: int = 4, method_subtype: str | None = "default", exclude: Sequence[str] = ()) -> DataFrame:
    """(dataset, reason): some model at or below the threshold on every fold (``perfect:<model>``), or at least
    *min_tie_models* models tied for the best rounded error on every fold (``tie:<largest tie>``)."""
    df = scored_rows(results, method_subtype, exclude)
    is_clf = F.col("problem_type").isin(*CLASSIFICATION_TYPES)
    is_reg = F.col("problem_type") == "regression"
    limit = F.when(F.col("_clf"), F.lit(perfect_clf)).when(F.col("_reg"), F.lit(perfect_reg))
    perfect = df.groupBy("dataset", "model").agg(
        F.max("metric_error").alias("_worst"), F.bool_and(is_clf).alias("_clf"), F.bool_and(is_reg).alias("_reg")
    ).where(F.col("_worst") <= limit).groupBy("dataset").agg(F.concat(F.lit("perfect:"), F.min("model")).alias("_perfect"))
    # Copies of one rounded error are counted before the fold is ordered: at most one row per distinct error.
    levels = df.groupBy("dataset", "fold", F.bround("metric_error", tie_decimals).alias("_e")).agg(F.count(F.lit(1)).alias("_n"))
    ties = levels.groupBy("dataset", "fold").agg(F.min_by("_n", "_e").alias("_tied")).groupBy("dataset").agg(
        F.min("_tied").alias("_least"), F.max("_tied").alias("_most")).where(F.col("_least") >= min_tie_models).select(
        "dataset", F.concat(F.lit("tie:"), F.col("_most")).alias("_tie"))
    return perfect.join(ties, "dataset", "full").select("dataset", F.coalesce("_perfect", "_tie").alias("reason"))


def unlearnable_keys(results: DataFrame, *, margin: float = 0.05, dummy: str = "DUMMY",
                     not_candidates: Sequence[str] = ("DUMMY", "AUTOGLUON"), method_subtype: str | None = "default") -> DataFrame:
    """(dataset, reason, best_error): the best model's mean error is not below the dummy's by more than *margin*."""
    mean = scored_rows(results, method_subtype).groupBy("dataset", "model").agg(F.avg("metric_error").alias("_e"))
    best = mean.groupBy("dataset").agg(
        F.min(F.when(F.col("model") == dummy, F.col("_e"))).alias("_dummy"),
        F.min(F.when(~F.col("model").isin(*not_candidates), F.col("_e"))).alias("best_error"))
    unknown = F.col("_dummy").isNull() | F.col("best_error").isNull()
    return best.where(unknown | (F.col("_dummy") - F.col("best_error") <= margin)).select(
        "dataset", F.when(unknown, "no_dummy_baseline").otherwise("dummy_not_beaten").alias("reason"),
        F.when(~unknown, F.col("best_error")).alias("best_error"))


def configured_keys(results: DataFrame, config: dict | None, kind: str) -> DataFrame:
    """Keys of the ``trivial_filter`` / ``learnability_filter`` block of a config; none unless it is enabled."""
    block = (config or {}).get(kind, config or {}) or {}
    if not block.get("enabled", False):
        return results.select("dataset").where(F.lit(False))
    if kind == "trivial_filter":
        names = ("perfect_clf", "perfect_reg", "min_tie_models", "tie_decimals", "method_subtype")
        return trivial_keys(results, **{k: block[k] for k in names if k in block}).select("dataset")
    rename = {"min_dummy_margin": "margin", "dummy_model": "dummy", "method_subtype": "method_subtype"}
    return unlearnable_keys(results, **{v: block[k] for k, v in rename.items() if k in block}).select("dataset")


def filter_keys(df: DataFrame, keys: DataFrame, column: str = "dataset") -> DataFrame:
    """Rows whose key is not listed; unchanged when *df* has no such column."""
    return df.join(keys.select(column).distinct(), column, "left_anti") if column in df.columns else df


def lookup_sizes(results: DataFrame, sizes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Attach ``num_instances`` per dataset; a dataset with very many result rows is not sent to one task."""
    n = results.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n")).join(sizes, "dataset")
    spread = F.concat_ws("|", "fold", "model")
    return with_values(results, n, ["dataset"], ["num_instances"])

