"""Projections and filters on spectra and tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.operators.ordering import HOT_ROWS, hash_order, hash_rank, with_values
from spectrafold.operators.splits import infer_groups
from spectrafold.session import one_of


def select_target(spectra: DataFrame, name: str, as_: str = "y") -> DataFrame:
    """One target as *as_*; the target map is dropped."""
    return spectra.withColumn(as_, F.element_at("targets", name)).drop("targets")


def has_missing(column: str = "intensities") -> Column:
    """True when any channel is NULL or NaN."""
    return F.exists(column, lambda x: x.isNull() | F.isnan(x))


def drop_nan_spectra(df: DataFrame, column: str = "intensities") -> DataFrame:
    """Rows whose channels are all present."""
    return df.where(~has_missing(column))


def drop_unlabeled(df: DataFrame, label: str = "label", keep: bool = False) -> DataFrame:
    """Rows with a label; *keep* leaves unlabeled rows in for semi-supervised splits."""
    return df if keep else df.where(F.col(label).isNotNull())


def filter_rare_classes(
    df: DataFrame, *, label: str = "label", by: Sequence[str] = ("task",), group: str | None = None,
    min_samples: int = 9, min_groups: int = 0, id_column: str = "spectrum_id", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Drop classes with fewer than *min_samples* rows (or *min_groups* groups); tasks left with one class go too.

    Unlabeled rows are kept as long as their task is.
    """
    if min_samples <= 0 and min_groups <= 0:
        return df
    by = list(by)
    labeled = df.where(F.col(label).isNotNull())
    classes = labeled.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    if group is not None and min_groups > 0:
        # Distinct groups in two steps, so that a large class is counted by many tasks.
        groups = (labeled.where(F.col(group).isNotNull()).groupBy(*by, label, group).count()
                  .groupBy(*by, label).agg(F.count(F.lit(1)).alias("_g")))
        classes = classes.join(groups, [*by, label], "left").where(F.coalesce("_g", F.lit(0)) >= min_groups).drop("_g")
    kept = classes.where(F.col("_n") >= max(min_samples, 0))
    per_task = W.partitionBy(*by)
    kept = kept.withColumn("_classes", F.count(F.lit(1)).over(per_task)).where(F.col("_classes") >= 2)
    task_rows = kept.groupBy(*by).agg(F.sum("_n").alias("_n"))
    rows = with_values(df, kept.withColumn("_kept", F.lit(True)), [*by, label], ["_kept"])
    has_task = with_values(rows, task_rows.withColumn("_task", F.lit(True)), by, ["_task"])
    return has_task.where(F.col("_kept") | (F.col(label).isNull() & F.col("_task"))).drop("_kept", "_task")


def cap_rows(
    df: DataFrame, n: int, *, seed: int = 0, by: Sequence[str] = ("dataset",), id_column: str = "spectrum_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """A seeded sample of exactly ``min(n, rows)`` rows per group, the same under any partitioning."""
    return hash_rank(df, by, hash_order(seed, id_column), id_column, "_rank", hot_rows=hot_rows, at_most=n).drop("_rank")


def prepare_task(
    df: DataFrame, *, problem_type: str, label: str = "label", by: Sequence[str] = ("task",),
    min_samples: int = 9, min_groups: int = 0, keep_unlabeled: bool = False, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The rows that enter cross-validation: infer groups, drop NaN spectra, drop unlabeled, drop rare classes."""
    if problem_type == "regression" and "group_id" not in df.columns:
        df = infer_groups(df, by=by, hot_rows=hot_rows)
    df = drop_unlabeled(drop_nan_spectra(df), label, keep_unlabeled)
    if problem_type == "classification":
        df = filter_rare_classes(
            df, label=label, by=by, group="group_id" if "group_id" in df.columns else None,
            min_samples=min_samples, min_groups=min_groups, hot_rows=hot_rows)
    return df


def protocol_tasks(protocol: DataFrame, task_type: str | None = None, tasks: Sequence[str] | None = None) -> DataFrame:
    """Protocol tasks of one type and/or by name (a task key or a dataset); an unknown name raises."""
    if task_type is not None:
        one_of("task type", task_type, ("classification", "regression"))
    out = protocol if task_type is None else protocol.where(F.col("problem_type") == task_type)
    if tasks is None:
        return out
    wanted = protocol.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(tasks)], "name string")
    known = out.select(F.explode(F.array("task", "dataset")).alias("name"))
    unknown = [r[0] for r in wanted.join(known, "name", "left_anti").orderBy("name").collect()]
    if unknown:
        raise ValueError(f"not in the protocol (or not of the requested task type): {unknown}")
    return out.where(F.col("task").isin(*tasks) | F.col("dataset").isin(*tasks))


def excluded_keys(targets: DataFrame, *, keys=(), datasets=(), names=()) -> DataFrame:
    """Distinct keys left out: named keys, all targets of a dataset, or targets with a given name."""
    spark = targets.sparkSession
    explicit = spark.createDataFrame([(k,) for k in keys], "key string")
    by_rule = targets.where(
        F.col("dataset").isin(*datasets) | F.col("target_name").isin(*names)
    ).select(F.concat_ws("_", "dataset", "target_idx").alias("key"))
    return explicit.unionByName(by_rule).distinct()


def exclude_keys(results: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, excluded rows) of *results* by ``key``."""
    return results.join(keys, "key", "left_anti"), results.join(keys, "key", "left_semi")


def n_repeats(n: str | Column, lite: bool = False) -> Column:
    """Repeats of the cross-validation by size: 10 below 2,500 spectra, 1 above 250,000, else 3; lite: 1."""
    n = F.col(n) if isinstance(n, str) else n
    if lite:
        return F.lit(1)
    return F.when(n < 2_500, 10).when(n > 250_000, 1).otherwise(3)


def build_target_list(
    datasets: DataFrame, class_counts: DataFrame | None = None, exclusions: DataFrame | None = None,
    *, excluded_names: Sequence[str] = (), min_samples: int = 9, force_repeats: int | None = None,
) -> DataFrame:
    """One row per (dataset, target) with size, repeats, the excluded flag and its reason.

    *datasets*: dataset, num_instances, target_names ARRAY; *class_counts*: dataset, label, n (single-target
    classification only); *exclusions*: key (``<dataset>_<idx>``), category. A quality category wins over
    ``too_few_classes``.
    """
    out = datasets.select(
        "dataset", "num_instances", F.posexplode("target_names").alias("target_idx", "target_name"),
    ).withColumn("n_repeats", n_repeats("num_instances") if force_repeats is None else F.lit(force_repeats))
    reason = F.lit(None).cast("string")
    if exclusions is not None:
        out = out.withColumn("key", F.concat_ws("_", "dataset", "target_idx")).join(exclusions, "key", "left").drop("key")
        reason = F.col("category")
    if class_counts is not None:
        few = (class_counts.groupBy("dataset").agg(F.count_if(F.col("n") >= min_samples).alias("_c"))
               .where(F.col("_c") < 2).select("dataset", F.lit("too_few_classes").alias("_few")))
        out = out.join(few, "dataset", "left")
        reason = F.coalesce(reason, F.col("_few"))
    out = out.withColumn("exclusion_reason", reason)
    named = F.col("target_name").isin(*excluded_names) if excluded_names else F.lit(False)
    return out.select(
        "dataset", "target_idx", "target_name", "num_instances", "n_repeats",
        (named | F.col("exclusion_reason").isNotNull()).alias("excluded"), "exclusion_reason")


def core_subset(targets: DataFrame, *, min_n: int = 50, per_dataset: int = 2, large: Sequence[str] = ()) -> DataFrame:
    """(dataset, target_idx) of active targets with enough rows, the first few targets of every dataset."""
    ok = targets.where(~F.col("excluded") & (F.col("num_instances") >= min_n))
    if large:
        ok = ok.where(~F.col("dataset").isin(*large))
    first = F.row_number().over(W.partitionBy("dataset").orderBy("target_idx"))
    return ok.withColumn("_i", first).where(F.col("_i") <= per_dataset).select("dataset", "target_idx")


def row_caps(datasets: DataFrame, protocol_caps: DataFrame, model_caps: DataFrame) -> DataFrame:
    """Legal row caps per dataset: the protocol's (rank 0, NULL = all rows), then smaller model caps.

    *protocol_caps*: dataset, cap; *model_caps*: dataset (NULL = every dataset), model, cap.
    """
    base = datasets.select("dataset").distinct().join(protocol_caps, "dataset", "left")
    specific = base.join(model_caps.where(F.col("dataset").isNotNull()).select("dataset", F.col("cap").alias("mcap")), "dataset")
    general = model_caps.where(F.col("dataset").isNull()).agg(F.collect_set("cap")).scalar()
    everywhere = base.withColumn("mcap", F.explode(general))
    models = specific.unionByName(everywhere).where(F.col("mcap").isNotNull()).select(
        "dataset", F.least("mcap", "cap").alias("new"), "cap")
    extra = models.where(~F.col("new").eqNullSafe(F.col("cap"))).select("dataset", F.col("new").alias("cap")).distinct()
    return base.select("dataset", "cap", F.lit(True).alias("protocol")).unionByName(
        extra.select("dataset", "cap", F.lit(False).alias("protocol")))


def tier(value: Column, bounds: Sequence[float], names: Sequence[str]) -> Column:
    """The first name whose upper-exclusive bound exceeds *value*; the last name beyond all bounds."""
    out = None
    for bound, name in zip(bounds, names):
        out = F.when(value < bound, name) if out is None else out.when(value < bound, name)
    return F.when(value.isNull(), F.lit(None)).otherwise(out.otherwise(names[-1]))


# Tier names and upper-exclusive bounds.
SCALE = ((100, 1_000, 10_000, 100_000), ("micro", "tiny", "small", "medium", "large"))
DIMENSIONALITY = ((1_000, 3_000), ("low", "medium", "high"))
IMBALANCE = ((3.0, 10.0), ("balanced", "moderate", "severe"))
FINGERPRINT_MAX = 1_800.0


def categorize(stats: DataFrame) -> DataFrame:
    """Six categories per dataset from n_samples, n_features, n_targets, is_grouped, freq_max, max_class, min_class."""
    c = F.col
    return stats.select(
        "dataset",
        tier(c("n_samples"), *SCALE).alias("scale_tier"),
        tier(c("n_features"), *DIMENSIONALITY).alias("dimensionality_tier"),
        F.when(c("is_grouped"), "grouped").when(~c("is_grouped"), "iid").otherwise("unknown").alias("split_type"),
        tier(c("max_class") / c("min_class"), *IMBALANCE).alias("imbalance_tier"),
        F.when(c("n_targets") <= 1, "single-target").otherwise("multi-target").alias("target_arity"),
        F.when(c("freq_max") <= FINGERPRINT_MAX, "fingerprint").when(c("freq_max").isNotNull(), "extended")
        .alias("wavenumber_coverage"),
    )


def dataset_stats(spectra: DataFrame, axis: DataFrame) -> DataFrame:
    """The input of :func:`categorize`, one row per dataset, from the spectra and axis tables."""
    per_class = spectra.where(F.col("label").isNotNull()).groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"))
    classes = per_class.groupBy("dataset").agg(F.max("n").alias("max_class"), F.min("n").alias("min_class"))
    rows = spectra.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_samples"), F.max(F.size("intensities")).alias("n_features"),
        F.max(F.size(F.map_keys("targets"))).alias("n_targets"),
        F.max(F.col("group_id").isNotNull()).alias("is_grouped"))
    freq = axis.select("dataset", F.array_max("wavenumbers").alias("freq_max"))
    return rows.join(classes, "dataset", "left").join(freq, "dataset", "left")


def dataset_overview(targets: DataFrame, tasks: DataFrame, catalog: DataFrame, channels: DataFrame) -> DataFrame:
    """Per dataset of the scored *tasks*: size, channels, number of targets, and the catalog's columns."""
    scored = targets.withColumn("task", F.concat_ws("__", "dataset", "target_idx")).join(tasks.select("task").distinct(), "task", "left_semi")
    rows = scored.groupBy("dataset").agg(F.max("num_instances").alias("n_spectra"), F.count(F.lit(1)).alias("n_targets"))
    out = rows.join(channels, "dataset", "left").join(catalog, "dataset", "left")
    return out.select(
        "dataset", F.coalesce("name", "dataset").alias("name"),
        F.coalesce("domain", F.lit("Unknown")).alias("domain"), F.coalesce("task_type", F.lit("Unknown")).alias("task_type"),
        "n_spectra", "n_features", "n_targets", F.coalesce("source", F.lit("Other")).alias("source"),
        F.coalesce("new", F.lit(False)).alias("new"))


def composition(overview: DataFrame) -> DataFrame:
    """Datasets and spectra by domain, task type, source and provenance, in one pass (grouping sets)."""
    axes = ["domain", "task_type", "source", "provenance"]
    ov = overview.withColumn("provenance", F.when(F.col("new"), "First published here").otherwise("Previously published"))
    sets = [[F.col(a)] for a in axes]
    out = ov.groupingSets(sets, *[F.col(a) for a in axes]).agg(
        F.count(F.lit(1)).alias("datasets"), F.sum("n_spectra").alias("spectra"),
        *[F.grouping(a).alias(f"_{a}") for a in axes])
    axis_name = F.coalesce(*[F.when(F.col(f"_{a}") == 0, a) for a in axes])
    return out.select(axis_name.alias("axis"), F.coalesce(*axes).alias("value"), "datasets", "spectra")
