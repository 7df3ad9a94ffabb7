"""Writers: folds, leaderboards, reference results, per-seed summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLD_COLUMNS = ["task", "dataset", "target_idx", "problem_type", "repeat", "spectrum_id", "fold"]


def write_folds(folds: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Folds as CSV when *path* ends in ``.csv``, else Parquet; ``repeat`` and ``fold`` as TINYINT."""
    cols = [c for c in FOLD_COLUMNS if c in folds.columns]
    out = folds.select(*cols).withColumn("repeat", F.col("repeat").cast("tinyint")).withColumn("fold", F.col("fold").cast("tinyint"))
    if path.endswith(".csv"):
        out.write.mode(mode).option("header", True).csv(path)
    else:
        out.write.mode(mode).parquet(path)


def write_leaderboards(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV folder per task group; a leaderboard has one row per model."""
    scores.repartition("group").sortWithinPartitions("group", F.desc("elo")).write.mode(mode).partitionBy("group").option(
        "header", True).csv(path)


def write_reference(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Results sorted by (dataset, fold, model) as zstd Parquet."""
    order = ["dataset", "fold", "model"]
    (results.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode(mode).option("compression", "zstd").parquet(path))


def summary(metrics: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of every numeric metric per (key, dataset, task_type, target_idx, model)."""
    keys = [c for c in ("key", "dataset", "task_type", "target_idx", "model") if c in metrics.columns]
    numeric = [f.name for f in metrics.schema.fields
               if isinstance(f.dataType, T.NumericType) and f.name not in ("seed", "target_idx", *keys)]
    return metrics.groupBy(*keys).agg(
        *[a for c in numeric for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])


def write_summary(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """:func:`summary` as CSV."""
    summary(metrics).write.mode(mode).option("header", True).csv(path)
