"""Scans of predictions, result files and JSON registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys end in the target's number, so a model's name may have underscores.
PREDICTION_FILE = r"seed_(\d+)/predictions/(.+?_\d+)_(.+)_predictions\.csv"
TRUTH_FILE = r"seed_(\d+)/predictions/(.+_\d+)_ground_truth\.csv"


def _csv_rows(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, header, fields) of every data line of CSV files whose columns differ from file to file."""
    lines = spark.read.text(pattern).where("value <> ''").select(F.col("_metadata.file_path").alias("path"), "value")
    fields = F.transform(F.split("value", ","), lambda x: F.trim(F.regexp_replace(x, '^"|"$', "")))
    lines = lines.select("path", fields.alias("fields"))
    named = F.get("fields", F.lit(0)).try_cast("long").isNull()  # the header's first field is empty or a name
    headers = lines.where(named).groupBy("path").agg(F.first("fields").alias("header"))
    return lines.where(~named).join(headers, "path")


def read_predictions(spark: SparkSession, root: str, *, value_type: str = "double") -> DataFrame:
    """One table of all ``seed_<n>/predictions/<key>_<model>_predictions.csv`` files under *root*.

    Seed, key and model come from the path; the first CSV column is the spectrum id, ``target`` the prediction. Columns
    after it are class probabilities: ``proba_classes`` has their names and ``proba`` their values, NULL without any.
    """
    rows = _csv_rows(spark, f"{root.rstrip('/')}/seed_*/predictions/*_predictions.csv")
    part = lambda i: F.regexp_extract("path", PREDICTION_FILE, i)
    at = (F.array_position("header", "target") - 1).cast("int")
    rest = F.size("header") - at - 1
    classes = F.when(rest > 0, F.slice("header", at + 2, rest))
    return rows.select(
        part(1).cast("int").alias("seed"), part(2).alias("key"), part(3).alias("model"),
        F.get("fields", F.lit(0)).cast("long").alias("spectrum_id"), F.get("fields", at).cast(value_type).alias("prediction"),
        classes.alias("proba_classes"), F.when(rest > 0, F.slice("fields", at + 2, rest).cast("array<double>")).alias("proba"))


def read_ground_truth(spark: SparkSession, root: str, *, value_type: str = "double") -> DataFrame:
    """(seed, key, spectrum_id, y_true) of all ``<key>_ground_truth.csv`` files beside the predictions."""
    rows = _csv_rows(spark, f"{root.rstrip('/')}/seed_*/predictions/*_ground_truth.csv")
    part = lambda i: F.regexp_extract("path", TRUTH_FILE, i)
    at = (F.array_position("header", "target") - 1).cast("int")
    return rows.select(part(1).cast("int").alias("seed"), part(2).alias("key"), F.get("fields", F.lit(0)).cast("long").alias("spectrum_id"),
                       F.get("fields", at).cast(value_type).alias("y_true"))


def scan_results(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Every per-fold result file under *path*; unreadable files are skipped, partitions are discovered."""
    reader = spark.read.format(fmt).option("ignoreCorruptFiles", True).option("recursiveFileLookup", False)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


TARGET_LIST_SCHEMA = (
    "dataset STRING, target_idx INT, target_name STRING, num_instances BIGINT, n_repeats INT, "
    "excluded BOOLEAN, exclusion_reason STRING"
)


def read_target_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of target records -> one row per (dataset, target)."""
    return spark.read.schema(TARGET_LIST_SCHEMA).option("multiLine", True).json(path)


def flatten_exclusions(registry: DataFrame) -> DataFrame:
    """(key, category) rows of a ``{category: {key: note}}`` registry; names starting with ``_`` are comments.

    *registry* holds one row with the whole document as ``doc MAP<STRING, STRING>`` (values still JSON).
    """
    entries = registry.select(F.explode("doc").alias("category", "body")).where(~F.col("category").startswith("_"))
    keys = F.json_object_keys("body")  # NULL for anything that is not an object
    return (
        entries.select("category", F.explode(keys).alias("key")).where(~F.col("key").startswith("_"))
        .select("key", "category")
    )


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """:func:`flatten_exclusions` of a JSON file."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("doc"))
    return flatten_exclusions(doc)
