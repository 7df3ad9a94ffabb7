"""Scans of spectra tables: wide Parquet -> one array column per spectrum plus one axis row per dataset."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrafold.session import one_of

GROUP_COLUMN = "_group_id"


def channel_value(name: str) -> float | None:
    """The wavenumber a column name stands for, or None when the name is not a finite number."""
    try:
        value = float(name)
    except ValueError:
        return None
    return value if math.isfinite(value) else None


def nan_to_null(c: Column) -> Column:
    """NaN -> NULL, the rule at every scan: Spark's aggregates skip NULL but carry NaN on."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def channel_columns(schema: T.StructType) -> list[str]:
    """Names of the channel columns, sorted by wavenumber."""
    found = [(channel_value(f.name), f.name) for f in schema.fields]
    return [name for value, name in sorted((v, n) for v, n in found if v is not None)]


def target_columns(schema: T.StructType) -> list[str]:
    """Every column that is neither a channel nor the replicate group."""
    return [f.name for f in schema.fields if channel_value(f.name) is None and f.name != GROUP_COLUMN]


def infer_task_type(schema: T.StructType, meta: int | str | None = None) -> str:
    """``classification`` or ``regression``: from the stored task type, else from the first target's type."""
    if meta is not None:
        text = str(meta).strip().lower()
        if text in ("0", "classification") or "class" in text:
            return "classification"
        if text in ("1", "regression") or "regress" in text:
            return "regression"
    targets = target_columns(schema)
    if not targets:
        raise ValueError("no target column, so the task type cannot be inferred")
    return "regression" if isinstance(schema[targets[0]].dataType, T.NumericType) else "classification"


def wide_to_spectra(
    df: DataFrame, dataset: str, *, id_column: str | None = None, ignore: tuple[str, ...] = (), classes: tuple[str, ...] = (),
    label: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(spectra, axis) of a wide table whose float-named columns are channels.

    ``spectra``: dataset, spectrum_id, intensities, targets (numeric targets by name), labels (class targets by name: those
    that are not numeric, and the numeric ones in *classes*), label (the class target named *label*, else the first),
    group_id. Without *id_column* the id is ``monotonically_increasing_id``: unique, but dependent on how the table is split
    into tasks. :func:`read_spectra` gives stable ids.
    """
    schema = df.schema
    channels = channel_columns(schema)
    if not channels:
        raise ValueError("no column name parses as a wavenumber")
    skip = {id_column, *ignore}
    targets = [c for c in target_columns(schema) if c not in skip]
    numeric = [c for c in targets if isinstance(schema[c].dataType, T.NumericType) and c not in classes]
    text = [c for c in targets if c not in numeric]
    if label is not None:
        one_of("class target", label, text)
    quoted = lambda c: F.col(f"`{c}`")
    target_map = (
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in numeric]), F.array(*[nan_to_null(quoted(c).cast("double")) for c in numeric]))
        if numeric else F.lit(None).cast("map<string,double>")
    )
    label_map = (
        F.map_from_arrays(F.array(*[F.lit(c) for c in text]), F.array(*[quoted(c).cast("string") for c in text]))
        if text else F.lit(None).cast("map<string,string>")
    )
    spectra = df.select(
        F.lit(dataset).alias("dataset"),
        (quoted(id_column).cast("long") if id_column else F.monotonically_increasing_id()).alias("spectrum_id"),
        F.array(*[nan_to_null(quoted(c).cast("double")) for c in channels]).alias("intensities"),
        target_map.alias("targets"),
        label_map.alias("labels"),
        (quoted(label or text[0]).cast("string") if text else F.lit(None).cast("string")).alias("label"),
        (quoted(GROUP_COLUMN).cast("string") if GROUP_COLUMN in df.columns
         else F.lit(None).cast("string")).alias("group_id"),
    )
    axis = df.sparkSession.range(1).select(
        F.lit(dataset).alias("dataset"),
        F.array(*[F.lit(channel_value(c)) for c in channels]).alias("wavenumbers"),
    )
    return spectra, axis


#: Rows of one file at most (2^36); the file's position is in the bits above.
FILE_ROWS = 1 << 36
#: Scheme of a path; Spark writes it with one slash or with three.
ROOT = r"^([A-Za-z][A-Za-z0-9+.-]*:)/+"


def with_row_ids(scan: DataFrame, name: str = "row_id") -> DataFrame:
    """A file scan with a long *name* for each row: position of its file in the order of paths, times FILE_ROWS, plus position
    of the row in the file. The same rows get the same ids however the files are split into tasks or read again; a file
    added behind the others changes none. One file counts from 0.

    The scan must come straight from files. The list of files is what the scan holds already; no job runs for it.
    """
    files = sorted(re.sub(ROOT, r"\1/", f) for f in scan.inputFiles())
    row = F.col("_metadata.row_index")
    if len(files) < 2:
        return scan.withColumn(name, row)
    listed = scan.sparkSession.createDataFrame(list(enumerate(files)), "_file_at long, _file string")
    rows = scan.select("*", F.regexp_replace("_metadata.file_path", ROOT, "$1/").alias("_path"), row.alias("_row"))
    placed = rows.join(listed, F.col("_path") == F.col("_file"), "left")
    at = F.coalesce("_file_at", F.raise_error(F.concat(F.lit("not among the files of the scan: "), "_path")).cast("long"))
    return placed.withColumn(name, at * FILE_ROWS + F.col("_row")).drop("_path", "_row", "_file", "_file_at")


def read_spectra(spark: SparkSession, path: str, dataset: str, *, id_column: str | None = None, **kwargs) -> tuple[DataFrame, DataFrame]:
    """:func:`wide_to_spectra` of a Parquet path; without *id_column* the ids are those of :func:`with_row_ids`."""
    scan = spark.read.parquet(path)
    if id_column is None:
        id_column = "_row_id"
        scan = with_row_ids(scan, id_column)
    return wide_to_spectra(scan, dataset, id_column=id_column, **kwargs)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A column-projected scan; only these columns are read from the files."""
    return spark.read.parquet(path).select(*[F.col(f"`{c}`") for c in columns])


def channel_count(spark: SparkSession, path: str) -> int:
    """Number of channels of a wide table from the file footer; no rows are read."""
    return len(channel_columns(spark.read.parquet(path).schema))


def spectra_to_long(spectra: DataFrame, axis: DataFrame | None = None, column: str = "intensities") -> DataFrame:
    """One row per (spectrum, channel): position, wavenumber (with *axis*) and intensity."""
    if axis is None:
        return spectra.select("dataset", "spectrum_id", F.posexplode(column).alias("channel", "intensity"))
    joined = spectra.join(axis, "dataset")
    return joined.select(
        "dataset", "spectrum_id", F.posexplode(F.arrays_zip(F.col("wavenumbers"), F.col(column).alias("x"))).alias("channel", "p")
    ).select("dataset", "spectrum_id", "channel", F.col("p.wavenumbers").alias("wavenumber"), F.col("p.x").alias("intensity"))
