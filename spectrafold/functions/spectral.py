"""Per-spectrum steps as JVM column expressions: ``Column -> Column`` over an array of intensities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.functions.arrays import col, dot, let, mean, total


def fraction_bounds(n: int, start: float, end: float, least: int = 1) -> tuple[int, int]:
    """[first, last) channel of a fractional range, rounded half to even, at least *least* channels wide."""
    first = max(0, min(int(round(start * n)), n - least))
    return first, max(first + least, min(int(round(end * n)), n))


def _bounds_column(n: Column, start: float, end: float, least: int) -> tuple[Column, Column]:
    first = F.greatest(F.lit(0), F.least(F.bround(F.lit(start) * n).cast("int"), n - least))
    return first, F.greatest(first + least, F.least(F.bround(F.lit(end) * n).cast("int"), n))


def crop_fraction(x: str | Column, start: float = 0.15, end: float = 0.75) -> Column:
    """The channels of a fractional range of the axis."""
    x = col(x)
    first, last = _bounds_column(F.size(x), start, end, 1)
    return F.slice(x, first + 1, last - first)


def crop_positions(axis: DataFrame, start_cm: float = 400.0, end_cm: float = 1800.0) -> DataFrame:
    """Per dataset the 1-based channels inside the interval, and whether the axis covers it only in part.

    Raises for a bad interval and for a dataset without any channel in it (the axis table has one row per
    dataset, so the check is a small job).
    """
    if not (abs(start_cm) < float("inf") and abs(end_cm) < float("inf")) or start_cm >= end_cm:
        raise ValueError(f"start_cm ({start_cm}) must be finite and below end_cm ({end_cm})")
    out = axis.select(
        "dataset",
        F.expr(f"filter(sequence(1, size(wavenumbers)), i -> element_at(wavenumbers, i) BETWEEN {float(start_cm)!r}D AND {float(end_cm)!r}D)")
        .alias("positions"),
        ((F.array_min("wavenumbers") > start_cm) | (F.array_max("wavenumbers") < end_cm)).alias("partial"),
    )
    empty = [r[0] for r in out.where(F.size("positions") == 0).limit(5).collect()]
    if empty:
        raise ValueError(f"no channel of {empty} lies in [{start_cm}, {end_cm}]")
    return out


def take_positions(x: str | Column, positions: str | Column) -> Column:
    """The channels at 1-based positions, in that order."""
    x = col(x)
    return F.transform(col(positions), lambda i: F.element_at(x, i))


def crop_physical(spectra: DataFrame, axis: DataFrame, start_cm: float = 400.0, end_cm: float = 1800.0,
                  column: str = "intensities") -> DataFrame:
    """Spectra cut to a wavenumber interval (both ends kept); the mask is computed once per dataset."""
    positions = crop_positions(axis, start_cm, end_cm).drop("partial")
    return spectra.join(positions, "dataset").withColumn(column, take_positions(column, "positions")).drop("positions")


def snv(x: str | Column) -> Column:
    """(x - mean) / population std; a constant spectrum gives NaN in every channel."""
    x = col(x)
    centre = lambda m: F.transform(x, lambda v: v - m)
    scale = lambda c, s: F.transform(c, lambda v: F.when(s == 0, F.lit(float("nan"))).otherwise(v / s))
    return let(mean(x), lambda m: let(centre(m), lambda c: let(F.sqrt(dot(c, c) / F.size(c)), lambda s: scale(c, s))))


def vector_normalize(x: str | Column) -> Column:
    """x / its Euclidean norm; a zero spectrum is left as it is."""
    x = col(x)
    return let(F.sqrt(dot(x, x)), lambda n: F.transform(x, lambda v: F.when(n == 0, v).otherwise(v / n)))


def _runs(x: Column, size: int, message: str) -> Column:
    n = F.floor(F.size(x) / F.lit(size)).cast("int")
    return F.when(n >= 1, n).otherwise(F.raise_error(F.lit(message)).cast("int"))


def avg_pool(x: str | Column, size: int = 5) -> Column:
    """Mean of every full run of *size* channels; the incomplete tail is dropped."""
    x = col(x)
    n = _runs(x, size, f"too few channels to pool with window {size}")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: total(F.slice(x, i * size + 1, size)) / size)


def decimate(x: str | Column, step: int = 5) -> Column:
    """Channels 0, step, 2 step, ...; as many as there are full runs of *step* channels."""
    x = col(x)
    n = _runs(x, step, f"too few channels to decimate with step {step}")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(x, i * step + 1))


def bin_channels(x: str | Column, n_bins: int) -> Column:
    """Average into *n_bins* runs of nearly equal width (edges rounded half to even); narrower spectra unchanged."""
    x = col(x)
    edge = lambda i: F.bround(i * F.size(x) / F.lit(n_bins)).cast("int")
    binned = F.transform(
        F.sequence(F.lit(0), F.lit(n_bins - 1)),
        lambda i: total(F.slice(x, edge(i) + 1, edge(i + 1) - edge(i))) / (edge(i + 1) - edge(i)))
    return F.when(F.size(x) <= n_bins, x).otherwise(binned)


def nan_to_zero(x: str | Column) -> Column:
    """NaN (and NULL) channels -> 0."""
    return F.transform(col(x), lambda v: F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v))


def nan_count(x: str | Column) -> Column:
    """Number of channels :func:`nan_to_zero` would replace."""
    return F.size(F.filter(col(x), lambda v: v.isNull() | F.isnan(v)))


def msc(x: str | Column, reference: str | Column, start: float = 0.0, end: float = 1.0) -> Column:
    """(x - intercept) / slope of the regression of a region of x on the same region of *reference*."""
    x, r = col(x), col(reference)
    first, last = _bounds_column(F.size(x), start, end, 2)
    cut = lambda v: F.slice(v, first + 1, last - first)
    fit = lambda xs, rs: let(mean(xs), lambda mx: let(mean(rs), lambda mr: let(
        total(F.zip_with(xs, rs, lambda a, b: (a - mx) * (b - mr))) / total(F.transform(rs, lambda b: (b - mr) * (b - mr))),
        lambda slope: F.struct(slope.alias("slope"), (mx - slope * mr).alias("intercept")))))
    return let(cut(x), lambda xs: let(cut(r), lambda rs: let(fit(xs, rs), lambda s: F.transform(
        x, lambda v: (v - s["intercept"]) / s["slope"]))))


def spectrum_digest(x: str | Column) -> Column:
    """Content digest of a spectrum, to run a costly step once per distinct spectrum."""
    return F.sha2(F.array_join(F.transform(col(x), lambda v: v.cast("string")), ",", "null"), 256)


def once_per_distinct(df: DataFrame, step, column: str = "intensities", id_column: str = "spectrum_id") -> DataFrame:
    """Apply *step* (DataFrame -> DataFrame on *column*) to each distinct spectrum once and join the result back.

    Copies meet at a digest; one row per digest is computed, so a spectrum copied a billion times costs one
    computation. The join back spreads hot digests (see ``with_values``).
    """
    from spectrafold.operators.ordering import with_values

    rows = df.withColumn("_digest", spectrum_digest(column))
    distinct = rows.groupBy("_digest").agg(F.first(column).alias(column), F.count(F.lit(1)).alias("_n"))
    done = step(distinct).withColumnRenamed(column, "_done")
    out = with_values(rows, done, ["_digest"], ["_done"])
    return out.withColumn(column, F.col("_done")).drop("_done", "_digest")
