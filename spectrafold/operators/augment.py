"""Training-time augmentation: noisy and shifted copies, mixup. Random draws come from row hashes, so a
recomputed task gives the same copies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.functions.arrays import let
from spectrafold.functions.batches import as_lists, from_matrix, matrix, widths
from spectrafold.operators.ordering import HOT_ROWS, hash_order, hash_rank, with_values


#: Odd constants of the counter-based generator.
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def uniforms(keys: np.ndarray, n: int, stream: int) -> np.ndarray:
    """(rows, n) numbers in (0, 1): counter-based, a function of each row's key, the column and *stream* alone."""
    counters = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_MIX[0])
    base = _scrambled(keys.astype(np.int64).view(np.uint64) + np.uint64((stream * 2 + 1) * _MIX[2] % (1 << 64)))
    return ((_scrambled(base[:, None] + counters[None, :]) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def normals(keys: np.ndarray, n: int, stream: int) -> np.ndarray:
    """(rows, n) standard normal numbers, by the Box-Muller transform."""
    radius = np.sqrt(-2.0 * np.log(uniforms(keys, n, stream)))
    return radius * np.cos(2.0 * np.pi * uniforms(keys, n, stream + 1))


def row_key(seed, *cols: str | Column) -> Column:
    """A 64-bit key of a row's draws."""
    return F.xxhash64(F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])


def global_std(df: DataFrame, column: str = "intensities") -> Column:
    """Population standard deviation over all channels of all spectra (a scalar)."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    per_row = df.select(F.size(column).alias("n"), let(mean(F.col(column)), lambda m: F.struct(
        m.alias("m"), F.aggregate(F.transform(column, lambda v: (v - m) * (v - m)), F.lit(0.0), lambda a, v: a + v).alias("q"))).alias("s"))
    stats = per_row.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("s.m")) / F.sum("n")).alias("mu"),
                        F.sum("s.q").alias("q"), F.sum(F.col("n") * F.col("s.m") * F.col("s.m")).alias("mm"))
    return stats.select(F.sqrt((F.col("q") + F.col("mm")) / F.col("n") - F.col("mu") * F.col("mu"))).scalar()


def perturb(df: DataFrame, *, noise: float, shift: int, seed: int, id_column: str, column: str, scale: str = "_scale") -> DataFrame:
    """Shift every spectrum by a random number of channels (edges repeat) and add Gaussian noise."""
    df = df.withColumn("_key", row_key(seed, id_column, "copy"))
    fields = [f for f in df.schema.fields if f.name not in (column, scale, "_key")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{column}` array<double>"])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = as_lists(batch.column(column))
            n = widths(lists)
            keys = batch.column("_key").to_numpy()
            sigma = batch.column(scale).to_numpy(zero_copy_only=False)
            parts, order = [], []
            for width in np.unique(n):
                at, w = np.flatnonzero(n == width), int(width)
                x = matrix(lists, at, w)
                if shift > 0:
                    by = np.floor(uniforms(keys[at], 1, 0) * (2 * shift + 1)).astype(int) - shift
                    x = np.take_along_axis(x, np.clip(np.arange(w)[None, :] - by, 0, w - 1), axis=1)
                if noise > 0:
                    x = x + noise * sigma[at][:, None] * normals(keys[at], w, 1)
                parts.append(from_matrix(x))
                order.append(at)
            back = np.argsort(np.concatenate(order), kind="stable")
            done = pa.chunked_array(parts, type=pa.list_(pa.float64())).combine_chunks().take(pa.array(back))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], done], names=[*[f.name for f in fields], column])

    return df.mapInArrow(run, schema)


def beta_draw(alpha: float, seed: int, key: Column) -> Column:
    """A Beta(alpha, alpha) draw per row from its hash (Johnk's method: the first of many trials that is accepted; if none
    is, as for large alpha, a normal approximation cut to 0..1)."""

    @F.arrow_udf("double")
    def draw(k: pa.Array) -> pa.Array:
        keys = k.to_numpy(zero_copy_only=False)
        u, v = (uniforms(keys, 32, stream) ** (1.0 / alpha) for stream in (0, 1))
        accepted = (u + v <= 1.0) & (u + v > 0)
        first = accepted.argmax(axis=1)[:, None]
        x, y = np.take_along_axis(u, first, 1)[:, 0], np.take_along_axis(v, first, 1)[:, 0]
        near = np.clip(0.5 + normals(keys, 1, 2)[:, 0] / np.sqrt(8.0 * alpha + 4.0), 0.0, 1.0)
        return pa.array(np.where(accepted.any(axis=1), x / np.where(x + y > 0, x + y, 1.0), near), pa.float64())

    return draw(row_key(f"{seed}|beta", key))


def _partners(df: DataFrame, seed, by: Sequence[str], id_column: str, column: str, tag: str, hot_rows: int) -> DataFrame:
    """A random partner of the same *by* group per row: its spectrum and target as ``<tag>_x``, ``<tag>_y``."""
    by = list(by)
    ranked = hash_rank(df.select(*by, id_column, column, "y"), by, hash_order(seed, id_column), id_column, "_pos", hot_rows=hot_rows)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = with_values(df, sizes.withColumn("_size", F.col("_n")), by, ["_size"])
    pick = F.pmod(F.xxhash64(F.lit(f"{seed}|{tag}"), F.col(id_column)), F.col("_size")) + 1
    other = ranked.select(*by, F.col("_pos").alias("_pick"), F.col(column).alias(f"{tag}_x"), F.col("y").alias(f"{tag}_y"))
    return rows.withColumn("_pick", pick).join(other, [*by, "_pick"]).drop("_pick", "_size")


def blend(a, b, weight: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: weight * u + (1 - weight) * v)


def mixup(df: DataFrame, alpha: float, *, classify: bool, label: str = "label", by: Sequence[str] = (), seed: int = 0,
          id_column: str = "spectrum_id", column: str = "intensities", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One blended row per row: with a row of its class (label kept), or of two random rows (targets blended)."""
    rows = df.withColumn("_all", F.lit(0))
    if "y" not in rows.columns:
        rows = rows.withColumn("y", F.lit(None).cast("double"))
    rows = rows.withColumn("_weight", beta_draw(alpha, seed, F.col(id_column)))
    weight = F.col("_weight")
    if classify:
        out = _partners(rows, seed, [*by, label], id_column, column, "_b", hot_rows)
        out = out.withColumn(column, blend(column, "_b_x", weight))
    else:
        out = _partners(rows, seed, [*by, "_all"], id_column, column, "_a", hot_rows)
        out = _partners(out, seed + 1, [*by, "_all"], id_column, column, "_b", hot_rows)
        out = out.withColumn(column, blend("_a_x", "_b_x", weight)).withColumn("y", weight * F.col("_a_y") + (1 - weight) * F.col("_b_y"))
    return out.select(*df.columns)


def augment(df: DataFrame, n: int = 2, *, noise: float = 0.01, shift: int = 0, mixup_alpha: float = 0.0, classify: bool = True,
            label: str = "label", by: Sequence[str] = (), seed: int = 0, id_column: str = "spectrum_id", column: str = "intensities",
            hot_rows: int = HOT_ROWS) -> DataFrame:
    """The originals (copy 0), *n* perturbed copies of each, and one mixup row per original (copy -1).

    *by* are further keys whose rows may be blended.
    """
    copies = df.withColumn("_scale", global_std(df, column)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(max(1, n)))))
    out = df.withColumn("copy", F.lit(0)).unionByName(
        perturb(copies, noise=noise, shift=shift, seed=seed, id_column=id_column, column=column))
    if mixup_alpha > 0:
        mixed = mixup(df, mixup_alpha, classify=classify, label=label, by=by, seed=seed, id_column=id_column, column=column, hot_rows=hot_rows)
        out = out.unionByName(mixed.withColumn("copy", F.lit(-1)))
    return out


def augment_tiled(df: DataFrame, n: int = 1, *, noise: float = 0.01, shift: int = 0, mixup_alpha: float = 0.0, classify: bool = True,
                  label: str = "label", by: Sequence[str] = (), seed: int = 0, id_column: str = "spectrum_id",
                  column: str = "intensities", hot_rows: int = HOT_ROWS) -> DataFrame:
    """*n* copies of every row instead of the originals: shifted, then blended, noise last."""
    tiles = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(max(1, n))))).withColumn(
        "_tile", F.concat_ws("|", id_column, "copy"))
    moved = perturb(tiles.withColumn("_scale", F.lit(0.0)), noise=0.0, shift=shift, seed=seed, id_column=id_column, column=column) if shift > 0 else tiles
    if mixup_alpha > 0:
        moved = mixup(moved, mixup_alpha, classify=classify, label=label, by=by, seed=seed, id_column="_tile", column=column, hot_rows=hot_rows)
    out = perturb(moved.withColumn("_scale", global_std(moved, column)), noise=noise, shift=0, seed=seed + 1, id_column="_tile", column=column)
    return out.drop("_tile")
