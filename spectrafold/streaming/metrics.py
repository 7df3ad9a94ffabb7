"""Incremental scoring: predictions and result files arrive, only keys with something new are computed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spectrafold.operators.fold_metrics import KEYS, metrics_of_cells, prediction_cells
from spectrafold.operators.ordering import HOT_ROWS
from spectrafold.session import materialize

#: Parts of the state, by hash of the key: a batch reads those of its keys.
SLOTS = 64
#: Batches after which the cells of all are added up.
COMPACT_EVERY = 32


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything has been written at *path*."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_if_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at *path*, empty when nothing has been written yet; one that can't be read raises."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def new_keys(batch: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has not been scored yet."""
    return batch.join(done.select(*keys).distinct(), list(keys), "left_anti")


def stream_fold_metrics(
    source: DataFrame, sink: str, checkpoint: str, *, staging: str, expected: DataFrame | None = None,
    keys: Sequence[str] = KEYS, score=metrics_of_cells, id_column: str = "spectrum_id", slots: int = SLOTS, compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Score each (task, fold, model) as its predictions arrive and append its metrics to *sink*.

    Spark's own state store lets each id of a key pass once. What passes is counted into cells
    (:func:`~spectrafold.operators.fold_metrics.prediction_cells`), the state of a key: cells of batches add up, and *score*
    makes the metrics of them. A batch reads its own rows and the cells of its keys (those slots of the *staging* that its
    keys hash to), and writes its own cells; every *compact_every* batches they are added up to one table. With *expected*
    (keys without model, ``n_expected`` ids) a key is scored once, when all its ids are there, and its cells leave the state.
    Without, it is scored anew with each batch that brings it more; ``batch_id`` tells the results apart and :func:`latest`
    reads the last of each key. A repeated batch reads the state before it and overwrites what it wrote.
    """
    keys = list(keys)
    once = source.dropDuplicates([*keys, id_column])

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cells = with_slot(prediction_cells(batch, keys).withColumn("scored", F.lit(False)), keys, slots)
        cells = materialize(cells)
        touched = [r.slot for r in cells.select("slot").distinct().collect()]  # at most *slots* numbers
        if not touched:
            return
        own = cells.select(*keys).distinct()
        before = read_cells(spark, staging, cells.schema, batch_id, touched).join(own, keys, "left_semi")
        merged = materialize(add_up(before.unionByName(cells), keys))
        if expected is not None:
            have = merged.groupBy(*keys).agg(F.sum("n").alias("n_have"), F.max("scored").alias("scored"))
            ready = have.where("not scored").join(expected, [k for k in keys if k in expected.columns]).where(F.col("n_have") >= F.col("n_expected")).select(*keys)
            merged, ready = merged.join(ready, keys, "left_semi"), materialize(ready)
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in cells.schema if f.name not in (*keys, "slot", "scored", "n")]
            ended = with_slot(ready.select(*keys, *empty, F.lit(0).cast("long").alias("n"), F.lit(True).alias("scored")), keys, slots)
            cells = cells.unionByName(ended)
        cells.write.mode("overwrite").partitionBy("slot").parquet(f"{staging}/cells/{batch_id}")
        most = merged.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        hot = {} if score is not metrics_of_cells or most > HOT_ROWS else {"hot_rows": None}  # the cells are there: no need to plan for both
        scored = score(merged.drop("slot", "scored"), keys, **hot).withColumn("batch_id", F.lit(batch_id).cast("long"))
        scored.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            compact(spark, staging, cells.schema, batch_id, keys)

    return once.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_slot(cells: DataFrame, keys: Sequence[str], slots: int) -> DataFrame:
    """*cells* with the part of the state that their key belongs to."""
    return cells.withColumn("slot", F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int"))


def add_up(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal cells as one."""
    rest = [c for c in cells.columns if c not in (*keys, "regression", "scored", "n")]
    out = cells.groupBy(*keys, *rest).agg(F.max("regression").alias("regression"), F.max("scored").alias("scored"), F.sum("n").alias("n"))
    return out.select(*cells.columns)


def read_cells(spark: SparkSession, staging: str, schema: T.StructType, before: int, touched: Sequence[int] | None = None) -> DataFrame:
    """Cells that batches before number *before* have left, of the slots *touched* (None: all), not added up.

    The last table of added-up cells from before that batch counts, and the batches after it.
    """
    whole = max([g for g in generations(spark, f"{staging}/whole") if g < before], default=-1)
    parts = [f"{staging}/cells/{g}" for g in generations(spark, f"{staging}/cells") if whole < g < before]
    parts += [f"{staging}/whole/{whole}"] if whole >= 0 else []
    wanted = F.lit(True) if touched is None else F.col("slot").isin(*touched)
    found = [spark.read.schema(schema).parquet(p).where(wanted) for p in parts]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def live_cells(spark: SparkSession, staging: str, schema: T.StructType, keys: Sequence[str] = KEYS, before: int = 1 << 62) -> DataFrame:
    """The state: added-up cells of all keys that are not scored for good."""
    cells = materialize(add_up(read_cells(spark, staging, schema, before), keys))
    return cells.join(cells.where("scored").select(*keys), list(keys), "left_anti")


def state_schema(predictions: DataFrame, keys: Sequence[str] = KEYS) -> T.StructType:
    """Columns of the cells that a stream of such predictions leaves."""
    return with_slot(prediction_cells(predictions, keys).withColumn("scored", F.lit(False)), keys, 1).schema


def compact(spark: SparkSession, staging: str, schema: T.StructType, batch_id: int, keys: Sequence[str]) -> None:
    """Adds up the cells of all batches so far. Of keys that are scored for good only that is kept. The state that a repeated
    batch would read stays; what is older goes."""
    cells = materialize(add_up(read_cells(spark, staging, schema, batch_id + 1), keys))
    ended = cells.where("scored")
    kept = cells.join(ended.select(*keys), list(keys), "left_anti").unionByName(ended)
    kept.write.mode("overwrite").partitionBy("slot").parquet(f"{staging}/whole/{batch_id}")
    earlier = sorted(g for g in generations(spark, f"{staging}/whole") if g < batch_id)
    for g in generations(spark, f"{staging}/cells"):
        if earlier and g <= earlier[-1]:
            remove(spark, f"{staging}/cells/{g}")
    for g in earlier[:-1]:
        remove(spark, f"{staging}/whole/{g}")


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders below *path* that were written to the end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    found = [f.getPath().getName() for f in system.listStatus(place)]
    return [int(name) for name in found if name.isdigit() and exists(spark, f"{path}/{name}/_SUCCESS")]


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def latest(metrics: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last metrics of each key of a sink."""
    rest = [c for c in metrics.columns if c not in (*keys, "batch")]
    return metrics.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_m")).select(*keys, "_m.*")


def stream_scan_results(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """A stream of new per-fold result files; files already read (per checkpoint) and unreadable ones are skipped."""
    reader = spark.readStream.schema(schema).format(fmt).option("ignoreCorruptFiles", True)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def append_new_files(stream: DataFrame, sink: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Append each batch's keys that the sink does not hold yet; of a key's rows in one batch the least."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        once = batch.select(*keys).distinct() if not rest else batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
        done = read_if_any(batch.sparkSession, sink, batch.schema)
        new_keys(once.select(*batch.columns), done, keys).write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
