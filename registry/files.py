"""Queries that write files from the given tables and read them back: sinks, prediction files, registries, schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.scoring import scratch
from registry.views import RESULTS, SPECTRA, r, results, rounded, spectra, table
from spectrafold.sources import results as result_sources
from spectrafold.sources import sinks
from spectrafold.sources import spectra as spectra_sources

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


@query("write_folds", "SELECT event_type AS task, CAST(event_id % 2 AS INTEGER) AS repeat, CAST(user_id % 5 AS INTEGER) AS fold, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2, 3")
def _(spark, sf):
    c = F.col
    folds = table(spark, sf, "events").select(
        c("event_type").alias("task"), c("event_type").alias("dataset"), F.lit(0).alias("target_idx"), F.lit("regression").alias("problem_type"),
        F.pmod("event_id", F.lit(2)).alias("repeat"), c("event_id").alias("spectrum_id"), F.pmod("user_id", F.lit(5)).alias("fold"))
    path = scratch(spark, "folds")
    sinks.write_folds(folds, path)
    back = spark.read.parquet(path).groupBy("task", "repeat", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("spectrum_id").alias("ids"))
    return back.withColumn("repeat", c("repeat").cast("int")).withColumn("fold", c("fold").cast("int"))


@query("row_ids", "SELECT row_number() OVER () - 1 AS row_id, l_orderkey, l_linenumber FROM lineitem")
def _(spark, sf):
    return spectra_sources.with_row_ids(table(spark, sf, "lineitem")).select("row_id", "l_orderkey", "l_linenumber")


@query("row_ids_files", f"SELECT CAST(event_id % 3 AS BIGINT) * {spectra_sources.FILE_ROWS} + row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) - 1 AS spectrum_id, event_id AS y FROM events")
def _(spark, sf):
    # Three files by name: part-0 holds the events of remainder 0, in order.
    path = scratch(spark, "wide")
    third = F.pmod("event_id", F.lit(3))
    wide = table(spark, sf, "events").select(F.col("event_id").alias("y"), F.col("value").alias("400.5"), third.alias("part"))
    wide.repartition(3, "part").sortWithinPartitions("part", "y").write.partitionBy("part").parquet(path)
    found, _ = spectra_sources.read_spectra(spark, path, "events", ignore=("part",))
    return found.select("spectrum_id", F.col("targets")["y"].cast("long").alias("y"))


@query("write_leaderboards", "WITH" + RESULTS + f"SELECT task AS \"group\", model, {r('avg(metric_error)', 4)} AS elo FROM results GROUP BY 1, 2")
def _(spark, sf):
    path = scratch(spark, "boards")
    sinks.write_leaderboards(results(spark, sf).groupBy(F.col("task").alias("group"), "model").agg(F.avg("metric_error").alias("elo")), path)
    return rounded(spark.read.option("header", True).schema("model string, elo double, `group` string").csv(path), 4)


@query("write_reference", "WITH" + RESULTS + f"SELECT dataset, fold, model, {r('metric_error')} AS metric_error, num_instances FROM results")
def _(spark, sf):
    path = scratch(spark, "reference")
    sinks.write_reference(results(spark, sf), path)
    return rounded(spark.read.parquet(path).select("dataset", "fold", "model", "metric_error", "num_instances"))


@query("write_summary", "WITH" + RESULTS + f"SELECT dataset, model, {r('avg(metric_error)', 5)} AS metric_error_mean, {r('stddev_samp(metric_error)', 5)} AS metric_error_std FROM results GROUP BY 1, 2")
def _(spark, sf):
    path = scratch(spark, "summary")
    sinks.write_summary(results(spark, sf).select("dataset", "model", "metric_error", F.col("fold").alias("seed")), path)
    return rounded(spark.read.option("header", True).schema("dataset string, model string, metric_error_mean double, metric_error_std double").csv(path), 5)


def prediction_files(spark, sf) -> str:
    """Files per seed and model, one model with an underscore and one with probabilities, and the ground truth."""
    root, events = scratch(spark, "predictions"), table(spark, sf, "events").select("event_id", "value", "user_id")
    for seed in (1, 2):
        rows = events.where(F.pmod("user_id", F.lit(2)) == seed - 1)
        folder, ident = f"{root}/seed_{seed}/predictions", F.col("event_id").cast("string").alias("_")
        plain = rows.select(ident, (F.col("value") * seed).alias("target"))
        plain.write.option("header", True).csv(f"{folder}/mix_0_MY_MODEL_predictions.csv")
        share = F.col("value") / (F.col("value") + 20)
        rows.select(ident, (F.col("value") > 20).cast("int").alias("target"), (1 - share).alias("0"), share.alias("1")).write.option(
            "header", True).csv(f"{folder}/mix_0_KNN_predictions.csv")
        rows.select(ident, F.col("value").alias("target")).write.option("header", True).csv(f"{folder}/mix_0_ground_truth.csv")
    return root


@query("read_predictions", f"""
SELECT CAST(user_id % 2 + 1 AS INTEGER) AS seed, 'mix_0' AS key, 'MY_MODEL' AS model, event_id AS spectrum_id, {r('value * (user_id % 2 + 1)')} AS prediction, CAST(NULL AS DOUBLE) AS p1 FROM events
UNION ALL SELECT CAST(user_id % 2 + 1 AS INTEGER), 'mix_0', 'KNN', event_id, {r('CAST(value > 20 AS INTEGER)')}, {r('value / (value + 20)')} FROM events""")
def _(spark, sf):
    out = result_sources.read_predictions(spark, prediction_files(spark, sf))
    return rounded(out.select("seed", "key", "model", "spectrum_id", "prediction", F.get("proba", F.lit(1)).alias("p1")))


@query("read_ground_truth", f"SELECT CAST(user_id % 2 + 1 AS INTEGER) AS seed, 'mix_0' AS key, event_id AS spectrum_id, {r('value')} AS y_true FROM events")
def _(spark, sf):
    return rounded(result_sources.read_ground_truth(spark, prediction_files(spark, sf)))


@query("read_target_list", "SELECT p_brand AS dataset, count(*) AS num_instances, p_brand = 'Brand#3' AS excluded FROM part GROUP BY 1")
def _(spark, sf):
    path = scratch(spark, "targets")
    records = table(spark, sf, "part").groupBy(F.col("p_brand").alias("dataset")).agg(F.count(F.lit(1)).alias("num_instances")).withColumn("excluded", F.col("dataset") == "Brand#3")
    records.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(path)
    return result_sources.read_target_list(spark, path).select("dataset", "num_instances", "excluded")


@query("read_exclusions", "SELECT DISTINCT p_type AS key, p_brand AS category FROM part")
def _(spark, sf):
    path, part = scratch(spark, "exclusions"), table(spark, sf, "part").select("p_brand", "p_type").distinct()
    body = part.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", F.lit("note")))).alias("m"))
    body.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "m")))).alias("value")).coalesce(1).write.text(path)
    return result_sources.read_exclusions(spark, path)


@query("channel_count", "WITH" + SPECTRA + "SELECT max(channel) + 1 AS channels, 'classification' AS by_text, 'regression' AS by_number FROM xl")
def _(spark, sf):
    path = scratch(spark, "wide")
    wide = spectra(spark, sf).select(*[F.col("intensities")[i].alias(f"{400 + 25 * i}.0") for i in range(64)], "label", "y")
    wide.write.parquet(path)
    schema = spark.read.parquet(path).schema
    by_number = spectra_sources.infer_task_type(schema, meta="1")
    return spark.read.parquet(path).agg(
        (F.max(F.lit(0)) + spectra_sources.channel_count(spark, path)).cast("long").alias("channels"),
        F.max(F.lit(spectra_sources.infer_task_type(schema))).alias("by_text"), F.max(F.lit(by_number)).alias("by_number"))
