"""The given tables as spectra, results and predictions: the same views in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANNELS = 64
REFERENCE = "M0"
#: Errors are cut to 24 binary digits: sums over folds are then exact, and a tie is a tie in every engine.
BITS = 16777216.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(c: str) -> Column:
    """A two-decimal amount as an exact integer."""
    return F.round(F.col(c) * 100).cast("long")


# ---------------------------------------------------------------- results


def results(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    base = rows.groupBy(
        F.col("p_brand").alias("dataset"), F.pmod("l_orderkey", F.lit(3)).cast("int").alias("fold"),
        F.concat(F.lit("M"), F.pmod("l_suppkey", F.lit(12)).cast("string")).alias("model"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(cents("l_discount")).alias("d"), F.sum(cents("l_extendedprice")).alias("e"),
          F.sum(cents("l_tax")).alias("t"))
    sizes = base.groupBy("dataset").agg(F.sum("n").alias("num_instances"))
    number = F.substring("dataset", 7, 10).cast("int")
    return base.join(sizes, "dataset").select(
        "dataset", "fold", "model", (F.floor(F.col("d") / (100.0 * F.col("n")) * BITS) / BITS).alias("metric_error"),
        F.when(number % 4 == 0, "classification").otherwise("regression").alias("task"),
        F.when(number % 4 == 0, "log_loss").otherwise("rmse").alias("metric"),
        F.when(number % 4 == 0, "multiclass").otherwise("regression").alias("problem_type"),
        (F.col("e") / 1e7).alias("time_train_s"), (F.col("t") / 100.0).alias("time_infer_s"), "num_instances",
        F.concat(F.lit("run-"), "model").alias("ta_name"))


RESULTS = """
base AS (
  SELECT p_brand AS dataset, CAST(l_orderkey % 3 AS INTEGER) AS fold, 'M' || CAST(l_suppkey % 12 AS VARCHAR) AS model,
         count(*) AS n, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS d,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS e,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS t
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
results AS (
  SELECT dataset, fold, model, floor(d / (100e0 * n) * 16777216e0) / 16777216e0 AS metric_error,
         CASE WHEN CAST(substr(dataset, 7) AS INTEGER) % 4 = 0 THEN 'classification' ELSE 'regression' END AS task,
         CASE WHEN CAST(substr(dataset, 7) AS INTEGER) % 4 = 0 THEN 'log_loss' ELSE 'rmse' END AS metric,
         CASE WHEN CAST(substr(dataset, 7) AS INTEGER) % 4 = 0 THEN 'multiclass' ELSE 'regression' END AS problem_type,
         e / 1e7 AS time_train_s, t / 100e0 AS time_infer_s,
         CAST(sum(n) OVER (PARTITION BY dataset) AS BIGINT) AS num_instances, 'run-' || model AS ta_name
  FROM base)"""


def results_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """M5 lacks one task, M7 most tasks (above the imputation limit)."""
    number = F.substring("dataset", 7, 10).cast("int")
    gap = ((F.col("model") == "M5") & (F.col("dataset") == "Brand#3")) | ((F.col("model") == "M7") & (number > 10))
    return results(spark, sf).where(~gap)


RESULTS_WITH_GAPS = RESULTS + """,
gaps AS (SELECT * FROM results WHERE NOT ((model = 'M5' AND dataset = 'Brand#3')
         OR (model = 'M7' AND CAST(substr(dataset, 7) AS INTEGER) > 10)))"""


def results_with_dummy(spark: SparkSession, sf: str) -> DataFrame:
    """A trivial model per cell: the largest error of the fold, minus nothing on every third brand."""
    r = results(spark, sf).select("dataset", "fold", "model", "metric_error", "problem_type")
    dummy = r.groupBy("dataset", "fold").agg(F.max("metric_error").alias("metric_error"), F.max("problem_type").alias("problem_type"))
    return r.unionByName(dummy.withColumn("model", F.lit("DUMMY")))


RESULTS_WITH_DUMMY = RESULTS + """,
dummied AS (SELECT dataset, fold, model, metric_error, problem_type FROM results
  UNION ALL SELECT dataset, fold, 'DUMMY', max(metric_error), max(problem_type) FROM results GROUP BY 1, 2)"""

# ---------------------------------------------------------------- predictions


def _prediction_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.withColumn("task", F.col("p_brand")).withColumn("fold", F.pmod("l_orderkey", F.lit(3)).cast("int")).withColumn(
        "model", F.concat(F.lit("M"), F.pmod("l_suppkey", F.lit(12)).cast("string")))


PREDICTION_ROWS = """
rows_ AS (SELECT p_brand AS task, CAST(l_orderkey % 3 AS INTEGER) AS fold, 'M' || CAST(l_suppkey % 12 AS VARCHAR) AS model, l.*
  FROM lineitem l JOIN part ON l_partkey = p_partkey)"""


def regression_predictions(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return _prediction_rows(spark, sf).select(
        "task", "fold", "model", F.lit("regression").alias("problem_type"), c("l_quantity").alias("y_true"),
        (c("l_quantity") * (1 - c("l_discount")) + c("l_tax") * 10).alias("y_pred"))


REGRESSION = PREDICTION_ROWS + """,
reg AS (SELECT task, fold, model, l_quantity AS y_true, l_quantity * (1 - l_discount) + l_tax * 10 AS y_pred FROM rows_)"""


def binary_predictions(spark: SparkSession, sf: str) -> DataFrame:
    y = (F.col("l_returnflag") == "R").cast("int")
    return _prediction_rows(spark, sf).select(
        "task", "fold", "model", F.lit("binary").alias("problem_type"), y.alias("y_true"),
        F.array(0.05 + 0.9 * ((F.col("l_discount") * 10 + y) / 2)).alias("proba"))


BINARY = PREDICTION_ROWS + """,
clf AS (SELECT task, fold, model, CAST(l_returnflag = 'R' AS INTEGER) AS y,
          5e-2 + 9e-1 * ((l_discount * 10 + CAST(l_returnflag = 'R' AS INTEGER)) / 2) AS p FROM rows_)"""


def multiclass_predictions(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    y = F.when(c("l_returnflag") == "A", 0).when(c("l_returnflag") == "N", 1).otherwise(2)
    lift = lambda k: F.when((c("l_linenumber") % 2 == 0) & (c("y_true") == k), 1.0).otherwise(0.0)
    rows = _prediction_rows(spark, sf).withColumn("y_true", y)
    raw = F.array(1 + c("l_tax") * 10 + lift(0), 1 + c("l_discount") * 10 + lift(1), 1 + c("l_quantity") / 50 + lift(2))
    rows = rows.withColumn("raw", raw)
    return rows.select("task", "fold", "model", F.lit("multiclass").alias("problem_type"), "y_true", F.transform(
        "raw", lambda v: v / (c("raw")[0] + c("raw")[1] + c("raw")[2])).alias("proba"))


MULTICLASS = PREDICTION_ROWS + """,
raw AS (SELECT task, fold, model, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
          1 + l_tax * 10 + CASE WHEN l_linenumber % 2 = 0 AND l_returnflag = 'A' THEN 1e0 ELSE 0e0 END AS s0,
          1 + l_discount * 10 + CASE WHEN l_linenumber % 2 = 0 AND l_returnflag = 'N' THEN 1e0 ELSE 0e0 END AS s1,
          1 + l_quantity / 50 + CASE WHEN l_linenumber % 2 = 0 AND l_returnflag NOT IN ('A', 'N') THEN 1e0 ELSE 0e0 END AS s2 FROM rows_),
multi AS (SELECT task, fold, model, y, s0 / (s0 + s1 + s2) AS p0, s1 / (s0 + s1 + s2) AS p1, s2 / (s0 + s1 + s2) AS p2 FROM raw)"""

# ---------------------------------------------------------------- spectra


def spectra(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    e = table(spark, sf, "embeddings").where(c("vec_id").isNotNull())
    nine = F.pmod("vec_id", F.lit(9)).cast("double")
    return e.select(
        F.lit("emb").alias("dataset"), F.lit("emb__0").alias("task"), c("vec_id").alias("spectrum_id"),
        c("embedding").cast("array<double>").alias("intensities"),
        F.create_map(
            F.lit("t0"), F.pmod("label", F.lit(4)).cast("double"), F.lit("t1"), nine,
            F.lit("t2"), F.when(F.pmod("vec_id", F.lit(5)) > 0, F.pmod("vec_id", F.lit(3)).cast("double"))).alias("targets"),
        F.concat(F.lit("c"), c("label").cast("string")).alias("label"),
        F.concat(F.lit("g"), F.floor(c("vec_id") / 4).cast("string")).alias("group_id"),
        (F.get("embedding", F.lit(0)).cast("double") * 10 + c("label")).alias("y"))


SPECTRA = """
x AS (SELECT 'emb' AS dataset, 'emb__0' AS task, vec_id AS spectrum_id, CAST(embedding AS DOUBLE[]) AS v,
        CAST(label % 4 AS DOUBLE) AS t0, CAST(vec_id % 9 AS DOUBLE) AS t1,
        CASE WHEN vec_id % 5 > 0 THEN CAST(vec_id % 3 AS DOUBLE) END AS t2,
        'c' || CAST(label AS VARCHAR) AS label, 'g' || CAST(vec_id // 4 AS VARCHAR) AS group_id,
        CAST(embedding[1] AS DOUBLE) * 10 + label AS y FROM embeddings),
xl AS (SELECT spectrum_id, label, unnest(range(64)) AS channel, unnest(v) AS x FROM x)"""


def axis(spark: SparkSession, sf: str) -> DataFrame:
    """Wavenumbers 400, 425, ... for the channels the spectra really have."""
    width = F.max(F.size("embedding"))
    return table(spark, sf, "embeddings").agg(width.alias("p")).select(
        F.lit("emb").alias("dataset"), F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: 400.0 + 25.0 * i).alias("wavenumbers"))


def positive_spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Spectra with a drifting baseline, so that baseline steps have something to remove."""
    return spectra(spark, sf).withColumn("intensities", F.transform(
        "intensities", lambda v, i: v + 2.0 + 0.01 * i * F.pmod("spectrum_id", F.lit(7))))


POSITIVE = SPECTRA + """,
pos AS (SELECT spectrum_id, channel, x + 2e0 + 1e-2 * channel * (spectrum_id % 7) AS x FROM xl)"""

# ---------------------------------------------------------------- comparison


def nudge(digits: int) -> float:
    """Moves exact decimal ties off the rounding edge, where two engines' last bits would decide."""
    return 0.0314159265 * 10.0**-digits


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison (sums differ in the last bits between engines); -0.0 becomes 0.0."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = special.get(f.name, digits)
            out.append((F.round(F.col(f"`{f.name}`") + nudge(d), d) + 0.0).alias(f.name))
        elif isinstance(f.dataType, T.ByteType):
            out.append(F.col(f"`{f.name}`").cast("int").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def r(expr: str, digits: int = 6) -> str:
    """The SQL twin of :func:`rounded` for one expression."""
    return f"(round(({expr}) + {nudge(digits)!r}, {digits}) + 0e0)"


def long(df: DataFrame, column: str = "intensities", digits: int = 6, keys=("spectrum_id",)) -> DataFrame:
    """One row per (spectrum, channel)."""
    return rounded(df.select(*keys, F.posexplode(column).alias("channel", "x")).withColumn("channel", F.col("channel").cast("long")), digits)
