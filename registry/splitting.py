"""Queries: task filters, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.views import RESULTS, SPECTRA, axis, results, rounded, spectra, table
from spectrafold.operators import splits, tasks

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def slim(spark, sf):
    return spectra(spark, sf).drop("intensities")


# ---------------------------------------------------------------- filters


@query("select_target", "WITH" + SPECTRA + "SELECT spectrum_id, t1 AS y FROM x")
def _(spark, sf):
    return tasks.select_target(spectra(spark, sf).drop("y"), "t1").select("spectrum_id", "y")


def holed(spark, sf):
    """Every seventh spectrum misses a channel, every eleventh its label."""
    c = F.col
    return spectra(spark, sf).withColumn("intensities", F.transform("intensities", lambda v, i: F.when(
        (i == 3) & (c("spectrum_id") % 7 == 0), F.lit(float("nan"))).otherwise(v))).withColumn(
        "label", F.when(c("spectrum_id") % 11 != 0, c("label")))


@query("drop_nan_spectra", "WITH" + SPECTRA + "SELECT label, count(*) AS n FROM (SELECT CASE WHEN spectrum_id % 11 <> 0 THEN label END AS label FROM x WHERE spectrum_id % 7 <> 0) GROUP BY 1")
def _(spark, sf):
    return tasks.drop_nan_spectra(holed(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("drop_unlabeled", "WITH" + SPECTRA + "SELECT label, count(*) AS n FROM x WHERE spectrum_id % 11 <> 0 GROUP BY 1")
def _(spark, sf):
    return tasks.drop_unlabeled(holed(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("filter_rare_classes", "WITH" + SPECTRA + """,
kept AS (SELECT label FROM x GROUP BY 1 HAVING count(*) >= 50 AND count(DISTINCT group_id) >= 40)
SELECT spectrum_id, label FROM x WHERE label IN (SELECT label FROM kept) AND (SELECT count(*) FROM kept) >= 2""")
def _(spark, sf):
    return tasks.filter_rare_classes(slim(spark, sf), group="group_id", min_samples=50, min_groups=40).select("spectrum_id", "label")


@query("cap_rows", "WITH" + SPECTRA + """
SELECT spectrum_id, label FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('7|' || spectrum_id), spectrum_id) AS i FROM x) WHERE i <= 100""")
def _(spark, sf):
    return tasks.cap_rows(slim(spark, sf), 100, seed=7).select("spectrum_id", "label")


@query("cap_rows_hot", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('3|' || event_id), event_id) AS i FROM events) WHERE i <= 500")
def _(spark, sf):
    # The threshold is low, so that every event type takes the path of a hot key.
    return tasks.cap_rows(table(spark, sf, "events"), 500, seed=3, by=["event_type"], id_column="event_id", hot_rows=200).select("event_type", "event_id")


@query("prepare_task", "WITH" + SPECTRA + """,
ok AS (SELECT * FROM x WHERE spectrum_id % 7 <> 0 AND spectrum_id % 11 <> 0)
SELECT spectrum_id, label, group_id FROM ok WHERE label IN (SELECT label FROM ok GROUP BY 1 HAVING count(*) >= 35)
  AND (SELECT count(*) FROM (SELECT label FROM ok GROUP BY 1 HAVING count(*) >= 35)) >= 2""")
def _(spark, sf):
    return tasks.prepare_task(holed(spark, sf), problem_type="classification", min_samples=35).select("spectrum_id", "label", "group_id")


def protocol(spark, sf):
    """One protocol row per brand."""
    r = results(spark, sf)
    return r.groupBy("dataset").agg(
        F.max("task").alias("problem_type"), F.max("metric").alias("metric"), F.max("num_instances").alias("num_instances"),
        F.count_distinct("fold").alias("n_folds"),
    ).select(F.concat("dataset", F.lit("__0")).alias("task"), "dataset", "problem_type", "metric", "num_instances", "n_folds")


@query("protocol_tasks", "WITH" + RESULTS + "SELECT DISTINCT dataset || '__0' AS task FROM results WHERE task = 'classification' AND dataset IN ('Brand#4', 'Brand#8')")
def _(spark, sf):
    return tasks.protocol_tasks(protocol(spark, sf), "classification", ["Brand#4", "Brand#8__0"]).select("task")


def targets(spark, sf):
    """Datasets = brands, targets = the types of their parts."""
    part = table(spark, sf, "part")
    names = part.groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("target_names"), F.count(F.lit(1)).alias("num_instances"))
    return names.withColumnRenamed("p_brand", "dataset")


TARGETS = """
names AS (SELECT p_brand AS dataset, list_sort(list(DISTINCT p_type)) AS target_names, count(*) AS num_instances FROM part GROUP BY 1),
targets AS (SELECT dataset, num_instances, unnest(range(len(target_names))) AS target_idx, unnest(target_names) AS target_name FROM names)"""


def exclusions(spark, sf):
    return targets(spark, sf).where(F.col("num_instances") % 2 == 0).select(
        F.concat("dataset", F.lit("_1")).alias("key"), F.lit("trivial").alias("category"))


def class_counts(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("dataset"), F.col("p_size").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def target_list(spark, sf):
    return tasks.build_target_list(
        targets(spark, sf), class_counts(spark, sf), exclusions(spark, sf), excluded_names=["ECONOMY"], min_samples=5)


TARGET_LIST = TARGETS + """,
few AS (SELECT dataset FROM (SELECT p_brand AS dataset, p_size, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1 HAVING count(*) FILTER (n >= 5) < 2),
reasoned AS (SELECT t.*, CASE WHEN num_instances < 2500 THEN 10 WHEN num_instances > 250000 THEN 1 ELSE 3 END AS n_repeats,
   CASE WHEN target_idx = 1 AND num_instances % 2 = 0 THEN 'trivial' WHEN dataset IN (SELECT dataset FROM few) THEN 'too_few_classes' END AS exclusion_reason
  FROM targets t),
target_list AS (SELECT dataset, CAST(target_idx AS INTEGER) AS target_idx, target_name, num_instances, n_repeats,
   (target_name = 'ECONOMY' OR exclusion_reason IS NOT NULL) AS excluded, exclusion_reason FROM reasoned)"""


@query("build_target_list", "WITH" + TARGET_LIST + "SELECT * FROM target_list")
def _(spark, sf):
    return target_list(spark, sf)


@query("core_subset", "WITH" + TARGET_LIST + """
SELECT dataset, target_idx FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY target_idx) AS i FROM target_list
  WHERE NOT excluded AND num_instances >= 60 AND dataset <> 'Brand#2') WHERE i <= 2""")
def _(spark, sf):
    return tasks.core_subset(target_list(spark, sf), min_n=60, large=["Brand#2"])


@query("exclude_keys", "WITH" + TARGETS + """
SELECT dataset || '_' || target_idx AS key, dataset FROM targets
WHERE NOT (dataset || '_' || target_idx = 'Brand#1_0' OR dataset = 'Brand#5' OR target_name = 'PROMO')""")
def _(spark, sf):
    t = targets(spark, sf).select("dataset", F.posexplode("target_names").alias("target_idx", "target_name"))
    keys = tasks.excluded_keys(t, keys=["Brand#1_0"], datasets=["Brand#5"], names=["PROMO"])
    kept, _ = tasks.exclude_keys(t.select(F.concat_ws("_", "dataset", "target_idx").alias("key"), "dataset"), keys)
    return kept


@query("excluded_rows", "WITH" + TARGETS + "SELECT dataset || '_' || target_idx AS key FROM targets WHERE target_name = 'PROMO'")
def _(spark, sf):
    t = targets(spark, sf).select("dataset", F.posexplode("target_names").alias("target_idx", "target_name"))
    keys = tasks.excluded_keys(t, names=["PROMO"])
    return tasks.exclude_keys(t.select(F.concat_ws("_", "dataset", "target_idx").alias("key")), keys)[1]


@query("n_repeats", """SELECT n, CASE WHEN n < 2500 THEN 10 WHEN n > 250000 THEN 1 ELSE 3 END AS repeats, 1 AS lite
FROM (SELECT count(*) * 5 AS n FROM events GROUP BY event_type UNION ALL SELECT count(*) FROM part UNION ALL SELECT count(*) * 100 FROM lineitem)""")
def _(spark, sf):
    n = table(spark, sf, "events").groupBy("event_type").agg((F.count(F.lit(1)) * 5).alias("n")).select("n")
    n = n.unionAll(table(spark, sf, "part").agg(F.count(F.lit(1)))).unionAll(table(spark, sf, "lineitem").agg(F.count(F.lit(1)) * 100))
    return n.select("n", tasks.n_repeats("n").alias("repeats"), tasks.n_repeats("n", lite=True).alias("lite"))


@query("row_caps", """WITH d AS (SELECT p_brand AS dataset, count(*) AS n FROM part GROUP BY 1),
base AS (SELECT dataset, CASE WHEN n % 2 = 0 THEN n // 2 END AS cap FROM d),
model AS (SELECT dataset, least(c, coalesce(cap, c)) AS new, cap FROM base, (VALUES (20), (45)) v(c)
  UNION ALL SELECT b.dataset, least(n // 3, coalesce(cap, n)), cap FROM base b JOIN d ON d.dataset = b.dataset WHERE n % 3 = 0)
SELECT dataset, CAST(cap AS BIGINT) AS cap, true AS protocol FROM base
UNION ALL SELECT DISTINCT dataset, CAST(new AS BIGINT), false FROM model WHERE new IS DISTINCT FROM cap""")
def _(spark, sf):
    d = table(spark, sf, "part").groupBy(F.col("p_brand").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    caps = d.where(F.col("n") % 2 == 0).select("dataset", F.floor(F.col("n") / 2).alias("cap"))
    everywhere = spark.createDataFrame([(None, "a", 20), (None, "b", 45)], "dataset string, model string, cap long")
    model = everywhere.unionAll(d.where(F.col("n") % 3 == 0).select("dataset", F.lit("c"), F.floor(F.col("n") / 3)))
    return tasks.row_caps(d, caps, model)


def catalog_stats(spark, sf):
    """Brands as datasets: size from lineitem, channels and axis from part sizes, classes from types."""
    c = F.col
    part = table(spark, sf, "part")
    per_type = part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("k"))
    classes = per_type.groupBy("p_brand").agg(F.max("k").alias("max_class"), F.min("k").alias("min_class"), F.count(F.lit(1)).alias("n_targets"))
    sizes = part.groupBy("p_brand").agg(F.sum("p_size").alias("n_features"), F.sum(F.col("p_size") * 17).alias("n_samples"), F.max("p_retailprice").alias("freq_max"))
    n = F.substring("p_brand", 7, 10).cast("int")
    return classes.join(sizes, "p_brand").withColumn("is_grouped", F.when(n % 3 == 0, True).when(n % 3 == 1, False)).select(
        c("p_brand").alias("dataset"), "n_samples", "n_features", "n_targets", "is_grouped", "freq_max", "max_class", "min_class")


@query("categorize", """WITH t AS (SELECT p_brand, p_type, count(*) AS k FROM part GROUP BY 1, 2),
s AS (SELECT p_brand, sum(p_size) AS p, sum(p_size * 17) AS n, max(p_retailprice) AS f FROM part GROUP BY 1),
m AS (SELECT p_brand, max(k) * 1e0 / min(k) AS ir, count(*) AS nt FROM t GROUP BY 1)
SELECT p_brand AS dataset,
  CASE WHEN n < 100 THEN 'micro' WHEN n < 1000 THEN 'tiny' WHEN n < 10000 THEN 'small' WHEN n < 100000 THEN 'medium' ELSE 'large' END AS scale_tier,
  CASE WHEN p < 1000 THEN 'low' WHEN p < 3000 THEN 'medium' ELSE 'high' END AS dimensionality_tier,
  CASE CAST(substr(p_brand, 7) AS INTEGER) % 3 WHEN 0 THEN 'grouped' WHEN 1 THEN 'iid' ELSE 'unknown' END AS split_type,
  CASE WHEN ir < 3 THEN 'balanced' WHEN ir < 10 THEN 'moderate' ELSE 'severe' END AS imbalance_tier,
  CASE WHEN nt <= 1 THEN 'single-target' ELSE 'multi-target' END AS target_arity,
  CASE WHEN f <= 1800 THEN 'fingerprint' ELSE 'extended' END AS wavenumber_coverage
FROM s JOIN m USING (p_brand)""")
def _(spark, sf):
    return tasks.categorize(catalog_stats(spark, sf))


@query("dataset_stats", "WITH" + SPECTRA + """, c AS (SELECT label, count(*) AS n FROM x GROUP BY 1)
SELECT 'emb' AS dataset, (SELECT count(*) FROM x) AS n_samples, 64 AS n_features, 3 AS n_targets, true AS is_grouped,
  max(n) AS max_class, min(n) AS min_class, 1975e0 AS freq_max FROM c""")
def _(spark, sf):
    return tasks.dataset_stats(spectra(spark, sf), axis(spark, sf))


def overview(spark, sf):
    t = target_list(spark, sf)
    scored = t.where(~F.col("excluded")).select(F.concat_ws("__", "dataset", "target_idx").alias("task"))
    stats = catalog_stats(spark, sf)
    number = F.substring("dataset", 7, 10).cast("int")
    catalog = stats.where(number % 5 != 0).select(
        "dataset", F.concat(F.lit("Name "), "dataset").alias("name"), F.when(number % 2 == 0, "Medical").otherwise("Chemical").alias("domain"),
        F.when(number % 4 == 0, "Classification").otherwise("Regression").alias("task_type"), F.lit("Zenodo").alias("source"), (number % 3 == 0).alias("new"))
    return tasks.dataset_overview(t, scored, catalog, stats.select("dataset", "n_features"))


OVERVIEW = TARGET_LIST + """,
o AS (SELECT dataset, max(num_instances) AS n_spectra, count(*) AS n_targets, CAST(substr(dataset, 7) AS INTEGER) AS k FROM target_list WHERE NOT excluded GROUP BY 1),
ov AS (SELECT o.dataset, CASE WHEN k % 5 <> 0 THEN 'Name ' || o.dataset ELSE o.dataset END AS name,
  CASE WHEN k % 5 = 0 THEN 'Unknown' WHEN k % 2 = 0 THEN 'Medical' ELSE 'Chemical' END AS domain,
  CASE WHEN k % 5 = 0 THEN 'Unknown' WHEN k % 4 = 0 THEN 'Classification' ELSE 'Regression' END AS task_type,
  n_spectra, n_features, n_targets, CASE WHEN k % 5 = 0 THEN 'Other' ELSE 'Zenodo' END AS source, (k % 5 <> 0 AND k % 3 = 0) AS new
  FROM o JOIN (SELECT p_brand AS dataset, CAST(sum(p_size) AS BIGINT) AS n_features FROM part GROUP BY 1) f ON f.dataset = o.dataset)"""


@query("dataset_overview", "WITH" + OVERVIEW + "SELECT * FROM ov")
def _(spark, sf):
    return overview(spark, sf)


@query("composition", "WITH" + OVERVIEW + """
SELECT axis, value, count(*) AS datasets, CAST(sum(n_spectra) AS BIGINT) AS spectra FROM (
  SELECT 'domain' AS axis, domain AS value, n_spectra FROM ov UNION ALL SELECT 'task_type', task_type, n_spectra FROM ov
  UNION ALL SELECT 'source', source, n_spectra FROM ov
  UNION ALL SELECT 'provenance', CASE WHEN new THEN 'First published here' ELSE 'Previously published' END, n_spectra FROM ov) GROUP BY 1, 2""")
def _(spark, sf):
    return tasks.composition(overview(spark, sf))


# ---------------------------------------------------------------- groups and folds


@query("infer_groups", "WITH" + SPECTRA + """,
k AS (SELECT spectrum_id, list_filter([t0, t1, t2], lambda t: t IS NOT NULL AND t <> 0) AS key FROM x)
SELECT spectrum_id, CAST(CASE WHEN len(key) = 0 THEN spectrum_id ELSE min(spectrum_id) OVER (PARTITION BY key) END AS VARCHAR) AS group_id FROM k""")
def _(spark, sf):
    return splits.infer_groups(slim(spark, sf).drop("group_id")).select("spectrum_id", "group_id")


@query("infer_groups_hot", "WITH" + SPECTRA + """,
k AS (SELECT spectrum_id, list_filter([t0, t1, t2], lambda t: t IS NOT NULL AND t <> 0) AS key FROM x)
SELECT spectrum_id, CAST(CASE WHEN len(key) = 0 THEN spectrum_id ELSE min(spectrum_id) OVER (PARTITION BY key) END AS VARCHAR) AS group_id FROM k""")
def _(spark, sf):
    return splits.infer_groups(slim(spark, sf).drop("group_id"), hot_rows=5).select("spectrum_id", "group_id")


@query("infer_groups_named", "WITH" + SPECTRA + """,
k AS (SELECT spectrum_id, list_filter([CASE WHEN t0 <> 0 THEN 't0=' || CAST(t0 AS INTEGER) END, CASE WHEN t1 <> 0 THEN 't1=' || CAST(t1 AS INTEGER) END,
   CASE WHEN t2 <> 0 THEN 't2=' || CAST(t2 AS INTEGER) END], lambda t: t IS NOT NULL) AS key FROM x)
SELECT spectrum_id, CASE WHEN len(key) = 0 THEN spectrum_id ELSE min(spectrum_id) OVER (PARTITION BY key) END AS first_id FROM k""")
def _(spark, sf):
    named = splits.infer_groups_named(slim(spark, sf)).select("spectrum_id", "group_id")
    first = named.groupBy("group_id").agg(F.min("spectrum_id").alias("first_id"))
    return named.join(first, "group_id").select("spectrum_id", "first_id")


KFOLD = """SELECT task, repeat, spectrum_id, CAST((row_number() OVER (PARTITION BY task, repeat ORDER BY md5(repeat || '|' || spectrum_id), spectrum_id) - 1) % 3 AS INTEGER) AS fold
FROM x, (SELECT CAST(range AS INTEGER) AS repeat FROM range(2))"""

query("kfold", "WITH" + SPECTRA + KFOLD)(lambda spark, sf: rounded(splits.kfold(slim(spark, sf), 3, 2)))
query("kfold_hot", "WITH" + SPECTRA + KFOLD)(lambda spark, sf: rounded(splits.kfold(slim(spark, sf), 3, 2, hot_rows=50)))

query("kfold_events", """SELECT event_type AS task, 0 AS repeat, event_id AS spectrum_id,
  CAST((row_number() OVER (PARTITION BY event_type ORDER BY md5('0|' || event_id), event_id) - 1) % 3 AS INTEGER) AS fold FROM events""")(
    lambda spark, sf: rounded(splits.kfold(table(spark, sf, "events").select(
        F.col("event_type").alias("task"), F.col("event_id").alias("spectrum_id")), 3, 1)))

query("stratified_kfold", "WITH" + SPECTRA + """
SELECT task, repeat, spectrum_id, CAST((row_number() OVER (PARTITION BY task, repeat, label ORDER BY md5(repeat || '|' || spectrum_id), spectrum_id) - 1) % 3 AS INTEGER) AS fold
FROM x, (SELECT CAST(range AS INTEGER) AS repeat FROM range(2))""")(
    lambda spark, sf: rounded(splits.stratified_kfold(slim(spark, sf), 3, 2)))

GROUP_KFOLD = """,
g AS (SELECT DISTINCT task, repeat, group_id FROM x, (SELECT CAST(range AS INTEGER) AS repeat FROM range(2))),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY task, repeat ORDER BY md5(repeat || '|' || group_id), group_id) - 1) % 3 AS INTEGER) AS fold FROM g)"""

query("group_kfold", "WITH" + SPECTRA + GROUP_KFOLD + "SELECT task, repeat, spectrum_id, fold FROM x JOIN f USING (task, group_id)")(
    lambda spark, sf: rounded(splits.group_kfold(slim(spark, sf), 3, 2)))

query("group_kfold_hot", "WITH" + SPECTRA + GROUP_KFOLD + "SELECT task, repeat, spectrum_id, fold FROM x JOIN f USING (task, group_id)")(
    lambda spark, sf: rounded(splits.group_kfold(slim(spark, sf), 3, 2, hot_rows=2)))


@query("stratified_group_kfold")
def _(spark, sf):
    return rounded(splits.stratified_group_kfold(slim(spark, sf), 3, 2))


@query("stratified_group_kfold_check", "WITH" + SPECTRA + "SELECT 'emb__0' AS task, repeat, count(*) AS n_rows, count(DISTINCT spectrum_id) AS n_ids, count(DISTINCT group_id) AS group_folds, true AS balanced FROM x, (SELECT CAST(range AS INTEGER) AS repeat FROM range(2)) GROUP BY repeat")
def _(spark, sf):
    rows = slim(spark, sf)
    folds = splits.stratified_group_kfold(rows, 3, 2)
    joined = folds.join(rows.select("spectrum_id", "group_id"), "spectrum_id")
    per_fold = joined.groupBy("task", "repeat", "fold").agg(F.count(F.lit(1)).alias("n"))
    even = per_fold.groupBy("task", "repeat").agg((F.max("n") - F.min("n") <= 16).alias("balanced"))
    return joined.groupBy("task", "repeat").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("spectrum_id").alias("n_ids"), F.count_distinct("group_id", "fold").alias("group_folds")
    ).join(even, ["task", "repeat"])


def partly_labeled(spark, sf):
    return slim(spark, sf).withColumn("label", F.when(F.col("spectrum_id") % 11 != 0, F.col("label")))


@query("semi_supervised_folds", "WITH" + SPECTRA + """,
u AS (SELECT *, spectrum_id % 11 <> 0 AS labeled FROM x),
r AS (SELECT CAST(range AS INTEGER) AS repeat FROM range(2)), k AS (SELECT CAST(range AS INTEGER) AS fold FROM range(3)),
g AS (SELECT DISTINCT task, repeat, group_id FROM u, r WHERE labeled),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY task, repeat ORDER BY md5(repeat || '|' || group_id), group_id) - 1) % 3 AS INTEGER) AS own FROM g)
SELECT task, repeat, fold, spectrum_id, CASE WHEN own = fold THEN 'test' ELSE 'train' END AS part FROM u JOIN f USING (task, group_id), k WHERE labeled
UNION ALL SELECT u.task, r.repeat, fold, spectrum_id, 'train' FROM u CROSS JOIN r CROSS JOIN k
  LEFT JOIN f ON f.task = u.task AND f.repeat = r.repeat AND f.group_id = u.group_id WHERE NOT labeled AND own IS DISTINCT FROM fold""")
def _(spark, sf):
    rows = partly_labeled(spark, sf)
    folds = splits.group_kfold(rows.where(F.col("label").isNotNull()), 3, 2)
    return rounded(splits.semi_supervised_folds(rows, folds, 3, group="group_id"))


@query("train_test_split", "WITH" + SPECTRA + """
SELECT spectrum_id, CASE WHEN row_number() OVER (PARTITION BY task ORDER BY md5('5|' || spectrum_id), spectrum_id) <= ceil(0.2e0 * count(*) OVER (PARTITION BY task)) THEN 'test' ELSE 'train' END AS part FROM x""")
def _(spark, sf):
    return splits.train_test_split(slim(spark, sf), 0.2, 5).select("spectrum_id", "part")


@query("train_test_split_stratified", "WITH" + SPECTRA + """
SELECT spectrum_id, CASE WHEN row_number() OVER (PARTITION BY task, label ORDER BY md5('5|' || spectrum_id), spectrum_id) <= ceil(0.2e0 * count(*) OVER (PARTITION BY task, label)) THEN 'test' ELSE 'train' END AS part FROM x""")
def _(spark, sf):
    return splits.train_test_split(slim(spark, sf), 0.2, 5, label="label").select("spectrum_id", "part")


@query("group_shuffle_split", "WITH" + SPECTRA + """, g AS (SELECT DISTINCT task, group_id FROM x),
s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY task ORDER BY md5('5|' || group_id), group_id) <= ceil(0.2e0 * count(*) OVER (PARTITION BY task)) THEN 'test' ELSE 'train' END AS part FROM g)
SELECT spectrum_id, part FROM x JOIN s USING (task, group_id)""")
def _(spark, sf):
    return splits.group_shuffle_split(slim(spark, sf), 0.2, 5).select("spectrum_id", "part")


@query("export_folds", "WITH" + SPECTRA + "SELECT 'emb__0' AS task, repeat, count(*) AS n_rows, count(DISTINCT spectrum_id) AS n_ids, true AS is_partition FROM x, (SELECT CAST(range AS INTEGER) AS repeat FROM range(3)) GROUP BY repeat")
def _(spark, sf):
    prepared = tasks.prepare_task(spectra(spark, sf), problem_type="regression", label="y")
    folds = splits.export_folds(prepared, problem_type="regression", label="y", repeats=3)
    return splits.partition_check(folds)


@query("train_test_ids", "WITH" + SPECTRA + ", k AS (" + KFOLD + ") SELECT spectrum_id, CASE WHEN fold = 1 THEN 'test' ELSE 'train' END AS part FROM k WHERE repeat = 1")
def _(spark, sf):
    return splits.train_test_ids(splits.kfold(slim(spark, sf), 3, 2), "emb__0", 1, 1)


@query("bag_folds", "WITH" + SPECTRA + ", k AS (" + KFOLD + """), tr AS (SELECT task, repeat, o AS fold, spectrum_id, group_id FROM k JOIN x USING (task, spectrum_id), range(3) t(o) WHERE fold <> o AND repeat = 0),
g AS (SELECT DISTINCT fold, group_id FROM tr), b AS (SELECT *, CAST((row_number() OVER (PARTITION BY fold ORDER BY md5('bag|' || group_id), group_id) - 1) % 8 AS INTEGER) AS bag FROM g)
SELECT CAST(fold AS INTEGER) AS fold, spectrum_id, bag FROM tr JOIN b USING (fold, group_id)""")
def _(spark, sf):
    rows = slim(spark, sf)
    own = splits.kfold(rows, 3, 1).withColumnRenamed("fold", "_own").join(rows.select("task", "spectrum_id", "group_id"), ["task", "spectrum_id"])
    train = own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(F.col("fold") != F.col("_own"))
    return splits.bag_folds(train, 8, group="group_id").select("fold", "spectrum_id", "bag")


@query("check_result_folds", "WITH" + SPECTRA + ", k AS (" + KFOLD + """),
n AS (SELECT fold, count(*) AS n FROM k WHERE repeat = 0 GROUP BY 1), n1 AS (SELECT fold, count(*) AS n FROM k WHERE repeat = 1 GROUP BY 1)
SELECT 'right' AS framework, 'emb__0' AS task, 0 AS repeat, fold, n AS n_test, 'match' AS status, CAST(NULL AS BIGINT) AS max_train_samples FROM n
UNION ALL SELECT 'capped', 'emb__0', 0, fold, c, 'match_capped', 90 FROM (SELECT CAST(i AS INTEGER) AS fold, 30 AS c FROM range(3) t(i))
UNION ALL SELECT 'shifted', 'emb__0', 0, CAST((fold + 1) % 3 AS INTEGER), n, 'mismatch', NULL FROM n
UNION ALL SELECT 'later', 'emb__0', 1, fold, n, 'extra_repeat', NULL FROM n1
UNION ALL SELECT 'other', 'nowhere', 0, fold, n, 'not_in_protocol', NULL FROM n
UNION ALL SELECT 'empty', 'emb__0', 0, 0, NULL, 'no_test_indices', NULL""")
def _(spark, sf):
    rows = slim(spark, sf)
    full = splits.kfold(rows, 3, 2).withColumn("fold", F.col("fold").cast("int"))
    capped = splits.kfold(tasks.cap_rows(rows, 90, by=["task"]), 3, 1).withColumn("fold", F.col("fold").cast("int"))
    first = full.where(F.col("repeat") == 0)
    cols = ["framework", "task", "repeat", "fold", "spectrum_id"]
    named = lambda df, name: df.withColumn("framework", F.lit(name)).select(*cols)
    tested = named(first, "right").unionByName(named(capped, "capped")).unionByName(
        named(first.withColumn("fold", F.pmod(F.col("fold") + 1, F.lit(3)).cast("int")), "shifted")).unionByName(
        named(full.where(F.col("repeat") == 1), "later")).unionByName(
        named(first.withColumn("task", F.lit("nowhere")), "other")).unionByName(
        named(first.limit(1).withColumn("fold", F.lit(0)).withColumn("spectrum_id", F.lit(None).cast("long")), "empty"))
    sets = first.withColumn("cap", F.lit(None).cast("long")).withColumn("is_protocol", F.lit(True)).unionByName(
        capped.withColumn("cap", F.lit(90).cast("long")).withColumn("is_protocol", F.lit(False)))
    spec = rows.groupBy("task").agg(F.lit(1).alias("n_repeats"))
    return splits.check_result_folds(tested, sets, spec)
