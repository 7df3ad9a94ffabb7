"""Queries: result preparation, rankings, version comparisons, run times."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from registry.splitting import protocol
from registry.views import (
    REFERENCE, RESULTS, RESULTS_WITH_DUMMY, RESULTS_WITH_GAPS, r, results, results_with_dummy, results_with_gaps, rounded, table,
)
from spectrafold.functions import names
from spectrafold.operators import elo as elo_ops
from spectrafold.operators import ranking as rk
from spectrafold.operators import reports as rp
from spectrafold.operators import results as rs
from spectrafold.plans.compare import compare
from spectrafold.session import materialize

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# ---------------------------------------------------------------- preparation


def hpo(spark, sf):
    """Tuning results: default and tuned rows, duplicates under two result names, a reference system."""
    c = F.col
    base = results(spark, sf).select("dataset", "fold", c("model").alias("config_type"), "metric_error", "metric", "problem_type",
                                     "time_train_s", "time_infer_s", c("model").alias("method"), F.concat(F.lit("ours-"), "model").alias("ta_name"))
    default = base.withColumn("method_subtype", F.lit("default"))
    tuned = default.where(c("fold") < 2).withColumn("method_subtype", F.lit("tuned")).withColumn("metric_error", c("metric_error") - 0.05)
    other = default.where(c("config_type") == "M3").withColumn("ta_name", F.lit("other-M3")).withColumn("metric_error", c("metric_error") + 1)
    system = default.where(c("config_type") == "M2").withColumn("config_type", F.lit(None).cast("string")).withColumn("method", F.lit("system-run")).withColumn(
        "method_subtype", F.lit(None).cast("string")).withColumn("ta_name", F.lit("system"))
    return default.unionByName(tuned).unionByName(other).unionByName(system)


def brand_targets(spark, sf):
    number = F.substring("dataset", 7, 10).cast("int")
    sizes = results(spark, sf).groupBy("dataset").agg(F.max("num_instances").alias("num_instances"))
    return sizes.select("dataset", F.lit(0).alias("target_idx"), F.lit("t").alias("target_name"), "num_instances",
                        F.lit(1).alias("n_repeats"), (number % 6 == 0).alias("excluded"))


@query("load_results", "WITH" + RESULTS + f"""
SELECT dataset || '__0' AS dataset, fold, model, {r("greatest(CASE WHEN fold < 2 THEN metric_error - 5e-2 ELSE metric_error END, 0e0)")} AS metric_error,
  task, 'ours-' || model AS ta_name, false AS reference, num_instances FROM results
WHERE CAST(substr(dataset, 7) AS INTEGER) % 6 <> 0 AND model <> 'M11' AND fold < 2
UNION ALL SELECT dataset || '__0', fold, 'SYSTEM', {r('metric_error')}, task, 'system', true, num_instances FROM results
WHERE CAST(substr(dataset, 7) AS INTEGER) % 6 <> 0 AND model = 'M2' AND fold < 2""")
def _(spark, sf):
    rows = hpo(spark, sf).withColumn("dataset", F.concat("dataset", F.lit("__0")))
    out = rs.load_results(rows, variant="tuned", targets=brand_targets(spark, sf), exclude_models=["M11"],
                          references={"system-run": "SYSTEM"}, own_prefix="ours-", n_splits=2)
    return rounded(out.select("dataset", "fold", "model", "metric_error", "task", "ta_name", "reference", "num_instances"))


@query("load_own_results", "WITH" + RESULTS + f"SELECT dataset, fold, model, {r('metric_error')} AS metric_error, num_instances FROM results WHERE task = 'classification' AND fold < 2")
def _(spark, sf):
    spec = protocol(spark, sf).where(F.col("problem_type") == "classification").select(
        F.col("dataset").alias("task"), F.lit(2).alias("n_folds"), "num_instances")
    kept, _ = rs.load_own_results(results(spark, sf), spec)
    return rounded(kept.select("dataset", "fold", "model", "metric_error", "num_instances"))


@query("outside_tasks", "WITH" + RESULTS + "SELECT DISTINCT dataset FROM results WHERE task = 'regression'")
def _(spark, sf):
    spec = protocol(spark, sf).where(F.col("problem_type") == "classification").select(
        F.col("dataset").alias("task"), F.lit(2).alias("n_folds"), "num_instances")
    return rs.load_own_results(results(spark, sf), spec)[1]


@query("attach_fold_metrics", "WITH" + RESULTS + f"SELECT dataset, fold, model, {r('CASE WHEN fold < 2 THEN metric_error + 2 END')} AS mae FROM results")
def _(spark, sf):
    res = results(spark, sf).withColumn("mae", F.lit(-1.0))
    per_fold = res.where(F.col("fold") < 2).select("ta_name", "dataset", "fold", (F.col("metric_error") + 1).alias("mae"), F.lit(1).alias("seq"))
    per_fold = per_fold.unionByName(per_fold.withColumn("mae", F.col("mae") + 1).withColumn("seq", F.lit(2)))
    return rounded(rs.attach_fold_metrics(res, per_fold, "seq").select("dataset", "fold", "model", "mae"))


@query("select_metric", "WITH" + RESULTS + f"""
SELECT dataset, fold, model, {r("CASE WHEN task = 'classification' THEN 1 - metric_error * 2 ELSE 1 / (1 + metric_error) END")} AS metric_error,
  CASE WHEN task = 'classification' THEN 'accuracy' ELSE 'rpd' END AS metric FROM results WHERE NOT (task = 'classification' AND fold = 1)""")
def _(spark, sf):
    e = F.col("metric_error")
    res = results(spark, sf).withColumn("accuracy", F.when(F.col("fold") != 1, e * 2)).withColumn("rpd", 1 + e)
    return rounded(rs.select_metric(res, classification="accuracy", regression="rpd").select("dataset", "fold", "model", "metric_error", "metric"))


@query("coverage", "WITH" + RESULTS_WITH_GAPS + """,
p AS (SELECT dataset, task, count(DISTINCT fold) AS need FROM results GROUP BY 1, 2),
f AS (SELECT model, task, dataset, count(DISTINCT fold) AS have FROM gaps GROUP BY 1, 2, 3),
t AS (SELECT task, count(*) AS tasks_total, list(dataset ORDER BY dataset) AS every FROM p GROUP BY 1)
SELECT model, task, count(*) AS tasks_run, tasks_total, count(*) FILTER (have >= need) AS tasks_complete,
  coalesce(array_to_string(list_sort(list_filter(every, lambda d: NOT list_contains(list(dataset), d))), ','), '') AS missing_tasks
FROM f JOIN p USING (dataset, task) JOIN t USING (task) GROUP BY model, task, tasks_total, every""")
def _(spark, sf):
    spec = protocol(spark, sf).withColumn("task", F.col("dataset"))
    out = rs.coverage(results_with_gaps(spark, sf), spec)
    return out.withColumn("missing_tasks", F.concat_ws(",", F.sort_array("missing_tasks")))


def own_and_reference(spark, sf):
    res = results(spark, sf).withColumn("reference", F.lit(False))
    own = res.where(F.col("model").isin("M1", "M2") & (F.col("task") == "regression")).withColumn(
        "model", F.when(F.col("model") == "M1", "MINE").otherwise(F.col("model"))).withColumn("metric_error", F.col("metric_error") / 2)
    return own, res


MERGED = """ FROM results WHERE task = 'regression' AND model <> 'M2'
UNION ALL SELECT dataset, fold, CASE model WHEN 'M1' THEN 'MINE' ELSE model END, """ + r("metric_error / 2") + """ FROM results WHERE task = 'regression' AND model IN ('M1', 'M2')"""


@query("merge_reference", "WITH" + RESULTS + f"SELECT dataset, fold, model, {r('metric_error')} AS metric_error" + MERGED)
def _(spark, sf):
    own, ref = own_and_reference(spark, sf)
    return rounded(rs.merge_reference(own, ref, replace=True, tasks="own").select("dataset", "fold", "model", "metric_error"))


@query("load_reference", "WITH" + RESULTS + f"SELECT dataset, fold, model, {r('metric_error')} AS metric_error FROM results WHERE model = 'M4'")
def _(spark, sf):
    return rounded(rs.load_reference(results(spark, sf), ["M4", "M5"], ["M5"]).select("dataset", "fold", "model", "metric_error"))


IMPUTED = RESULTS_WITH_GAPS + f""",
cells AS (SELECT * FROM gaps WHERE model = '{REFERENCE}'),
present AS (SELECT g.* FROM gaps g SEMI JOIN cells c ON c.dataset = g.dataset AND c.fold = g.fold),
kept AS (SELECT model FROM (SELECT DISTINCT model FROM gaps) m WHERE
  ((SELECT count(*) FROM cells) - (SELECT count(*) FROM present p WHERE p.model = m.model)) * 1e2 / (SELECT count(*) FROM cells) <= 50),
imputed AS (SELECT c.dataset, c.fold, k.model, c.task, c.num_instances, coalesce(p.metric_error, c.metric_error) AS metric_error,
   p.time_train_s, p.time_infer_s, p.model IS NULL AS imputed
  FROM cells c CROSS JOIN kept k LEFT JOIN present p ON p.dataset = c.dataset AND p.fold = c.fold AND p.model = k.model)"""


@query("impute_missing", "WITH" + IMPUTED + f"SELECT dataset, fold, model, {r('metric_error')} AS metric_error, {r('time_train_s', 6)} AS time_train_s, imputed FROM imputed")
def _(spark, sf):
    out = rs.impute_missing(results_with_gaps(spark, sf), reference_model=REFERENCE)
    return rounded(out.select("dataset", "fold", "model", "metric_error", "time_train_s", "imputed"), time_train_s=6)


@query("task_metadata", "WITH" + RESULTS + """
SELECT dataset, max(problem_type) AS problem_type, max(fold) + 1 AS n_folds, max(fold // 2) + 1 AS n_repeats,
  CASE max(problem_type) WHEN 'regression' THEN 'Supervised Regression' ELSE 'Supervised Classification' END AS task_type FROM results GROUP BY 1""")
def _(spark, sf):
    return rs.task_metadata(results(spark, sf).withColumn("repeat", F.floor(F.col("fold") / 2).cast("int")))


@query("build_protocol", "WITH" + RESULTS + """
SELECT dataset || '__0' AS task, dataset, 0 AS target_idx, 't' AS target_name, max(task) AS problem_type, max(metric) AS metric,
  max(num_instances) AS num_instances, 1 AS n_repeats, count(DISTINCT fold) AS n_folds FROM results
WHERE CAST(substr(dataset, 7) AS INTEGER) % 6 <> 0 GROUP BY dataset""")
def _(spark, sf):
    res = results(spark, sf).withColumn("dataset", F.concat("dataset", F.lit("__0")))
    return rs.build_protocol(res, brand_targets(spark, sf))


@query("check_metric_consistency", "WITH" + RESULTS + f"SELECT dataset, fold, model, metric, {r('metric_error')} AS metric_error, {r('1e-3 * (fold + 1)')} AS gap FROM results WHERE model = 'M6'")
def _(spark, sf):
    e, off = F.col("metric_error"), F.when(F.col("model") == "M6", 1e-3 * (F.col("fold") + 1)).otherwise(1e-9)
    return rounded(rs.check_metric_consistency(results(spark, sf).withColumn("log_loss", e + off).withColumn("rmse", e - off), ["log_loss", "rmse"]))


@query("preprocessing_label", """WITH m AS (SELECT DISTINCT 'M' || (l_suppkey % 12) AS model, CAST(l_suppkey % 12 AS INTEGER) AS k FROM lineitem)
SELECT model, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'SNV, other' WHEN k % 2 = 0 THEN 'SNV' WHEN k % 3 = 0 THEN 'other' ELSE 'none' END AS preprocessing FROM m""")
def _(spark, sf):
    k = F.pmod("l_suppkey", F.lit(12)).cast("int")
    models = table(spark, sf, "lineitem").select(k.alias("k")).distinct().select("k", F.concat(F.lit("M"), F.col("k").cast("string")).alias("model"))
    hyper = models.select("model", F.create_map(
        F.lit("alpha"), F.lit("1.0"), F.lit("prep_snv_enabled"), (F.col("k") % 2 == 0).cast("string"),
        F.lit("prep_snv_order"), F.lit("true"), F.lit("prep_other_enabled"), (F.col("k") % 3 == 0).cast("string")).alias("hyperparameters"))
    return rs.preprocessing_label(hyper, {"prep_snv_enabled": "SNV"})


TRIVIAL = RESULTS + """,
s AS (SELECT *, greatest(round(metric_error * 100) / 100 - 46e-3 * (CAST(substr(dataset, 7) AS INTEGER) % 2) , 0) AS err FROM results)"""


def shifted(spark, sf):
    """Errors to two decimals; low ones on odd brands become 0."""
    number = F.substring("dataset", 7, 10).cast("int")
    e = F.round(F.col("metric_error") * 100) / 100 - 0.046 * (number % 2)
    return results(spark, sf).withColumn("metric_error", F.greatest(e, F.lit(0.0)))


@query("trivial_keys", "WITH" + TRIVIAL + """,
worst AS (SELECT dataset, model, max(err) AS w FROM s GROUP BY 1, 2),
perfect AS (SELECT dataset, 'perfect:' || min(model) AS reason FROM worst WHERE w <= 3e-3 GROUP BY 1),
lv AS (SELECT dataset, fold, err, count(*) AS n, min(err) OVER (PARTITION BY dataset, fold) AS best FROM (SELECT dataset, fold, round(err, 4) AS err FROM s) GROUP BY 1, 2, 3),
tie AS (SELECT dataset, 'tie:' || max(n) AS reason FROM lv WHERE err = best GROUP BY 1 HAVING min(n) >= 2)
SELECT coalesce(p.dataset, t.dataset) AS dataset, coalesce(p.reason, t.reason) AS reason FROM perfect p FULL JOIN tie t ON t.dataset = p.dataset""")
def _(spark, sf):
    return rs.trivial_keys(shifted(spark, sf), perfect_clf=0.003, perfect_reg=0.003)


@query("filter_trivial", "WITH" + TRIVIAL + """, worst AS (SELECT dataset, model, max(err) AS w FROM s GROUP BY 1, 2)
SELECT dataset, count(*) AS n FROM s WHERE dataset NOT IN (SELECT dataset FROM worst WHERE w <= 3e-3) GROUP BY 1""")
def _(spark, sf):
    rows = shifted(spark, sf)
    config = {"trivial_filter": {"enabled": True, "perfect_clf": 0.003, "perfect_reg": 0.003, "min_tie_models": 10_000}}
    return rs.filter_keys(rows, rs.configured_keys(rows, config, "trivial_filter")).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("unlearnable_keys", "WITH" + RESULTS_WITH_DUMMY + f""",
m AS (SELECT dataset, model, avg(metric_error) AS e FROM dummied WHERE NOT (model = 'DUMMY' AND dataset = 'Brand#7') GROUP BY 1, 2),
b AS (SELECT dataset, min(e) FILTER (model = 'DUMMY') AS d, min(e) FILTER (model <> 'DUMMY') AS best FROM m GROUP BY 1)
SELECT dataset, CASE WHEN d IS NULL THEN 'no_dummy_baseline' ELSE 'dummy_not_beaten' END AS reason, CASE WHEN d IS NOT NULL THEN {r('best')} END AS best_error
FROM b WHERE d IS NULL OR d - best <= 8e-3""")
def _(spark, sf):
    rows = results_with_dummy(spark, sf).where(~((F.col("model") == "DUMMY") & (F.col("dataset") == "Brand#7")))
    return rounded(rs.unlearnable_keys(rows, margin=0.008))


# ---------------------------------------------------------------- scores and ranks

PER_TASK = """,
t AS (SELECT dataset, model, avg(metric_error) AS e FROM {source} GROUP BY 1, 2),
st AS (SELECT dataset, min(e) AS best, median(e) AS med FROM t GROUP BY 1),
ns AS (SELECT dataset, model, CASE WHEN med - best > 1e-12 THEN greatest((med - e) / (med - best), 0e0) ELSE CAST(e <= med AS INTEGER) END AS score FROM t JOIN st USING (dataset)),
rk AS (SELECT dataset, model, rank() OVER (PARTITION BY dataset ORDER BY e) + (count(*) OVER (PARTITION BY dataset, e) - 1) / 2e0 AS rank,
   CASE WHEN e = 0 THEN 0e0 ELSE (1 - min(e) OVER (PARTITION BY dataset) / e) * 100 END AS imp FROM t),
wr AS (SELECT a.model AS model_i, b.model AS model_j, avg(CASE WHEN a.e < b.e THEN 1e0 WHEN a.e = b.e THEN 5e-1 ELSE 0e0 END) AS winrate, count(*) AS n_tasks
   FROM t a JOIN t b ON a.dataset = b.dataset AND a.model <> b.model GROUP BY 1, 2)"""
FULL = RESULTS + PER_TASK.format(source="results")
FILLED = IMPUTED + PER_TASK.format(source="imputed")

query("normalized_score", "WITH" + FULL + f"SELECT model, {r('avg(score)')} AS normalized_score FROM ns GROUP BY 1")(
    lambda spark, sf: rounded(rk.normalized_score(results(spark, sf))))
query("mean_ranks", "WITH" + FULL + f"SELECT model, {r('avg(rank)')} AS rank, {r('avg(imp)')} AS improvability FROM rk GROUP BY 1")(
    lambda spark, sf: rounded(rk.mean_ranks(results(spark, sf))))
query("winrate_matrix", "WITH" + FULL + f"SELECT model_i, model_j, {r('winrate')} AS winrate, n_tasks FROM wr")(
    lambda spark, sf: rounded(rk.winrate_matrix(results(spark, sf))))
query("winrate_matrix_gaps", "WITH" + RESULTS_WITH_GAPS + PER_TASK.format(source="gaps") + f"SELECT model_i, model_j, {r('winrate')} AS winrate, n_tasks FROM wr")(
    lambda spark, sf: rounded(rk.winrate_matrix(results_with_gaps(spark, sf))))
query("battles", "WITH" + RESULTS + """
SELECT a.model AS model_i, b.model AS model_j, sum(CASE WHEN a.metric_error < b.metric_error THEN 1e0 WHEN a.metric_error = b.metric_error THEN 5e-1 ELSE 0e0 END) AS score_i,
  sum(CASE WHEN a.metric_error > b.metric_error THEN 1e0 WHEN a.metric_error = b.metric_error THEN 5e-1 ELSE 0e0 END) AS score_j, count(*) AS n_battles
FROM results a JOIN results b ON a.dataset = b.dataset AND a.fold = b.fold AND a.model < b.model GROUP BY 1, 2""")(
    lambda spark, sf: rounded(rk.battles(results(spark, sf))))


@query("leaderboard", "WITH" + FILLED + f"""
SELECT model, {r('avg(score)')} AS normalized_score, {r('avg(rank)')} AS rank, {r('avg(imp)')} AS improvability,
  {r('(SELECT avg(winrate) FROM wr WHERE model_i = model)')} AS winrate, count(*) AS n_tasks FROM ns JOIN rk USING (dataset, model) GROUP BY 1""")
def _(spark, sf):
    filled = materialize(rs.impute_missing(results_with_gaps(spark, sf), reference_model=REFERENCE))
    tasks = filled.groupBy("model", "dataset").count().groupBy("model").agg(F.count(F.lit(1)).alias("n_tasks"))
    board = rk.normalized_score(filled).join(rk.mean_ranks(filled), "model").join(rk.winrate(rk.winrate_matrix(filled)), "model").join(tasks, "model")
    return rounded(board)


@query("compare_board", "WITH" + FILLED + f"""
SELECT model, model IN ('M1', 'M5') AS own, {r('avg(score)')} AS normalized_score, {r('avg(rank)')} AS rank, {r('avg(imp)')} AS improvability,
  {r('(SELECT avg(winrate) FROM wr WHERE model_i = model)')} AS winrate, count(*) AS n_tasks,
  {r('any_value(pct)')} AS imputed_pct FROM ns JOIN rk USING (dataset, model)
  JOIN (SELECT model, avg(CAST(imputed AS INTEGER)) * 100 AS pct FROM imputed GROUP BY 1) USING (model) GROUP BY 1""")
def _(spark, sf):
    rows = results_with_gaps(spark, sf)
    mine = F.col("model").isin("M1", "M5")
    spec = protocol(spark, sf).withColumn("task", F.col("dataset"))
    return rounded(compare(rows.where(mine), rows.where(~mine), spec, reference_model=REFERENCE, ratings=False).board)


@query("compare_coverage", "WITH" + RESULTS_WITH_GAPS + """,
ran AS (SELECT model, task, dataset, count(DISTINCT fold) AS n FROM gaps WHERE model IN ('M1', 'M5') GROUP BY 1, 2, 3),
need AS (SELECT dataset, task, count(DISTINCT fold) AS n FROM results GROUP BY 1, 2)
SELECT model, ran.task, count(*) AS tasks_run, (SELECT count(*) FROM need b WHERE b.task = ran.task) AS tasks_total,
  count(*) FILTER (ran.n >= need.n) AS tasks_complete FROM ran JOIN need USING (dataset) GROUP BY 1, 2""")
def _(spark, sf):
    rows = results_with_gaps(spark, sf)
    mine = F.col("model").isin("M1", "M5")
    spec = protocol(spark, sf).withColumn("task", F.col("dataset"))
    return compare(rows.where(mine), rows.where(~mine), spec, reference_model=REFERENCE, ratings=False).coverage.drop("missing_tasks")


@query("median_times", "WITH" + IMPUTED + f"""
SELECT model, {r('median(time_train_s)', 5)} AS median_time_train_s, {r('median(time_infer_s)', 5)} AS median_time_infer_s,
  {r('median(time_train_s + time_infer_s)', 5)} AS median_time_total_s, {r('median(time_infer_s / (num_instances / 3e0) * 1000)', 5)} AS median_infer_per_1k_s,
  {r('median((time_train_s + time_infer_s) / num_instances * 1000)', 5)} AS median_time_total_per_1k_s FROM imputed WHERE NOT imputed GROUP BY 1""")
def _(spark, sf):
    filled = rs.impute_missing(results_with_gaps(spark, sf), reference_model=REFERENCE)
    return rounded(rk.median_times(filled), 5)


# Bootstrap draws and ratings in SQL, for source tables with a group column grp. The ratings are found by steps of bounded
# curvature (a step never overshoots) instead of Newton's.
ROUNDS, STEPS = 200, 300
POISSON = [sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def draws(source: str) -> str:
    at_least = " + ".join(f"CAST(u >= {b!r} AS INTEGER)" for b in POISSON)
    return f""",
draws AS (SELECT dataset, round, {at_least} AS w FROM (
  SELECT dataset, round, CAST('0x' || substr(md5('42|' || round || '|' || dataset), 1, 10) AS BIGINT) / 1099511627776e0 AS u
  FROM (SELECT DISTINCT dataset FROM {source}) d, range({ROUNDS}) t(round)))"""


def ratings(source: str) -> str:
    """CTE elo (grp, model, elo, elo_plus, elo_minus) of a table (grp, dataset, fold, model, metric_error)."""
    return f""",
fights AS (SELECT a.grp, a.dataset, a.model AS mi, b.model AS mj, sum(CASE WHEN a.metric_error < b.metric_error THEN 1e0 WHEN a.metric_error = b.metric_error THEN 5e-1 ELSE 0e0 END) AS s, count(*) AS n
  FROM {source} a JOIN {source} b ON a.grp = b.grp AND a.dataset = b.dataset AND a.fold = b.fold AND a.model <> b.model GROUP BY 1, 2, 3, 4),
task_n AS (SELECT grp, dataset, sum(n) / 2e0 AS pairs FROM fights GROUP BY 1, 2),
pairs AS (SELECT grp, round, mi, mj, sum(s * w / pairs) AS s, sum(n * w / pairs) AS n FROM fights JOIN task_n USING (grp, dataset) JOIN draws USING (dataset) WHERE w > 0 GROUP BY 1, 2, 3, 4),
pair_share AS (SELECT grp, round, mi, mj, s / sum(n) OVER (PARTITION BY grp, round) AS s, n / sum(n) OVER (PARTITION BY grp, round) AS n FROM pairs),
in_round AS (SELECT DISTINCT grp, round, mi AS model FROM pairs),
cells_r AS (SELECT i.grp, i.round, i.model AS mi, j.model AS mj, coalesce(p.s, 0) AS s, coalesce(p.n, 0) AS n FROM in_round i JOIN in_round j ON i.grp = j.grp AND i.round = j.round
  LEFT JOIN pair_share p ON p.grp = i.grp AND p.round = i.round AND p.mi = i.model AND p.mj = j.model),
lines_r AS (SELECT grp, round, mi, sum(s) AS s, sum(n) AS d, list(n ORDER BY mj) AS n FROM cells_r GROUP BY 1, 2, 3),
start AS (SELECT grp, round, list(mi ORDER BY mi) AS models, list(s ORDER BY mi) AS s, list(d ORDER BY mi) AS d, list(n ORDER BY mi) AS n, list(0e0 ORDER BY mi) AS th FROM lines_r GROUP BY 1, 2),
steps(step, grp, round, th) AS (
  SELECT 0, grp, round, th FROM start
  UNION ALL
  SELECT step + 1, grp, round, list_transform(range(1, len(steps.th) + 1), lambda i:
    steps.th[i] + (s[i] - list_sum(list_transform(range(1, len(steps.th) + 1), lambda j: n[i][j] / (1e0 + exp(steps.th[j] - steps.th[i])))) - 1e-6 * (steps.th[i] - list_avg(steps.th))) / (d[i] / 2 + 1e-6))
  FROM steps JOIN start USING (grp, round) WHERE step < {STEPS}),
rated AS (SELECT grp, unnest(models) AS model, unnest(list_transform(steps.th, lambda t: (t - list_avg(steps.th)) * 400 / ln(10e0))) AS rating
  FROM steps JOIN start USING (grp, round) WHERE step = {STEPS}),
points AS (SELECT grp, model, quantile_cont(rating, 5e-1) AS mid, quantile_cont(rating, 25e-3) AS low, quantile_cont(rating, 975e-3) AS high FROM rated GROUP BY 1, 2),
elo AS (SELECT p.grp, p.model, p.mid - z.mid + 1000 AS elo, p.high - p.mid AS elo_plus, p.mid - p.low AS elo_minus
  FROM points p JOIN points z ON z.grp = p.grp AND z.model = '{REFERENCE}')"""


ELO_COLUMNS = f"model, {r('elo', 3)} AS elo, {r('elo_plus', 3)} AS elo_plus, {r('elo_minus', 3)} AS elo_minus"


@query("elo", "WITH RECURSIVE" + RESULTS + ", src AS (SELECT 'all' AS grp, * FROM results)" + draws("src") + ratings("src") + f"SELECT {ELO_COLUMNS} FROM elo")
def _(spark, sf):
    return rounded(elo_ops.elo(results(spark, sf), reference_model=REFERENCE), 3)


@query("elo_learnable_draw", "WITH RECURSIVE" + RESULTS + """,
src AS (SELECT 'all' AS grp, dataset, fold, model, CASE WHEN task = 'regression' THEN metric_error ELSE 0 END AS metric_error FROM results)""" + draws("src") + ratings("src") + f"SELECT {ELO_COLUMNS} FROM elo")
def _(spark, sf):
    rows = results(spark, sf).withColumn("learnable", (F.col("task") == "regression") & (F.col("model") != "M0"))
    return rounded(elo_ops.elo(elo_ops.learnable_draw(rows), reference_model=REFERENCE), 3)


@query("learnable_draw", "WITH" + RESULTS + f"SELECT dataset, model, fold, {r("CASE WHEN task = 'regression' THEN metric_error ELSE 0 END")} AS metric_error FROM results")
def _(spark, sf):
    rows = results(spark, sf).withColumn("learnable", (F.col("task") == "regression") & (F.col("model") != "M0"))
    return rounded(elo_ops.learnable_draw(rows).select("dataset", "model", "fold", "metric_error"))


def group_board_sql(where: str) -> str:
    """The boards of all groups in SQL: rows of each group filled on their own, then every column of the board. Models of one
    group alone join the board of all tasks with their own columns and a rating among all."""
    grouped = f""",
gap_rows AS (SELECT * FROM gaps WHERE {where}),
whole AS (SELECT model FROM gap_rows GROUP BY 1 HAVING count(DISTINCT task) = (SELECT count(DISTINCT task) FROM gap_rows)),
g AS (SELECT task AS grp, * FROM gap_rows UNION ALL SELECT 'all', * FROM gap_rows SEMI JOIN whole USING (model)),
cells AS (SELECT * FROM g WHERE model = '{REFERENCE}'),
present AS (SELECT g.* FROM g SEMI JOIN cells c ON c.grp = g.grp AND c.dataset = g.dataset AND c.fold = g.fold),
kept AS (SELECT p.grp, p.model FROM (SELECT grp, model, count(*) AS n FROM present GROUP BY 1, 2) p JOIN (SELECT grp, count(*) AS n FROM cells GROUP BY 1) c USING (grp) WHERE (c.n - p.n) * 1e2 / c.n <= 50),
filled AS (SELECT c.grp, c.dataset, c.fold, k.model, c.num_instances, coalesce(p.metric_error, c.metric_error) AS metric_error, p.time_train_s, p.time_infer_s, p.model IS NULL AS imputed
  FROM cells c JOIN kept k USING (grp) LEFT JOIN present p ON p.grp = c.grp AND p.dataset = c.dataset AND p.fold = c.fold AND p.model = k.model),
t AS (SELECT grp, dataset, model, avg(metric_error) AS e FROM filled GROUP BY 1, 2, 3),
st AS (SELECT grp, dataset, min(e) AS best, median(e) AS med FROM t GROUP BY 1, 2),
scored AS (SELECT grp, dataset, model, CASE WHEN med - best > 1e-12 THEN greatest((med - e) / (med - best), 0e0) ELSE CAST(e <= med AS INTEGER) END AS score,
  rank() OVER (PARTITION BY grp, dataset ORDER BY e) + (count(*) OVER (PARTITION BY grp, dataset, e) - 1) / 2e0 AS rank,
  CASE WHEN e = 0 THEN 0e0 ELSE (1 - best / e) * 100 END AS imp FROM t JOIN st USING (grp, dataset)),
wins AS (SELECT grp, model, avg(rate) AS winrate FROM (SELECT a.grp, a.model, b.model AS other, avg(CASE WHEN a.e < b.e THEN 1e0 WHEN a.e = b.e THEN 5e-1 ELSE 0e0 END) AS rate
  FROM t a JOIN t b ON a.grp = b.grp AND a.dataset = b.dataset AND a.model <> b.model GROUP BY 1, 2, 3) GROUP BY 1, 2),
times AS (SELECT grp, model, median(time_train_s) AS median_time_train_s, median(time_infer_s) AS median_time_infer_s, median(time_train_s + time_infer_s) AS median_time_total_s,
  median(time_infer_s / (num_instances / 3e0) * 1000) AS median_infer_per_1k_s, median((time_train_s + time_infer_s) / num_instances * 1000) AS median_time_total_per_1k_s
  FROM filled WHERE NOT imputed GROUP BY 1, 2),
pct AS (SELECT grp, model, avg(CAST(imputed AS INTEGER)) * 100 AS imputed_pct FROM filled GROUP BY 1, 2)""" + draws("filled") + f""",
boot AS (SELECT grp, model, list_sort(list(m)) AS q FROM (SELECT grp, model, round, sum(imp * w) / sum(w) AS m FROM scored JOIN draws USING (dataset) GROUP BY 1, 2, 3 HAVING sum(w) > 0) GROUP BY 1, 2),
base_board AS (SELECT grp, model, avg(score) AS normalized_score, avg(rank) AS rank, avg(imp) AS improvability, count(*) AS n_tasks FROM scored GROUP BY 1, 2),
part_board AS (SELECT *, greatest(q[least(CAST(floor(len(q) * 975e-3) AS BIGINT) + 1, len(q))] - improvability, 0e0) AS improvability_plus,
  greatest(improvability - q[least(CAST(floor(len(q) * 25e-3) AS BIGINT) + 1, len(q))], 0e0) AS improvability_minus
  FROM base_board JOIN boot USING (grp, model) JOIN wins USING (grp, model) LEFT JOIN times USING (grp, model) JOIN pct USING (grp, model)),
added AS (SELECT * FROM part_board p WHERE grp <> 'all' AND NOT EXISTS (SELECT 1 FROM part_board w WHERE w.grp = 'all' AND w.model = p.model)),
src AS (SELECT grp, dataset, fold, model, metric_error FROM filled UNION ALL SELECT 'all', dataset, fold, model, metric_error FROM filled SEMI JOIN added USING (grp, model))""" + ratings("src") + """,
all_boards AS (SELECT grp AS evaluated_on, * FROM part_board UNION ALL SELECT grp, * REPLACE ('all' AS grp) FROM added)"""
    values = ["elo", "elo_plus", "elo_minus", "normalized_score", "rank", "improvability", "improvability_plus", "improvability_minus", "winrate",
              "median_time_train_s", "median_time_infer_s", "median_time_total_s", "median_infer_per_1k_s", "median_time_total_per_1k_s", "imputed_pct"]
    return "WITH RECURSIVE" + RESULTS_WITH_GAPS + grouped + f"""
SELECT grp AS "group", evaluated_on, model, false AS is_reference, n_tasks, {', '.join(f'{r(v, 3)} AS {v}' for v in values)} FROM all_boards JOIN elo USING (grp, model)"""


@query("compare_ratings", "WITH RECURSIVE" + IMPUTED + ", src AS (SELECT 'all' AS grp, dataset, fold, model, metric_error FROM imputed)" + draws("src") + ratings("src") + f"""
SELECT model IN ('M1', 'M5') AS own, {ELO_COLUMNS} FROM elo""")
def _(spark, sf):
    rows = results_with_gaps(spark, sf)
    mine = F.col("model").isin("M1", "M5")
    spec = protocol(spark, sf).withColumn("task", F.col("dataset"))
    board = compare(rows.where(mine), rows.where(~mine), spec, reference_model=REFERENCE).board
    return rounded(board.select("own", "model", "elo", "elo_plus", "elo_minus"), 3)


@query("score_group", "SELECT * EXCLUDE (\"group\") FROM (" + group_board_sql("task = 'regression'") + ") WHERE \"group\" = 'regression'")
def _(spark, sf):
    board, _ = rk.score_group(results_with_gaps(spark, sf), "regression", reference_model=REFERENCE)
    return rounded(board, 3)


@query("score_all", group_board_sql("NOT (model = 'M8' AND task = 'regression')"))
def _(spark, sf):
    rows = results_with_gaps(spark, sf).where(~((F.col("model") == "M8") & (F.col("task") == "regression")))
    return rounded(rk.score_all(rows, reference_model=REFERENCE), 3)


@query("score_all_groups", "WITH" + RESULTS + """
SELECT 'all' AS "group", CASE model WHEN 'M8' THEN 'classification' ELSE 'all' END AS evaluated_on, count(DISTINCT dataset) AS n_tasks, model FROM results
  WHERE NOT (model = 'M8' AND task = 'regression') GROUP BY model
UNION ALL SELECT task, task, count(DISTINCT dataset), model FROM results WHERE NOT (model = 'M8' AND task = 'regression') GROUP BY task, model""")
def _(spark, sf):
    rows = results(spark, sf).where(~((F.col("model") == "M8") & (F.col("task") == "regression")))
    return rk.score_all(rows, reference_model=REFERENCE).select("group", "evaluated_on", "n_tasks", "model")


def board(spark, sf):
    """A model table with ratings, times, release dates and categories derived from the results."""
    c = F.col
    k = F.substring("model", 2, 5).cast("int")
    agg = results(spark, sf).groupBy("model").agg(
        F.round(F.avg("metric_error") * 20000 + nudge6(), 0).alias("elo"), F.round(F.sum("time_train_s"), 4).alias("seconds"))
    return agg.select("model", "elo", "seconds", F.when(k != 9, 2015.0 + F.floor(k / 2)).alias("release_date"),
                      F.when(k % 3 == 0, "Tree-based").when(k % 3 == 1, "Deep Learning").otherwise("Traditional ML").alias("category"),
                      (k == 11).alias("is_reference"), c("elo").alias("score"))


def nudge6() -> float:
    return 0.0314159265


BOARD_TABLES = f""",
b0 AS (SELECT model, round(avg(metric_error) * 20000 + {nudge6()!r}, 0) AS elo, round(sum(time_train_s), 4) AS seconds, CAST(substr(model, 2) AS INTEGER) AS k FROM results GROUP BY 1),
board AS (SELECT model, elo, seconds, CASE WHEN k <> 9 THEN 2015e0 + k // 2 END AS release_date,
  CASE k % 3 WHEN 0 THEN 'Tree-based' WHEN 1 THEN 'Deep Learning' ELSE 'Traditional ML' END AS category, k = 11 AS is_reference FROM b0)"""
BOARD = RESULTS + BOARD_TABLES

query("split_references", "WITH" + BOARD + "SELECT model, elo FROM board WHERE NOT is_reference")(
    lambda spark, sf: rk.split_references(board(spark, sf))[0].select("model", "elo"))
query("by_release", "WITH" + BOARD + "SELECT model, release_date, CAST(row_number() OVER (ORDER BY release_date, elo DESC, model) AS INTEGER) AS position FROM board WHERE NOT is_reference AND release_date IS NOT NULL")(
    lambda spark, sf: rk.by_release(board(spark, sf)).select("model", "release_date", "position"))
query("record_holders", "WITH" + BOARD + """, o AS (SELECT *, row_number() OVER (ORDER BY release_date, elo DESC, model) AS p FROM board WHERE NOT is_reference AND release_date IS NOT NULL)
SELECT model, elo FROM o WHERE elo > coalesce((SELECT max(elo) FROM o b WHERE b.p < o.p), -1)""")(
    lambda spark, sf: rk.record_holders(board(spark, sf)).select("model", "elo"))
query("select_focus", "WITH" + BOARD + """, o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY elo DESC, model) AS p FROM board WHERE NOT is_reference)
SELECT model FROM o WHERE p <= 2 OR model = 'M10'""")(
    lambda spark, sf: rk.select_focus(board(spark, sf), 2, ["M10", "M11"]))
query("pareto_front", "WITH" + BOARD + "SELECT model, seconds, elo FROM board b WHERE NOT EXISTS (SELECT 1 FROM board c WHERE c.seconds < b.seconds AND c.elo >= b.elo)")(
    lambda spark, sf: rk.pareto_front(board(spark, sf), "seconds", "elo").select("model", "seconds", "elo"))
query("near_pareto", "WITH" + BOARD + ", g AS (SELECT model, (SELECT max(elo) FROM board c WHERE c.seconds <= b.seconds) - elo AS gap FROM board b) SELECT * FROM g WHERE gap <= 20")(
    lambda spark, sf: rk.near_pareto(board(spark, sf), "seconds", "elo", tolerance=20.0).select("model", "gap"))


def offers(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("model"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("pieces"))


OFFERS = "offers AS (SELECT l_returnflag, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS model, l_extendedprice AS price, l_quantity AS pieces FROM lineitem)"
query("pareto_front_lines", "WITH " + OFFERS + """, o AS (SELECT *, max(pieces) OVER (ORDER BY price, pieces DESC, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM offers)
SELECT price, pieces FROM o WHERE best IS NULL OR pieces > best""")(
    lambda spark, sf: rk.pareto_front(offers(spark, sf), "price", "pieces").select("price", "pieces"))
query("near_pareto_lines", "WITH " + OFFERS + """, o AS (SELECT *, max(pieces) OVER (PARTITION BY l_returnflag ORDER BY price) - pieces AS gap FROM offers)
SELECT l_returnflag, model, gap FROM o WHERE gap <= 1""")(
    lambda spark, sf: rk.near_pareto(offers(spark, sf), "price", "pieces", 1.0, by=["l_returnflag"]).select("l_returnflag", "model", "gap"))


@query("pareto_selection", "WITH" + BOARD + """, g AS (SELECT b.*, CASE category WHEN 'Tree-based' THEN 'regression' ELSE 'classification' END AS grp FROM board b WHERE NOT is_reference)
SELECT DISTINCT model FROM g WHERE (SELECT max(elo) FROM g c WHERE c.grp = g.grp AND c.seconds <= g.seconds) - elo <= 20""")
def _(spark, sf):
    b = board(spark, sf).withColumn("group", F.when(F.col("category") == "Tree-based", "regression").otherwise("classification"))
    return rk.pareto_selection(b.unionByName(b.withColumn("group", F.lit("all"))), "seconds", "elo", 20.0)


@query("critical_difference")
def _(spark, sf):
    ranks, _, test = rk.critical_difference(results(spark, sf))
    return rounded(ranks.withColumn("cd", F.lit(test["cd"])).withColumn("pvalue", F.lit(test["pvalue"])), 6)


@query("friedman", "WITH" + FULL + f""",
k AS (SELECT count(DISTINCT model) AS k, count(DISTINCT dataset) AS n FROM t), m AS (SELECT model, avg(rank) AS mr FROM rk GROUP BY 1),
ti AS (SELECT sum(c * c * c - c) AS s FROM (SELECT dataset, e, count(*) * 1e0 AS c FROM t GROUP BY 1, 2)),
x AS (SELECT 12e0 * n / (k * (k + 1)) * (SELECT sum(mr * mr) FROM m) - 3e0 * n * (k + 1) AS chi, 1 - (SELECT s FROM ti) / (n * k * (k * k - 1e0)) AS corr FROM k)
SELECT model, {r('mr')} AS mean_rank, {r('chi / corr', 6)} AS chi2 FROM m, x""")
def _(spark, sf):
    mean, test = rk.friedman(results(spark, sf))
    return rounded(mean.withColumn("chi2", F.lit(test["chi2"])), chi2=6)


@query("significance_groups")
def _(spark, sf):
    return rk.critical_difference(results(spark, sf))[1]


# ---------------------------------------------------------------- the older board


def seeds(spark, sf):
    """Per-seed scores: folds are seeds, one model lacks a key."""
    return results(spark, sf).where(~((F.col("model") == "M2") & (F.col("dataset") == "Brand#3"))).select(
        F.col("fold").alias("seed"), F.col("dataset").alias("key"), "model", (1 - F.col("metric_error")).alias("f1_score"))


LEGACY = RESULTS + """,
sd AS (SELECT fold AS seed, dataset AS key, model, 1 - metric_error AS f1_score FROM results WHERE NOT (model = 'M2' AND dataset = 'Brand#3')),
a AS (SELECT model, key, avg(f1_score) AS e FROM sd GROUP BY 1, 2),
s AS (SELECT key, median(e) AS med, max(e) AS best FROM a GROUP BY 1 HAVING count(*) >= 2),
ls AS (SELECT model, key, CASE WHEN best > med THEN least(greatest((e - med) / (best - med), 0e0), 1e0) ELSE 0e0 END AS norm_score,
   CAST(rank() OVER (PARTITION BY key ORDER BY e DESC) AS DOUBLE) AS rank FROM a JOIN s USING (key)),
allp AS (SELECT m.model, k.key, coalesce(norm_score, 0e0) AS norm_score, coalesce(ls.rank, k.pen) AS rank FROM (SELECT DISTINCT model FROM ls) m
   CROSS JOIN (SELECT key, max(rank) + 1 AS pen FROM ls GROUP BY 1) k LEFT JOIN ls ON ls.model = m.model AND ls.key = k.key)"""

query("legacy_scores", "WITH" + LEGACY + f"SELECT model, key, {r('norm_score')} AS norm_score, rank FROM ls")(
    lambda spark, sf: rounded(rk.legacy_scores(seeds(spark, sf), "f1_score", True)))


def legacy(spark, sf):
    """Scores and ranks before display rounding, which two engines may take to different sides of a half."""
    return rk.legacy_leaderboard(rk.legacy_scores(seeds(spark, sf), "f1_score", True))


query("legacy_leaderboard", "WITH" + LEGACY + """
SELECT model AS model_id, round(avg(norm_score), 4) AS score, round(avg(rank), 1) AS avg_rank, round((1 - avg(norm_score)) * 100, 1) AS improvability FROM allp GROUP BY 1""")(legacy)
query("leaderboard_rank", "WITH" + LEGACY + """, lb AS (SELECT model AS model_id, round(avg(norm_score), 4) AS score FROM allp GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY score DESC, model_id) AS INTEGER) AS rank, model_id FROM lb""")(
    lambda spark, sf: rk.leaderboard_rank(legacy(spark, sf)).select("rank", "model_id"))


@query("add_results", "WITH" + LEGACY.replace("sd AS (", "sd0 AS (", 1).replace("a AS (SELECT model, key, avg", "sd AS (SELECT * FROM sd0 UNION ALL SELECT seed, key, 'NEW', f1_score + 1e-2 FROM sd0 WHERE model = 'M4'), a AS (SELECT model, key, avg", 1) +
       "SELECT model AS model_id, round(avg(norm_score), 4) AS score, round(avg(rank), 1) AS avg_rank, round((1 - avg(norm_score)) * 100, 1) AS improvability FROM allp GROUP BY 1")
def _(spark, sf):
    s = seeds(spark, sf)
    new = s.where(F.col("model") == "M4").withColumn("f1_score", F.col("f1_score") + 0.01).drop("model")
    return rk.add_results(s, "NEW", new, "f1_score", True)


@query("merge_meta", "WITH" + BOARD + "SELECT model AS model_id, CASE WHEN is_reference THEN model ELSE 'Model ' || model END AS display_name, CASE WHEN NOT is_reference THEN category END AS category FROM board")
def _(spark, sf):
    b = board(spark, sf)
    meta = b.where(~F.col("is_reference")).select(F.col("model").alias("model_id"), F.concat(F.lit("Model "), "model").alias("display_name"), "category")
    return rk.merge_meta(b.select(F.col("model").alias("model_id")), meta).select("model_id", "display_name", "category")


# ---------------------------------------------------------------- versions


def old_version(spark, sf):
    """An older version: other errors, one task type changed, two models missing."""
    c = F.col
    res = results(spark, sf).where(~c("model").isin("M10", "M11"))
    return res.withColumn("metric_error", c("time_infer_s") / c("time_train_s")).withColumn(
        "task", F.when(c("dataset") == "Brand#4", "regression").otherwise(c("task")))


def versions(spark, sf):
    return rp.load_version(old_version(spark, sf), exclude=()), rp.load_version(results(spark, sf), exclude=())


VERSIONS = RESULTS + """,
oldr AS (SELECT dataset, fold, model, time_infer_s / time_train_s AS metric_error, CASE dataset WHEN 'Brand#4' THEN 'regression' ELSE task END AS task, time_train_s, time_infer_s
  FROM results WHERE model NOT IN ('M10', 'M11')),
ov AS (SELECT task, dataset AS key, model, avg(-metric_error) AS score, stddev_samp(metric_error) AS sd, avg(time_train_s + time_infer_s) AS time FROM oldr GROUP BY 1, 2, 3),
nv AS (SELECT task, dataset AS key, model, avg(-metric_error) AS score, stddev_samp(metric_error) AS sd, avg(time_train_s + time_infer_s) AS time FROM results GROUP BY 1, 2, 3),
names AS (SELECT DISTINCT model, CASE CAST(substr(model, 2) AS INTEGER) % 4 WHEN 0 THEN 'FamA' WHEN 1 THEN 'FamB' ELSE 'Name ' || model END AS family,
  CASE CAST(substr(model, 2) AS INTEGER) % 3 WHEN 0 THEN 'Trees' WHEN 1 THEN 'Deep Learning' ELSE 'Traditional ML' END AS category FROM results),
ow AS (SELECT * FROM (SELECT key, min_by(model, (-score, model)) AS model FROM ov GROUP BY 1) JOIN names USING (model)),
nw AS (SELECT * FROM (SELECT key, min_by(model, (-score, model)) AS model FROM nv GROUP BY 1) JOIN names USING (model))"""

FAMILIES = ((r"^M(0|4|8)$", "FamA"), (r"^M(1|5|9)$", "FamB"))


def model_names(spark, sf):
    b = board(spark, sf)
    return b.select("model", F.concat(F.lit("Name "), "model").alias("display_name"), "category")


def won(spark, sf):
    o, n = versions(spark, sf)
    models = model_names(spark, sf)
    return tuple(names.with_names(rp.winners(v), models, FAMILIES) for v in (o, n))


query("load_version", "WITH" + VERSIONS + f"SELECT task, key, model, {r('score')} AS score, {r('sd')} AS sd, {r('time', 5)} AS time FROM nv")(
    lambda spark, sf: rounded(versions(spark, sf)[1], time=5))


@query("load_legacy_version", "WITH" + RESULTS + f"""
SELECT task, dataset || '__1' AS key, model, {r("avg(CASE task WHEN 'classification' THEN 1 - metric_error ELSE -metric_error END)")} AS score, {r("stddev_samp(metric_error)")} AS sd,
  CAST(NULL AS DOUBLE) AS time FROM results WHERE NOT (model = 'M1' AND fold = 0) GROUP BY 1, 2, 3""")
def _(spark, sf):
    res = results(spark, sf).select(F.concat("dataset", F.lit("_1")).alias("key"), "model", "task", "metric_error",
                                    ((F.col("model") == "M1") & (F.col("fold") == 0)).alias("imputed"))
    clf = res.where(F.col("task") == "classification").withColumn("f1_score", 1 - F.col("metric_error"))
    reg = res.where(F.col("task") == "regression").withColumn("rmse", F.col("metric_error"))
    return rounded(rp.load_legacy_version(clf, reg))


@query("shared_tasks", "WITH" + VERSIONS + "SELECT DISTINCT o.key, o.model FROM ov o JOIN nv n ON n.key = o.key AND n.task = o.task AND n.model = o.model")
def _(spark, sf):
    o, n = versions(spark, sf)
    keys, models = rp.shared(o, n)
    return rp.restrict(n, keys, models).select("key", "model")


query("winners", "WITH" + VERSIONS + "SELECT key, model, family, category FROM nw")(
    lambda spark, sf: won(spark, sf)[1].select("key", "model", "family", "category"))

query("wins_by_family", "WITH" + VERSIONS + f""",
a AS (SELECT category, family, count(*) AS w FROM ow GROUP BY 1, 2), b AS (SELECT category, family, count(*) AS w FROM nw GROUP BY 1, 2)
SELECT coalesce(a.category, b.category) AS category, coalesce(a.family, b.family) AS family, coalesce(a.w, 0) AS wins_old, coalesce(b.w, 0) AS wins_new,
  {r('coalesce(a.w, 0) * 1e2 / (SELECT count(*) FROM ow)')} AS share_old, {r('coalesce(b.w, 0) * 1e2 / (SELECT count(*) FROM nw)')} AS share_new,
  {r('coalesce(b.w, 0) * 1e2 / (SELECT count(*) FROM nw) - coalesce(a.w, 0) * 1e2 / (SELECT count(*) FROM ow)')} AS change
FROM a FULL JOIN b ON a.category = b.category AND a.family = b.family""")(lambda spark, sf: rounded(rp.wins_by_family(*won(spark, sf))))

query("winner_flow", "WITH" + VERSIONS + """,
u AS (SELECT key, 0 AS v, family, category FROM ow UNION ALL SELECT key, 1, family, category FROM nw),
tot AS (SELECT family, count(*) AS w, min_by(category, (v, category)) AS cat FROM u GROUP BY 1),
nd AS (SELECT key, v, CASE WHEN w >= 4 THEN u.family ELSE 'other ' || lower(cat) END AS node FROM u JOIN tot ON tot.family = u.family)
SELECT a.node AS old_family, b.node AS new_family, count(*) AS keys FROM nd a JOIN nd b ON a.key = b.key AND a.v = 0 AND b.v = 1 GROUP BY 1, 2""")(
    lambda spark, sf: rp.winner_flow(*[w.withColumn("category", F.col("category")) for w in won(spark, sf)], min_wins=4))

query("rank_changes", "WITH" + VERSIONS + BOARD_TABLES + """,
o AS (SELECT model, round(sum(time_infer_s), 1) AS elo FROM oldr GROUP BY 1), p AS (SELECT o.model, o.elo AS a, b.elo AS b FROM o JOIN board b ON b.model = o.model),
q AS (SELECT model, CAST(floor(rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2e0) AS INTEGER) AS old_rank,
  CAST(floor(rank() OVER (ORDER BY b DESC) + (count(*) OVER (PARTITION BY b) - 1) / 2e0) AS INTEGER) AS new_rank FROM p)
SELECT model, old_rank, new_rank, old_rank - new_rank AS gain FROM q""")(
    lambda spark, sf: rp.rank_changes(old_version(spark, sf).groupBy("model").agg(F.round(F.sum("time_infer_s"), 1).alias("elo")), board(spark, sf)))

query("progress_by_release", "WITH" + FULL + BOARD_TABLES + f""",
d AS (SELECT DISTINCT release_date AS d FROM board WHERE release_date IS NOT NULL),
best AS (SELECT d, dataset, min(e) AS b FROM d, t JOIN board USING (model) WHERE release_date <= d GROUP BY 1, 2),
tod AS (SELECT dataset, min(e) AS td FROM t JOIN board USING (model) WHERE release_date IS NOT NULL GROUP BY 1)
SELECT d AS release_date, CAST(count(*) FILTER (b < 95e-2 * base) AS BIGINT) AS tasks_beaten,
  {r('100e0 * sum(CASE WHEN b > 0 THEN greatest((b - td) / b, 0e0) ELSE 0e0 END) / (SELECT count(DISTINCT dataset) FROM t)', 6)} AS improvability
FROM best JOIN tod USING (dataset) JOIN (SELECT dataset, e AS base FROM t WHERE model = 'M4') USING (dataset) GROUP BY 1""")(
    lambda spark, sf: rounded(rp.progress_by_release(rk.per_task(results(spark, sf)), board(spark, sf), baseline="M4"), 6))


def domains(spark, sf, key="dataset"):
    number = F.substring("dataset", 7, 10).cast("int")
    return results(spark, sf).select("dataset").distinct().where(number != 5).select(
        F.col("dataset").alias(key), F.when(number % 3 == 0, "Medical").when(number % 3 == 1, "Chemical").otherwise("Materials").alias("domain"))


DOMAINS = """,
dom AS (SELECT DISTINCT dataset, CASE CAST(substr(dataset, 7) AS INTEGER) % 3 WHEN 0 THEN 'Medical' WHEN 1 THEN 'Chemical' ELSE 'Materials' END AS domain FROM results WHERE dataset <> 'Brand#5')"""
HEADROOM = RESULTS_WITH_DUMMY + DOMAINS + """,
t AS (SELECT dataset, model, avg(metric_error) AS e FROM dummied GROUP BY 1, 2),
h AS (SELECT t.dataset, coalesce(any_value(domain), '?') AS domain, min(e) FILTER (model <> 'DUMMY') / max(e) FILTER (model = 'DUMMY') AS headroom FROM t LEFT JOIN dom ON dom.dataset = t.dataset GROUP BY 1)"""


def headroom(spark, sf):
    return rp.headroom(rk.per_task(results_with_dummy(spark, sf)), domains(spark, sf))


query("headroom", "WITH" + HEADROOM + f"SELECT dataset, domain, {r('headroom')} AS headroom, headroom <= 5e-2 AS solved FROM h")(
    lambda spark, sf: rounded(headroom(spark, sf)))
query("headroom_by_domain", "WITH" + HEADROOM + f"SELECT domain, {r('median(headroom)')} AS median_headroom, count(*) FILTER (headroom <= 5e-2) AS solved, count(*) AS tasks FROM h GROUP BY 1")(
    lambda spark, sf: rounded(rp.headroom_by_domain(headroom(spark, sf))))


@query("winner_by_shape", "WITH" + VERSIONS + f""",
sz AS (SELECT p_brand AS key, count(*) AS n, sum(p_size) AS p FROM part GROUP BY 1)
SELECT CASE WHEN n < 80 THEN 'few' ELSE 'many' END AS spectra, CASE WHEN p < 2000 THEN 'narrow' ELSE 'wide' END AS channels, count(*) AS tasks,
  {r("1e2 * avg(CAST(category = 'Trees' AS INTEGER))")} AS share FROM nw JOIN sz USING (key) GROUP BY 1, 2""")
def _(spark, sf):
    sizes = table(spark, sf, "part").groupBy(F.col("p_brand").alias("key")).agg(F.count(F.lit(1)).alias("n_spectra"), F.sum("p_size").alias("n_features"))
    return rounded(rp.winner_by_shape(won(spark, sf)[1], sizes, "Trees", n=80, p=2000))


query("winner_by_domain", "WITH" + VERSIONS + DOMAINS + f""",
w AS (SELECT coalesce(domain, '?') AS domain, category FROM nw LEFT JOIN dom ON dom.dataset = nw.key),
c AS (SELECT domain, category, count(*) AS tasks FROM w GROUP BY 1, 2 UNION ALL SELECT 'All tasks', category, count(*) FROM w GROUP BY 2)
SELECT domain, category, tasks, {r('1e2 * tasks / sum(tasks) OVER (PARTITION BY domain)')} AS share FROM c""")(
    lambda spark, sf: rounded(rp.winner_by_domain(won(spark, sf)[1], domains(spark, sf, "key"))))

query("ties_within_noise", "WITH" + VERSIONS + f""",
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, model) AS i FROM nv),
w AS (SELECT key, score AS best, sd FROM o WHERE i = 1),
a AS (SELECT o.key, count(*) FILTER (i > 1 AND score >= best - w.sd) AS tied, bool_or(i = 2 AND score >= best - w.sd) AS runner_tied,
   (max(best) - max(score) FILTER (i = 2)) / greatest(-max(best), 1e-12) AS margin, max(w.sd) / greatest(-max(best), 1e-12) AS noise FROM o JOIN w ON w.key = o.key GROUP BY 1)
SELECT key, tied, runner_tied, {r('margin')} AS margin, {r('noise')} AS noise,
  CASE WHEN tied >= 20 THEN '20+' WHEN tied >= 10 THEN '10-19' WHEN tied >= 5 THEN '5-9' WHEN tied >= 3 THEN '3-4' ELSE CAST(tied AS VARCHAR) END AS bin FROM a""")(
    lambda spark, sf: rounded(rp.ties_within_noise(versions(spark, sf)[1])))

CHEAPEST = VERSIONS + """,
w AS (SELECT key, min_by(model, (-score, model)) AS winner, max(score) AS best, min_by(time, (-score, model)) AS winner_time FROM nv WHERE model <> 'M1' GROUP BY 1),
ch AS (SELECT w.key, any_value(winner) AS winner, any_value(winner_time) AS winner_time, min_by(model, (time, model)) AS cheapest, min(time) AS cheapest_time
  FROM nv JOIN w ON w.key = nv.key WHERE model <> 'M1' AND -score <= 105e-2 * -best GROUP BY 1)"""
query("cheapest_near_winner", "WITH" + CHEAPEST + f"SELECT key, winner, cheapest, {r('winner_time', 5)} AS winner_time, {r('cheapest_time', 5)} AS cheapest_time, {r('winner_time / cheapest_time', 6)} AS speed_up, winner = cheapest AS same FROM ch")(
    lambda spark, sf: rounded(rp.cheapest_near_winner(versions(spark, sf)[1], exclude=["M1"]), 5, speed_up=6))
query("cheapest_summary", "WITH" + CHEAPEST + f"SELECT count(*) FILTER (winner <> cheapest) AS cheaper, {r('median(winner_time / cheapest_time) FILTER (winner <> cheapest)', 6)} AS median_speed_up, {r('1e2 * avg(CAST(cheapest_time < 1 AS INTEGER))', 6)} AS share_fast FROM ch")(
    lambda spark, sf: rounded(rp.cheapest_summary(rp.cheapest_near_winner(versions(spark, sf)[1], exclude=["M1"]), fast=1.0), 6))
query("regret", "WITH" + FULL + f"SELECT model, {r('median(1 - score)')} AS median_regret, {r('avg(CAST(1 - score <= 5e-2 AS INTEGER))')} AS share_within FROM ns WHERE model IN ('M1', 'M2', 'M3') GROUP BY 1")(
    lambda spark, sf: rounded(rp.regret(results(spark, sf), ["M1", "M2", "M3"])))


@query("best_by_licence", "WITH" + BOARD + """,
n AS (SELECT model, elo FROM board ORDER BY elo DESC, model LIMIT 30)
SELECT CASE WHEN model = 'M1' THEN 'hosted' WHEN model IN ('M2', 'M3') THEN 'nc' ELSE 'open' END AS licence,
  min_by(model, (-elo, model)) AS model, max(elo) AS elo, count(*) AS models FROM n GROUP BY 1""")
def _(spark, sf):
    rows, name = board(spark, sf), F.col("model")
    models = rows.where(name.isin("M1", "M2", "M3")).select("model", F.when(name == "M1", "hosted").otherwise("nc").alias("licence"))
    return rp.best_by_licence(rows, models)


# ---------------------------------------------------------------- times and single models


def timed(spark, sf):
    c = F.col
    gpu = F.when(c("fold") == 0, "NVIDIA A100-SXM4-40GB").when((c("fold") == 1) & (c("model") != "M3"), "NVIDIA H100 PCIe")
    count = F.when(c("model") == "M4", 1).otherwise(0)
    return results(spark, sf).select(
        "dataset", F.lit(0).alias("target_idx"), F.lit(0).alias("repeat"), "fold", "model", rp.hardware_class(gpu, count).alias("hardware_class"),
        F.when(c("model") != "M6", c("time_train_s")).alias("time_train_s"), (c("time_infer_s") + 0.01).alias("time_infer_s"))


TIMED = RESULTS + """,
hw AS (SELECT dataset, fold, model, CASE WHEN fold = 0 THEN 'a100' WHEN fold = 1 AND model <> 'M3' THEN 'h100' WHEN model = 'M4' THEN 'unknown' ELSE 'cpu' END AS hardware_class,
  CASE WHEN model <> 'M6' THEN time_train_s END AS tr, time_infer_s + 1e-2 AS inf FROM results),
f AS (SELECT *, tr / min(tr) OVER w AS str, inf / min(inf) OVER w AS sinf, count(tr) OVER w AS ntr, count(inf) OVER w AS ninf FROM hw WHERE hardware_class <> 'unknown' WINDOW w AS (PARTITION BY dataset, fold, hardware_class))"""

query("model_speed", "WITH" + TIMED + f"""
SELECT model, hardware_class, count(tr) AS n_tasks_on_this_hw, count(tr) FILTER (ntr >= 2) AS n_comparable_tasks,
  {r('exp(avg(ln(str)) FILTER (ntr >= 2))', 6)} AS geo_mean_train_slowdown, {r('exp(avg(ln(sinf)) FILTER (ninf >= 2))', 6)} AS geo_mean_infer_slowdown,
  {r('list_sort(list(tr) FILTER (tr IS NOT NULL))[len(list(tr) FILTER (tr IS NOT NULL)) // 2 + 1]', 5)} AS median_train_s, {r('list_sort(list(inf))[len(list(inf)) // 2 + 1]', 5)} AS median_infer_s
FROM f GROUP BY 1, 2""")(lambda spark, sf: rounded(rp.model_speed(timed(spark, sf)), 6, median_train_s=5, median_infer_s=5))

query("time_per_100k", "WITH" + IMPUTED + f"SELECT model, {r('median((time_train_s + time_infer_s) / num_instances * 1000) * 100', 5)} AS median_time_total_per_100k_s FROM imputed WHERE NOT imputed GROUP BY 1")(
    lambda spark, sf: rounded(rp.time_per_100k(rk.median_times(rs.impute_missing(results_with_gaps(spark, sf), reference_model=REFERENCE))).select(
        "model", "median_time_total_per_100k_s"), 5))
query("performance_per_task", "WITH" + RESULTS + f"SELECT dataset, 'fold' || (fold % 2) AS method, {r('avg(metric_error)')} AS mean, {r('stddev_samp(metric_error)')} AS std, count(*) AS count FROM results WHERE ta_name = 'run-M2' GROUP BY 1, 2")(
    lambda spark, sf: rounded(rp.performance_per_task(results(spark, sf).withColumn("method", F.concat(F.lit("fold"), (F.col("fold") % 2).cast("string"))), "run-M2")))
query("pairwise_scatter", "WITH" + FULL + f"SELECT dataset, {r('a.e')} AS error_a, {r('b.e')} AS error_b, a.e < b.e AS a_lower FROM t a JOIN t b USING (dataset) WHERE a.model = 'M1' AND b.model = 'M2'")(
    lambda spark, sf: rounded(rp.pairwise_scatter(results(spark, sf), "M1", "M2")))
query("tasks_won", "WITH" + FULL + "SELECT model, count(*) AS tasks_won FROM (SELECT dataset, min_by(model, (e, model)) AS model FROM t GROUP BY 1) GROUP BY 1")(
    lambda spark, sf: rp.tasks_won(results(spark, sf)))
