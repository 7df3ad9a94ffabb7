"""Queries: metrics per fold, estimators, ensembles, streaming."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry.views import (
    BINARY, MULTICLASS, REGRESSION, RESULTS, SPECTRA, binary_predictions, multiclass_predictions, r,
    regression_predictions, results, rounded, spectra, table,
)
from spectrafold.functions.metrics import metric_names, register_metric, unregister_metric
from spectrafold.functions.spectral import snv
from spectrafold.operators import estimators as est
from spectrafold.operators import wide
from spectrafold.operators import fold_metrics as fm
from spectrafold.operators.knn import cross_val_knn, nearest
from spectrafold.session import ensure_checkpoint_dir
from spectrafold.sources.sinks import summary
from spectrafold.streaming.metrics import append_new_files, latest, stream_fold_metrics, stream_scan_results

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def by_class(spark, sf):
    return multiclass_predictions(spark, sf).withColumn("y_pred", F.array_position("proba", F.array_max("proba")).cast("int") - 1)


# ---------------------------------------------------------------- classification in SQL

MULTI_LABELS = MULTICLASS + """,
labeled AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS h FROM multi)"""
BINARY_LABELS = BINARY + """,
labeled AS (SELECT *, CAST(p > 5e-1 AS INTEGER) AS h FROM clf)"""
LABEL_TABLES = """,
cm AS (SELECT task, fold, model, y, h, count(*) AS n FROM labeled GROUP BY ALL),
cls AS (SELECT task, fold, model, label, sum(tp) AS tp, sum(s) AS s, sum(p) AS p FROM (
    SELECT task, fold, model, y AS label, CASE WHEN y = h THEN n ELSE 0 END AS tp, n AS s, 0 AS p FROM cm
    UNION ALL SELECT task, fold, model, h, 0, 0, n FROM cm) GROUP BY ALL),
pr AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE tp * 1e0 / p END AS prec, CASE WHEN s = 0 THEN 0 ELSE tp * 1e0 / s END AS rec,
    2e0 * tp / (s + p) AS f1 FROM cls),
m AS (SELECT task, fold, model, CAST(sum(s) AS BIGINT) AS n_test, sum(tp) * 1e0 / sum(s) AS accuracy, avg(rec) FILTER (s > 0) AS balanced_accuracy,
    avg(prec) AS precision_macro, avg(rec) AS recall_macro, avg(f1) AS f1_macro, sum(prec * s) / sum(s) AS precision_weighted,
    sum(rec * s) / sum(s) AS recall_weighted, sum(f1 * s) / sum(s) AS f1_weighted,
    (sum(tp) * 1e0 * sum(s) - sum(s * p)) AS num, sqrt(sum(s) * 1e0 * sum(s) - sum(p * p)) * sqrt(sum(s) * 1e0 * sum(s) - sum(s * s)) AS den,
    sum(s * p) * 1e0 / (sum(s) * sum(s)) AS chance FROM pr GROUP BY 1, 2, 3),
lm AS (SELECT * EXCLUDE (num, den, chance), CASE WHEN den = 0 THEN 0 ELSE num / den END AS mcc,
    CASE WHEN chance = 1 THEN NULL ELSE (accuracy - chance) / (1 - chance) END AS cohen_kappa FROM m)"""
LABEL_COLUMNS = "task, fold, model, n_test, " + ", ".join(f"{r(c)} AS {c}" for c in fm.LABEL_METRICS)

BINARY_AUC = """,
ranked AS (SELECT task, fold, model, y, rank() OVER (PARTITION BY task, fold, model ORDER BY p) + (count(*) OVER (PARTITION BY task, fold, model, p) - 1) / 2e0 AS rk FROM clf),
auc AS (SELECT task, fold, model, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0
    THEN (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * 1e0 * sum(1 - y)) END AS roc_auc FROM ranked GROUP BY 1, 2, 3)"""
BINARY_LOSS = """,
loss AS (SELECT task, fold, model,
    avg(-ln(greatest(least(CASE y WHEN 1 THEN p ELSE 1 - p END, 1 - 2e0 ** -23), 2e0 ** -23))) AS log_loss,
    avg(2 * (p - y) * (p - y)) AS brier FROM clf GROUP BY 1, 2, 3)"""
MULTI_AUC = """,
scores AS (SELECT task, fold, model, k, CAST(y = k AS INTEGER) AS hit, CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END / (p0 + p1 + p2) AS s FROM multi, range(3) t(k)),
ranked AS (SELECT task, fold, model, k, hit, rank() OVER (PARTITION BY task, fold, model, k ORDER BY s) + (count(*) OVER (PARTITION BY task, fold, model, k, s) - 1) / 2e0 AS rk FROM scores),
per AS (SELECT task, fold, model, k, sum(hit) AS pos, CASE WHEN sum(hit) > 0 AND sum(1 - hit) > 0
    THEN (sum(rk) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2e0) / (sum(hit) * 1e0 * sum(1 - hit)) END AS a FROM ranked GROUP BY ALL),
auc AS (SELECT task, fold, model, CASE WHEN count(a) = 3 THEN avg(a) END AS roc_auc, CASE WHEN count(a) = 3 THEN sum(a * pos) / sum(pos) END AS auc_weighted FROM per GROUP BY 1, 2, 3)"""
MULTI_LOSS = """,
loss AS (SELECT task, fold, model,
    avg(-ln(greatest(least(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1 - 2e0 ** -23), 2e0 ** -23))) AS log_loss,
    avg((p0 - CAST(y = 0 AS INTEGER)) ** 2 + (p1 - CAST(y = 1 AS INTEGER)) ** 2 + (p2 - CAST(y = 2 AS INTEGER)) ** 2) AS brier FROM multi GROUP BY 1, 2, 3)"""

query("confusion", "WITH" + MULTI_LABELS + "SELECT task, fold, model, y AS y_true, h AS y_pred, count(*) AS n FROM labeled GROUP BY ALL")(
    lambda spark, sf: fm.confusion(by_class(spark, sf)))

query("confusion_normalized", "WITH" + MULTI_LABELS + f"""
SELECT task, y AS y_true, h AS y_pred, count(*) AS n, {r('count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY task, y)')} AS share FROM labeled GROUP BY 1, 2, 3""")(
    lambda spark, sf: rounded(fm.confusion(by_class(spark, sf), ["task"], "true")))

query("classification_report", "WITH" + MULTI_LABELS + LABEL_TABLES + f"""
SELECT task, fold, model, label, {r('prec')} AS precision, {r('rec')} AS recall, {r('f1')} AS f1, CAST(s AS BIGINT) AS support FROM pr""")(
    lambda spark, sf: rounded(fm.classification_report(by_class(spark, sf))))

query("label_metrics", "WITH" + MULTI_LABELS + LABEL_TABLES + f"SELECT {LABEL_COLUMNS} FROM lm")(
    lambda spark, sf: rounded(fm.label_metrics(fm.confusion(by_class(spark, sf)))))

query("roc_auc_binary", "WITH" + BINARY + BINARY_AUC + f"SELECT task, fold, model, {r('roc_auc')} AS roc_auc FROM auc")(
    lambda spark, sf: rounded(fm.roc_auc(binary_predictions(spark, sf))))

# A low threshold sends every group through the split, sampled path of a hot key.
query("roc_auc_hot", "WITH" + MULTICLASS + MULTI_AUC.replace("fold, model", "0 AS fold, 'all' AS model", 1).replace(
    "PARTITION BY task, fold, model", "PARTITION BY task") + f"SELECT task, {r('roc_auc')} AS roc_auc FROM auc")(
    lambda spark, sf: rounded(fm.roc_auc(multiclass_predictions(spark, sf), ["task"], hot_rows=300)))

query("classification_metrics_binary", "WITH" + BINARY_LABELS + LABEL_TABLES + BINARY_AUC + BINARY_LOSS + f"""
SELECT {LABEL_COLUMNS}, {r('roc_auc')} AS roc_auc, {r('log_loss')} AS log_loss, {r('brier')} AS brier
FROM lm JOIN auc USING (task, fold, model) JOIN loss USING (task, fold, model)""")(
    lambda spark, sf: rounded(fm.classification_metrics(binary_predictions(spark, sf)).drop("log_loss_renormalized")))

query("classification_metrics_multiclass", "WITH" + MULTI_LABELS + LABEL_TABLES + MULTI_AUC + MULTI_LOSS + f"""
SELECT {LABEL_COLUMNS}, {r('roc_auc')} AS roc_auc, {r('log_loss')} AS log_loss, {r('brier')} AS brier
FROM lm JOIN auc USING (task, fold, model) JOIN loss USING (task, fold, model)""")(
    lambda spark, sf: rounded(fm.classification_metrics(multiclass_predictions(spark, sf)).drop("log_loss_renormalized")))

# ---------------------------------------------------------------- regression in SQL

REG_TABLES = """,
e AS (SELECT *, y_true - y_pred AS e,
    rank() OVER (PARTITION BY task, fold, model ORDER BY y_true) + (count(*) OVER (PARTITION BY task, fold, model, y_true) - 1) / 2e0 AS ry,
    rank() OVER (PARTITION BY task, fold, model ORDER BY y_pred) + (count(*) OVER (PARTITION BY task, fold, model, y_pred) - 1) / 2e0 AS rp FROM reg),
g AS (SELECT task, fold, model, count(*) AS n_test, avg(e * e) AS mse, avg(abs(e)) AS mae, max(abs(e)) AS max_error, var_pop(y_true) AS vy,
    var_pop(e) AS ve, min(y_true) = max(y_true) AS flat, min(y_pred) = max(y_pred) AS pflat, covar_pop(y_true, y_pred) AS cov, var_pop(y_pred) AS vp,
    stddev_samp(y_true) AS sd, median(abs(e)) AS median_ae, coalesce(avg(abs(e / y_true)) FILTER (y_true <> 0) * 100, 0e0) AS mape,
    covar_pop(ry, rp) AS rcov, var_pop(ry) AS vry, var_pop(rp) AS vrp, avg(abs(y_true)) AS size FROM e GROUP BY 1, 2, 3),
rm AS (SELECT task, fold, model, n_test, mse, sqrt(mse) AS rmse, mae, max_error,
    CASE WHEN NOT flat THEN 1 - mse / vy WHEN mse = 0 THEN 1 ELSE 0 END AS r2,
    CASE WHEN NOT flat AND sqrt(vy) >= 1e-3 * size THEN 1 - mse / vy END AS r2_guarded,
    CASE WHEN NOT flat THEN 1 - ve / vy WHEN ve = 0 THEN 1 ELSE 0 END AS explained_variance,
    CASE WHEN NOT flat AND NOT pflat THEN cov / sqrt(vy * vp) END AS pearson_r, CASE WHEN mse > 0 THEN sd / sqrt(mse) END AS rpd, mape, median_ae,
    CASE WHEN NOT flat AND NOT pflat THEN rcov / sqrt(vry * vrp) END AS spearman_r FROM g)"""
REG_COLUMNS = ("mse", "rmse", "mae", "max_error", "r2", "r2_guarded", "explained_variance", "pearson_r", "rpd", "mape", "median_ae", "spearman_r")

query("regression_metrics", "WITH" + REGRESSION + REG_TABLES + "SELECT task, fold, model, n_test, " + ", ".join(
    f"{r(c)} AS {c}" for c in REG_COLUMNS) + " FROM rm")(
    lambda spark, sf: rounded(fm.regression_metrics(regression_predictions(spark, sf))))

HOT_REGRESSION = (REGRESSION + REG_TABLES).replace("task, fold, model", "task").replace("GROUP BY 1, 2, 3", "GROUP BY 1")
query("regression_metrics_hot", "WITH" + HOT_REGRESSION + f"SELECT task, {r('median_ae')} AS median_ae, {r('spearman_r')} AS spearman_r FROM rm")(
    lambda spark, sf: rounded(fm.regression_metrics(regression_predictions(spark, sf), ["task"], hot_rows=200).select("task", "median_ae", "spearman_r")))

CLF_NAMES, REG_NAMES = metric_names("classification"), metric_names("regression")


@query("fold_metrics", "WITH" + MULTI_LABELS + LABEL_TABLES + MULTI_AUC + MULTI_LOSS + ", " + REGRESSION.split(",\n", 1)[1].strip() + REG_TABLES.replace(
    "g AS (", "g_ AS (").replace("FROM g)", "FROM g_)") + """
SELECT task, fold, model, """ + ", ".join(f"{r(c)} AS {c}" for c in CLF_NAMES) + ", " + ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in REG_NAMES) + """
FROM lm JOIN auc USING (task, fold, model) JOIN loss USING (task, fold, model) WHERE CAST(substr(task, 7) AS INTEGER) % 4 = 0
UNION ALL SELECT task, fold, model, """ + ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in CLF_NAMES) + ", " + ", ".join(f"{r(c)} AS {c}" for c in REG_NAMES) + """
FROM rm WHERE CAST(substr(task, 7) AS INTEGER) % 4 <> 0""")
def _(spark, sf):
    number = F.substring("task", 7, 10).cast("int")
    clf = multiclass_predictions(spark, sf).where(number % 4 == 0).withColumn("y_true", F.col("y_true").cast("double"))
    reg = regression_predictions(spark, sf).where(number % 4 != 0)
    return rounded(fm.fold_metrics(clf.unionByName(reg, allowMissingColumns=True)),)


@query("compute_metrics_classification", "WITH" + MULTI_LABELS + LABEL_TABLES + MULTI_AUC + """,
rl AS (SELECT task, fold, model, avg(-ln(greatest(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END / (p0 + p1 + p2), 2e0 ** -52))) AS log_loss FROM multi GROUP BY 1, 2, 3)
SELECT task, fold, model, """ + ", ".join(f"{r(a)} AS {b}" for a, b in (
    ("accuracy", "accuracy"), ("precision_weighted", "precision"), ("recall_weighted", "recall"), ("f1_weighted", "f1_score"),
    ("balanced_accuracy", "balanced_accuracy"), ("cohen_kappa", "cohen_kappa"), ("mcc", "matthews_corrcoef"), ("auc_weighted", "roc_auc"),
    ("log_loss", "log_loss"))) + " FROM lm JOIN auc USING (task, fold, model) JOIN rl USING (task, fold, model)")
def _(spark, sf):
    return rounded(fm.compute_metrics(multiclass_predictions(spark, sf), "classification"))


@query("compute_metrics_regression", "WITH" + REGRESSION + REG_TABLES + "SELECT task, fold, model, " + ", ".join(
    f"{r(a)} AS {b}" for a, b in (("mse", "mse"), ("rmse", "rmse"), ("mae", "mae"), ("r2_guarded", "r2"), ("mape", "mape"),
                                   ("explained_variance", "explained_variance"), ("max_error", "max_error"), ("median_ae", "median_ae"))) + " FROM rm")
def _(spark, sf):
    return rounded(fm.compute_metrics(regression_predictions(spark, sf), "regression"),)


@query("compare_metrics", "WITH" + RESULTS + f"""
SELECT dataset, fold, min_by(model, (metric_error, model)) AS best_model, {r('min(metric_error)')} AS best_value,
  max_by(model, (metric_error, model)) AS worst_model, {r('max(metric_error)')} AS worst_value,
  string_agg(model, ',' ORDER BY metric_error, model) AS ranking, {r('avg(metric_error)')} AS mean, {r('stddev_pop(metric_error)')} AS std
FROM results GROUP BY 1, 2""")
def _(spark, sf):
    out = fm.compare_metrics(results(spark, sf), "metric_error", ["dataset", "fold"], higher_is_better=False)
    return rounded(out.withColumn("ranking", F.concat_ws(",", "ranking")))


@query("register_metric", "WITH" + REGRESSION + f"SELECT task, fold, model, {r('max(y_true - y_pred) - min(y_true - y_pred)')} AS error_range FROM reg GROUP BY 1, 2, 3")
def _(spark, sf):
    register_metric("error_range", "regression", False, lambda y, p: F.max(y - p) - F.min(y - p))
    try:
        return rounded(fm.registered_metrics(regression_predictions(spark, sf), "regression"))
    finally:
        unregister_metric("error_range")


@query("probability_warnings", "WITH" + MULTICLASS + f"SELECT task, {r('max(abs(p0 + p1 * 101e-2 + p2 - 1))')} AS max_deviation FROM multi GROUP BY 1")
def _(spark, sf):
    off = multiclass_predictions(spark, sf).withColumn("proba", F.transform("proba", lambda p, i: F.when(i == 1, p * 1.01).otherwise(p)))
    return rounded(fm.probability_warnings(off, ["task"]))


def event_predictions(spark, sf):
    """Events as predictions: one model per event type, ids shifted or fractional for some."""
    c = F.col
    return table(spark, sf, "events").select(
        F.lit(1).alias("seed"), F.concat(F.lit("k"), F.pmod("event_id", F.lit(4)).cast("string")).alias("key"), c("event_type").alias("model"),
        F.when((F.pmod("event_id", F.lit(4)) == 3) & (c("event_type") == "click"), c("event_id") + 100_000_000).otherwise(c("event_id")).alias("spectrum_id"),
        F.when(F.pmod("event_id", F.lit(4)) == 1, c("value")).otherwise(F.floor("value").cast("double")).alias("y_pred"), "event_type")


@query("validate_predictions", """WITH t AS (SELECT event_id % 4 AS k, event_type, count(*) AS n, bool_or(value <> floor(value)) AS frac FROM events GROUP BY 1, 2)
SELECT 1 AS seed, 'k' || k || event_type AS key, event_type AS model, n AS n_pred, n AS n_true, CASE WHEN k = 3 AND event_type = 'click' THEN 0 ELSE n END AS n_matched,
  CASE WHEN k = 3 AND event_type = 'click' THEN 'index_mismatch' WHEN k = 1 AND frac THEN 'continuous' WHEN k = 2 THEN 'labels_only' ELSE 'ok' END AS status FROM t""")
def _(spark, sf):
    pred = event_predictions(spark, sf).withColumn("key", F.concat("key", "event_type"))
    truth = table(spark, sf, "events").select(
        F.lit(1).alias("seed"), F.concat(F.lit("k"), F.pmod("event_id", F.lit(4)).cast("string"), "event_type").alias("key"),
        F.col("event_id").alias("spectrum_id"), F.pmod("event_id", F.lit(3)).alias("y_true"), F.lit("classification").alias("task_type"))
    classes = F.when(F.col("key").startswith("k2"), F.array(F.lit("0"), F.lit("9"))).when(F.col("key").startswith("k0"), F.array(F.lit("2"), F.lit("0"), F.lit("1")))
    return fm.validate_predictions(pred.withColumn("proba_classes", classes), truth)


@query("append_new_metrics", "WITH" + RESULTS + "SELECT dataset, model, fold, CASE WHEN fold < 2 THEN 'old' ELSE 'new' END AS origin FROM results")
def _(spark, sf):
    r_ = results(spark, sf).select("dataset", "model", "fold")
    old = r_.where(F.col("fold") < 2).withColumn("origin", F.lit("old"))
    return fm.append_new(old, r_.withColumn("origin", F.lit("new")), ["dataset", "model", "fold"])


@query("summary", "WITH" + RESULTS + f"SELECT dataset, model, {r('avg(metric_error)')} AS metric_error_mean, {r('stddev_samp(metric_error)')} AS metric_error_std FROM results GROUP BY 1, 2")
def _(spark, sf):
    return rounded(summary(results(spark, sf).select("dataset", "model", "metric_error", F.col("fold").alias("seed"))))


# ---------------------------------------------------------------- estimators


def folded(spark, sf, label: bool):
    rows = spectra(spark, sf).select("task", F.lit(0).alias("repeat"), "spectrum_id", F.pmod("spectrum_id", F.lit(3)).cast("int").alias("fold"),
                                     "intensities", "label", "y")
    return est.one_hot(rows) if label else est.numeric_target(rows)


@query("cross_val_dummy", "WITH" + SPECTRA + f""",
c AS (SELECT spectrum_id % 3 AS fold, label, count(*) AS n FROM x GROUP BY 1, 2), f AS (SELECT fold, sum(n) AS n FROM c GROUP BY 1),
p AS (SELECT a.label, f.fold, (SELECT sum(n) FROM c WHERE c.label = a.label AND c.fold <> f.fold) * 1e0 / (SELECT sum(n) FROM f g WHERE g.fold <> f.fold) AS share
  FROM (SELECT DISTINCT label FROM c) a, f)
SELECT spectrum_id, label AS class, {r('share')} AS share FROM x JOIN p ON 1 = 1 AND p.fold = spectrum_id % 3 WHERE 1 = 1""".replace("SELECT spectrum_id, label AS class", "SELECT spectrum_id, p.label AS class"))
def _(spark, sf):
    out = est.cross_val_dummy(folded(spark, sf, True))
    return rounded(out.select("spectrum_id", F.explode(F.arrays_zip("classes", "proba")).alias("z")).select(
        "spectrum_id", F.col("z.classes").alias("class"), F.col("z.proba").alias("share")))


def eliminated(name: str, source: str, size: int) -> str:
    """*source* (f, i, v: the rows of a square matrix with right sides behind) solved, a pivot in each step of the recursion."""
    return f"""{name} AS (SELECT f, i, v, 0 AS k FROM {source} UNION ALL
  SELECT f, i, CASE WHEN i = k THEN list_transform(v, lambda a: a / p[k + 1]) ELSE list_transform(v, lambda a, q: a - v[k + 1] / p[k + 1] * p[q]) END, k + 1
  FROM (SELECT *, first_value(v) OVER (PARTITION BY f ORDER BY CASE WHEN i = k THEN 0 ELSE 1 END) AS p FROM {name}) WHERE k < {size})"""


def linear_sql(coef: str, classify: bool, start: str | None = None) -> str:
    """Predictions by the tables *coef* names last: coef (f, i, o, b), on the centred cross products (xx, xy) of the other folds'
    rows; the intercept starts from the mean target, or from the column *start* of the table offsets (f, o)."""
    targets = ("SELECT spectrum_id, o, CAST(x.label = k.label AS INTEGER) * 1e0 AS t FROM x, (SELECT label, row_number() OVER (ORDER BY label) - 1 AS o FROM (SELECT DISTINCT label FROM x)) k"
               if classify else "SELECT spectrum_id, 0 AS o, y AS t FROM x")
    raw = "SELECT spectrum_id, o, sum(x * b) + any_value(b0) AS s FROM xl JOIN coef ON f = spectrum_id % 3 AND i = channel JOIN icept USING (f, o) GROUP BY 1, 2"
    last = (f"""SELECT CAST(spectrum_id % 3 AS INTEGER) AS fold, spectrum_id, label, CAST(o AS INTEGER) AS class, {r('e / sum(e) OVER (PARTITION BY spectrum_id)')} AS share
FROM (SELECT spectrum_id, o, exp(s - max(s) OVER (PARTITION BY spectrum_id)) AS e FROM raw) JOIN x USING (spectrum_id)"""
            if classify else f"SELECT CAST(spectrum_id % 3 AS INTEGER) AS fold, spectrum_id, {r('y')} AS y, {r('s')} AS y_pred FROM raw JOIN x USING (spectrum_id)")
    joined = "" if start is None else " JOIN offsets ON offsets.f = coef.f AND offsets.o = coef.o"
    return "WITH RECURSIVE" + SPECTRA + f""",
fs AS (SELECT f FROM range(3) t(f)), tgt AS ({targets}),
m AS (SELECT f, channel, avg(x) AS m FROM xl, fs WHERE spectrum_id % 3 <> f GROUP BY 1, 2),
tm AS (SELECT f, o, avg(t) AS tm, sum(t) AS tn, count(*) AS n FROM tgt, fs WHERE spectrum_id % 3 <> f GROUP BY 1, 2),
c AS (SELECT f, spectrum_id, channel, x - m AS x FROM xl JOIN m USING (channel) WHERE spectrum_id % 3 <> f),
xx AS (SELECT a.f, a.channel AS i, b.channel AS j, sum(a.x * b.x) AS v FROM c a JOIN c b USING (f, spectrum_id) GROUP BY 1, 2, 3),
xy AS (SELECT c.f, channel AS i, 64 + tgt.o AS j, sum(x * (t - tm)) AS v FROM c JOIN tgt USING (spectrum_id) JOIN tm ON tm.f = c.f AND tm.o = tgt.o GROUP BY 1, 2, 3),
{coef},
icept AS (SELECT coef.f, coef.o, any_value({start or "tm"}) - sum(m * b) AS b0 FROM coef JOIN m ON m.f = coef.f AND channel = i JOIN tm ON tm.f = coef.f AND tm.o = coef.o{joined} GROUP BY 1, 2),
raw AS ({raw})
{last}"""


def ridge_sql(classify: bool) -> str:
    return linear_sql(f"""
rows_ AS (SELECT f, i, list(v ORDER BY j) AS v FROM (SELECT f, i, j, v + CASE WHEN i = j THEN 1 ELSE 0 END AS v FROM xx UNION ALL SELECT * FROM xy) GROUP BY 1, 2),
{eliminated("g", "rows_", 64)},
coef AS (SELECT f, i, unnest(range(len(v) - 64)) AS o, unnest(v[65:]) AS b FROM g WHERE k = 64)""", classify)


def axes_sql(k: int, sweeps: int = 9) -> str:
    """The k leading principal axes, ax (f, a, i, w, value): the 64 rows of the cross products are turned pair by pair until all
    are at right angles (their lengths are then the sums of squares). A sweep has 63 rounds of 32 pairs whose numbers add up to
    the round's, modulo 63; the last row meets the one left alone. An axis has no sign of its own, so all must be read from one run."""
    alone, dot = "(k * 32) % 63", lambda a, b: f"list_dot_product({a}, {b})"
    turn = "(CASE WHEN zeta < 0 THEN -1 ELSE 1 END) / (abs(zeta) + sqrt(1 + zeta * zeta))"
    return f"""
turned AS (SELECT f, i, list(v ORDER BY j) AS v, 0 AS k FROM xx GROUP BY 1, 2 UNION ALL
  SELECT f, i, CASE WHEN t IS NULL THEN v WHEN i = pair THEN list_transform(v, lambda a, q: (a - t * vq[q]) / sqrt(1 + t * t))
    ELSE list_transform(v, lambda a, q: (a + t * vp[q]) / sqrt(1 + t * t)) END, k + 1
  FROM (SELECT *, CASE WHEN zeta IS NOT NULL THEN {turn} END AS t FROM (SELECT *, ({dot("vq", "vq")} - {dot("vp", "vp")}) / nullif(2 * {dot("vp", "vq")}, 0) AS zeta FROM (
    SELECT *, first_value(v) OVER (PARTITION BY f, pair ORDER BY i) AS vp, first_value(v) OVER (PARTITION BY f, pair ORDER BY i DESC) AS vq FROM (
      SELECT *, least(i, CASE WHEN i = 63 THEN {alone} WHEN i = {alone} THEN 63 ELSE (k % 63 - i + 63) % 63 END) AS pair FROM turned WHERE k < {63 * sweeps}))))),
long_ AS (SELECT f, v, sqrt({dot("v", "v")}) AS value FROM turned WHERE k = {63 * sweeps}),
axis AS MATERIALIZED (SELECT f, v, value, row_number() OVER (PARTITION BY f ORDER BY value DESC) AS a FROM long_),
ax AS (SELECT f, a - 1 AS a, unnest(range(64)) AS i, unnest(v) / value AS w, value FROM axis WHERE a <= {k})"""


def pcr_sql(k: int, classify: bool) -> str:
    return linear_sql(axes_sql(k) + """,
slope AS (SELECT ax.f, a, j - 64 AS o, sum(w * v) / any_value(value) AS s FROM ax JOIN xy USING (f, i) GROUP BY 1, 2, 3),
coef AS (SELECT f, ax.i, o, sum(w * s) AS b FROM ax JOIN slope USING (f, a) GROUP BY 1, 2, 3)""", classify)


def pca_lda_sql(k: int) -> str:
    return linear_sql(axes_sql(k) + f""",
centre AS (SELECT ax.f, a, j - 64 AS o, sum(w * v) / any_value(tn) AS s, any_value(tn) AS tn, any_value(n) AS n FROM ax JOIN xy USING (f, i) JOIN tm ON tm.f = ax.f AND tm.o = j - 64 GROUP BY 1, 2, 3),
within_ AS (SELECT p.f, p.a, q.a AS j, (CASE WHEN p.a = q.a THEN any_value(value) ELSE 0 END - sum(p.s * p.tn * q.s)) / (any_value(p.n) - count(*)) AS v
  FROM centre p JOIN centre q USING (f, o) JOIN axis ON axis.f = p.f AND axis.a = p.a + 1 GROUP BY 1, 2, 3),
pooled AS (SELECT f, a AS i, list(v ORDER BY j) AS v FROM (SELECT * FROM within_ UNION ALL SELECT f, a, {k} + o, s FROM centre) GROUP BY 1, 2),
{eliminated("solved", "pooled", k)},
way AS (SELECT f, i AS a, unnest(range(len(v) - {k})) AS o, unnest(v[{k + 1}:]) AS d FROM solved WHERE k = {k}),
coef AS (SELECT f, ax.i, o, sum(w * d) AS b FROM ax JOIN way USING (f, a) GROUP BY 1, 2, 3),
offsets AS (SELECT f, o, ln(any_value(tn) / any_value(n)) - 0.5 * sum(s * d) AS start FROM centre JOIN way USING (f, a, o) GROUP BY 1, 2)""", True, "start")


def pls_sql(k: int) -> str:
    """Partial least squares of one output, component by component, on the cross products of the other folds' rows."""
    tables, dot = [], lambda a, b: f"list_dot_product({a}, {b})"
    for i in range(k):
        r_ = "list_transform(v, lambda e: e / n)"
        for j in range(i):  # w without its part along the components before; p and w keep their meaning
            r_ = f"list_transform({r_}, lambda e, q: e - {dot(f'p{j}', 'list_transform(v, lambda g: g / n)')} * r{j}[q])"
        before = "".join(f", r{j}, p{j}, q{j}" for j in range(i))
        tables += [
            f"w{i} AS (SELECT f, xx, v, sqrt({dot('v', 'v')}) AS n{before} FROM c{i})",
            f"o{i} AS (SELECT f, xx, v{before}, {r_} AS r{i} FROM w{i})",
            f"t{i} AS (SELECT *, list_transform(xx, lambda row_: {dot('row_', f'r{i}')}) AS xr FROM o{i})",
            f"u{i} AS (SELECT *, {dot(f'r{i}', 'xr')} AS tt FROM t{i})",
            f"z{i} AS (SELECT f, xx, v, tt{before}, r{i}, list_transform(xr, lambda e: e / tt) AS p{i}, {dot('v', f'r{i}')} / tt AS q{i} FROM u{i})",
            f"c{i + 1} AS (SELECT f, xx, list_transform(v, lambda e, q: e - tt * p{i}[q] * q{i}) AS v{before}, r{i}, p{i}, q{i} FROM z{i})"]
    total = " + ".join(f"r{j}[q] * q{j}" for j in range(k))
    return "WITH" + SPECTRA + f""",
fs AS (SELECT f FROM range(3) t(f)),
m AS (SELECT f, channel, avg(x) AS m, stddev_samp(x) AS s FROM xl, fs WHERE spectrum_id % 3 <> f GROUP BY 1, 2),
tm AS (SELECT f, avg(y) AS tm, stddev_samp(y) AS ts FROM x, fs WHERE spectrum_id % 3 <> f GROUP BY 1),
c AS (SELECT f, spectrum_id, channel, (x - m) / s AS x FROM xl JOIN m USING (channel) WHERE spectrum_id % 3 <> f),
xx AS (SELECT a.f, a.channel AS i, list(v ORDER BY j) AS row_ FROM (SELECT a.f, a.channel, b.channel AS j, sum(a.x * b.x) AS v FROM c a JOIN c b USING (f, spectrum_id) GROUP BY 1, 2, 3) a GROUP BY 1, 2),
xy AS (SELECT c.f, channel AS i, sum(c.x * (y - tm) / ts) AS v FROM c JOIN x USING (spectrum_id) JOIN tm ON tm.f = c.f GROUP BY 1, 2),
c0 AS (SELECT f, list(row_ ORDER BY i) AS xx, list(v ORDER BY i) AS v FROM xx JOIN xy USING (f, i) GROUP BY 1),
{", ".join(tables)},
coef AS (SELECT f, unnest(range(64)) AS channel, unnest(list_transform(range(1, 65), lambda q: {total})) AS b FROM c{k}),
scaled AS (SELECT f, channel, m, b * ts / s AS b FROM coef JOIN m USING (f, channel) JOIN tm USING (f)),
icept AS (SELECT f, any_value(tm) - sum(m * b) AS b0 FROM scaled JOIN tm USING (f) GROUP BY 1)
SELECT CAST(spectrum_id % 3 AS INTEGER) AS fold, spectrum_id, {r('any_value(x.y)')} AS y, {r('sum(xl.x * b) + any_value(b0)')} AS y_pred
FROM xl JOIN x USING (spectrum_id) JOIN scaled ON f = spectrum_id % 3 AND scaled.channel = xl.channel JOIN icept USING (f) GROUP BY spectrum_id"""


def classified(name: str, solver, sql: str | None = None, predict=est.cross_val_linear):
    @query(name, sql)
    def _(spark, sf):
        out = predict(folded(spark, sf, True), solver, classify=True)
        return rounded(out.select("fold", "spectrum_id", "label", F.posexplode("proba").alias("class", "share")), 6)


def regressed(name: str, solver, sql: str | None = None, predict=est.cross_val_linear):
    @query(name, sql)
    def _(spark, sf):
        out = predict(folded(spark, sf, False), solver, classify=False)
        return rounded(out.select("fold", "spectrum_id", "y", "y_pred"), 6)


classified("ridge_classify", est.ridge(1.0), ridge_sql(True))
classified("pls_classify", est.pls(10))
classified("pcr_classify", est.pcr(20), pcr_sql(20, True))
classified("pca_lda", est.pca_lda(30), pca_lda_sql(30))
regressed("ridge", est.ridge(1.0), ridge_sql(False))
regressed("pls", est.pls(10), pls_sql(10))
regressed("pcr", est.pcr(20), pcr_sql(20, False))
regressed("ridge_wide", wide.ridge(1.0), ridge_sql(False), wide.cross_val_wide)
regressed("pls_wide", wide.pls(10), pls_sql(10), wide.cross_val_wide)
regressed("pcr_wide", wide.pcr(20), pcr_sql(20, False), wide.cross_val_wide)
classified("ridge_classify_wide", wide.ridge(1.0), ridge_sql(True), wide.cross_val_wide)
classified("pca_lda_wide", wide.pca_lda(30), pca_lda_sql(30), wide.cross_val_wide)

KNN = SPECTRA + f""",
s AS (SELECT spectrum_id, channel, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x FROM xl WINDOW w AS (PARTITION BY spectrum_id)),
sv AS (SELECT spectrum_id, list(x ORDER BY channel) AS v FROM s GROUP BY 1),
d AS (SELECT a.spectrum_id, b.spectrum_id AS neighbour, list_distance(a.v, b.v) AS distance FROM sv a JOIN sv b ON a.spectrum_id % 3 <> b.spectrum_id % 3),
nn AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY distance, neighbour) AS position FROM d)"""


@query("nearest_spectra", "WITH" + KNN + f"SELECT spectrum_id, neighbour, {r('distance', 6)} AS distance, CAST(position AS INTEGER) AS position FROM nn WHERE position <= 5")
def _(spark, sf):
    rows = folded(spark, sf, True).withColumn("intensities", snv("intensities"))
    return rounded(nearest(rows, 5, block_rows=64, pivots=8).select("spectrum_id", "neighbour", "distance", "position"), 6)


@query("cross_val_knn", "WITH" + KNN + f"""
SELECT q.spectrum_id, c.label AS class, {r('avg(CAST(n.label = c.label AS INTEGER))')} AS share
FROM nn q JOIN x n ON n.spectrum_id = q.neighbour, (SELECT DISTINCT label FROM x) c WHERE position <= 5 GROUP BY 1, 2""")
def _(spark, sf):
    rows = folded(spark, sf, True).withColumn("intensities", snv("intensities"))
    out = cross_val_knn(rows, 5)
    return rounded(out.select("spectrum_id", F.explode(F.arrays_zip("classes", "proba")).alias("z")).select(
        "spectrum_id", F.col("z.classes").alias("class"), F.col("z.proba").alias("share")))


@query("cross_validate", "WITH" + SPECTRA + f""",
m AS (SELECT f AS fold, avg(y) AS y_pred FROM x, range(3) t(f) WHERE spectrum_id % 3 <> f GROUP BY 1)
SELECT CAST(fold AS INTEGER) AS fold, spectrum_id, {r('y_pred')} AS y_pred, CAST(NULL AS VARCHAR) AS error FROM x JOIN m ON fold = spectrum_id % 3""")
def _(spark, sf):
    import numpy as np

    out = est.cross_validate(folded(spark, sf, False), fit=lambda x, y: float(np.mean(y)), predict=lambda m, x: np.full(len(x), m))
    return rounded(out.select("fold", "spectrum_id", "y_pred", "error"))


def as_components(spark, sf):
    """Three models' predictions of the same rows: the fold's rows seen through three distortions."""
    c = F.col
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("task"), F.pmod("event_id", F.lit(3)).cast("int").alias("fold"), c("event_id").alias("spectrum_id"),
        (c("value") > 20).cast("int").alias("y_true"), "value", F.explode(F.array(*[F.lit(m) for m in ("A", "B", "C")])).alias("model"))
    p = F.when(c("model") == "A", c("value") / (c("value") + 20)).when(c("model") == "B", c("value") / (c("value") + 35)).otherwise(F.lit(0.3))
    return rows.withColumn("proba", F.array(p)).drop("value")


@query("cawpe_ensemble", f"""WITH c AS (SELECT event_type AS task, CAST(event_id % 3 AS INTEGER) AS fold, event_id AS id, CAST(value > 20 AS INTEGER) AS y, m AS model,
   CASE m WHEN 'A' THEN value / (value + 20) WHEN 'B' THEN value / (value + 35) ELSE 3e-1 END AS p FROM events, (VALUES ('A'), ('B'), ('C')) t(m)),
w AS (SELECT task, fold, model, avg(CAST((p > 5e-1) = (y = 1) AS INTEGER)) ** 4 AS w FROM c WHERE id % 2 = 0 GROUP BY 1, 2, 3)
SELECT task, fold, id AS spectrum_id, y AS y_true, {r('sum(w * p) / sum(w * p + w * (1 - p))')} AS p1 FROM c JOIN w USING (task, fold, model) WHERE id % 2 = 1 GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    rows = as_components(spark, sf)
    even = F.col("spectrum_id") % 2 == 0
    out = est.cawpe_ensemble(rows.where(even), rows.where(~even), ["A", "B", "C"])
    return rounded(out.select("task", "fold", "spectrum_id", "y_true", F.col("proba")[1].alias("p1")))


@query("ensemble_times", "WITH" + RESULTS + f"SELECT dataset, fold, {r('sum(time_train_s)', 6)} AS time_train_s, {r('sum(time_infer_s)', 6)} AS time_infer_s FROM results WHERE model IN ('M1', 'M2', 'M3') GROUP BY 1, 2 HAVING count(DISTINCT model) = 3")
def _(spark, sf):
    return rounded(est.ensemble_times(results(spark, sf), ["M1", "M2", "M3"], ["dataset", "fold"]), 6)


# ---------------------------------------------------------------- streaming


def scratch(spark, name: str) -> str:
    """A fresh folder below the session's checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark, path, **options):
    raw = spark.readStream.schema(EVENT_SCHEMA).options(**options).parquet(path)
    return raw.select(
        F.concat(F.lit("u"), F.pmod("user_id", F.lit(5)).cast("string")).alias("task"), F.pmod("event_id", F.lit(3)).cast("int").alias("fold"),
        F.col("event_type").alias("model"), F.lit("regression").alias("problem_type"), F.col("event_id").alias("spectrum_id"),
        F.floor("value").cast("double").alias("y_true"), F.col("value").alias("y_pred"))


EVENT_REG = """
reg AS (SELECT 'u' || (user_id % 5) AS task, CAST(event_id % 3 AS INTEGER) AS fold, event_type AS model, event_id, floor(value) AS y_true, value AS y_pred FROM events)"""
EVENT_METRICS = f"SELECT task, fold, model, {r('sqrt(avg((y_true - y_pred) ** 2))')} AS rmse, {r('avg(abs(y_true - y_pred))')} AS mae, {r('median(abs(y_true - y_pred))')} AS median_ae FROM reg GROUP BY 1, 2, 3"


@query("stream_fold_metrics", "WITH" + EVENT_REG + EVENT_METRICS)
def _(spark, sf):
    sink = scratch(spark, "metrics")
    parts = scratch(spark, "events")  # the table in parts, a micro-batch each
    table(spark, sf, "events").repartition(3, "event_id").write.parquet(parts)
    stream = event_stream(spark, parts, maxFilesPerTrigger=1)
    stream_fold_metrics(stream, sink, scratch(spark, "state"), staging=scratch(spark, "staging")).awaitTermination()
    return rounded(latest(spark.read.parquet(sink)).select("task", "fold", "model", "rmse", "mae", "median_ae"))


@query("stream_fold_metrics_expected", "WITH" + EVENT_REG + EVENT_METRICS)
def _(spark, sf):
    events = table(spark, sf, "events")
    need = events.groupBy(
        F.concat(F.lit("u"), F.pmod("user_id", F.lit(5)).cast("string")).alias("task"), F.pmod("event_id", F.lit(3)).cast("int").alias("fold"),
        F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("n_expected"))
    sink = scratch(spark, "metrics")
    stream_fold_metrics(event_stream(spark, sf, pathGlobFilter="events.parquet"), sink, scratch(spark, "state"), staging=scratch(spark, "staging"), expected=need).awaitTermination()
    return rounded(spark.read.parquet(sink).select("task", "fold", "model", "rmse", "mae", "median_ae"))


@query("stream_scan_results", "SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY 1, 2")
def _(spark, sf):
    schema = T.StructType.fromDDL(EVENT_SCHEMA)
    stream = stream_scan_results(spark, sf, schema, pathGlobFilter="events.parquet")
    sink = scratch(spark, "scan")
    append_new_files(stream.select("event_type", "user_id"), sink, scratch(spark, "state"), ["event_type", "user_id"]).awaitTermination()
    return spark.read.parquet(sink).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


