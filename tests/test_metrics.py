"""Metrics on small known cases, degenerate folds, hot groups, validation and registration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.functions.metrics import METRICS, metric_names, register_metric, to_error, unregister_metric
from spectrafold.operators import fold_metrics as fm

KEYS = ["task"]


def clf(spark, rows):
    return spark.createDataFrame([("t", 0, "m", "binary", y, p) for y, p in rows],
                                 "task string, fold int, model string, problem_type string, y_true int, proba array<double>")


def reg(spark, rows):
    return spark.createDataFrame([("t", 0, "m", "regression", float(y), float(p)) for y, p in rows],
                                 "task string, fold int, model string, problem_type string, y_true double, y_pred double")


def test_binary(spark):
    r = fm.classification_metrics(clf(spark, [(1, [0.9]), (1, [0.4]), (0, [0.4]), (0, [0.1])]), KEYS).first()
    assert r["accuracy"] == 0.75 and r["balanced_accuracy"] == 0.75
    assert abs(r["roc_auc"] - 0.875) < 1e-12
    assert abs(r["mcc"] - 2 / math.sqrt(12)) < 1e-12 and abs(r["cohen_kappa"] - 0.5) < 1e-12
    assert abs(r["log_loss"] + np.mean(np.log([0.9, 0.4, 0.6, 0.9]))) < 1e-12
    assert abs(r["brier"] - 2 * np.mean([0.01, 0.36, 0.16, 0.01])) < 1e-12


def test_one_class_and_missing_class(spark):
    r = fm.classification_metrics(clf(spark, [(1, [0.9]), (1, [0.8])]), KEYS).first()
    assert r["roc_auc"] is None and r["mcc"] == 0 and r["cohen_kappa"] is None
    three = clf(spark, [(0, [0.5, 0.3, 0.2]), (1, [0.2, 0.5, 0.3])])
    assert fm.roc_auc(three, KEYS).first()["roc_auc"] is None


def test_log_loss_clips_at_float32_epsilon(spark):
    r = fm.classification_metrics(clf(spark, [(1, [0.0])]), KEYS).first()
    assert abs(r["log_loss"] - 23 * math.log(2)) < 1e-9
    assert abs(r["log_loss_renormalized"] - 52 * math.log(2)) < 1e-9


def test_two_columns_equal_one(spark):
    one = fm.classification_metrics(clf(spark, [(1, [0.9]), (0, [0.6]), (1, [0.3])]), KEYS).first()
    two = fm.classification_metrics(clf(spark, [(1, [0.1, 0.9]), (0, [0.4, 0.6]), (1, [0.7, 0.3])]), KEYS).first()
    assert all(abs((a or 0) - (b or 0)) < 1e-12 for a, b in zip(one[1:], two[1:]))


def test_zero_division_counts_as_zero(spark):
    rows = {r["label"]: r for r in fm.classification_report(spark.createDataFrame(
        [("t", 0, 1), ("t", 1, 1), ("t", 2, 1)], "task string, y_true int, y_pred int"), KEYS).collect()}
    assert rows[0]["precision"] == 0 and rows[0]["f1"] == 0 and abs(rows[1]["precision"] - 1 / 3) < 1e-12


def test_regression(spark):
    r = fm.regression_metrics(reg(spark, [(1, 1), (2, 3), (3, 2), (4, 4)]), KEYS).first()
    assert r["mse"] == 0.5 and r["mae"] == 0.5 and r["median_ae"] == 0.5 and r["max_error"] == 1
    assert abs(r["r2"] - 0.6) < 1e-12 and abs(r["spearman_r"] - 0.8) < 1e-12 and abs(r["pearson_r"] - 0.8) < 1e-12
    assert abs(r["rpd"] - np.std([1, 2, 3, 4], ddof=1) / math.sqrt(0.5)) < 1e-12
    assert abs(r["mape"] - 100 * (0.5 + 1 / 3) / 4) < 1e-9


def test_constant_targets(spark):
    r = fm.regression_metrics(reg(spark, [(0, 1), (0, 2)]), KEYS).first()
    assert r["r2"] == 0 and r["r2_guarded"] is None and r["pearson_r"] is None and r["spearman_r"] is None and r["mape"] == 0
    r = fm.regression_metrics(reg(spark, [(2, 2), (2, 2)]), KEYS).first()
    assert r["r2"] == 1 and r["explained_variance"] == 1 and r["rpd"] is None
    r = fm.regression_metrics(reg(spark, [(1000.0, 999), (1000.1, 1001)]), KEYS).first()
    assert r["r2_guarded"] is None and r["r2"] < 0


@pytest.mark.parametrize("seed", [0, 1])
def test_hot_groups_give_the_same_metrics(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 800)
    p = np.round(np.clip(0.5 + 0.2 * (2 * y - 1) + rng.normal(0, 0.3, 800), 0.01, 0.99), 2)
    b = clf(spark, [(int(a), [float(c)]) for a, c in zip(y, p)])
    assert abs(fm.roc_auc(b, KEYS, hot_rows=10).first()["roc_auc"] - fm.roc_auc(b, KEYS).first()["roc_auc"]) < 1e-12
    t = np.round(rng.normal(size=800), 1)
    r = reg(spark, zip(t, np.round(t + rng.normal(size=800), 1)))
    one, two = fm.regression_metrics(r, KEYS, hot_rows=10).first(), fm.regression_metrics(r, KEYS).first()
    assert all(a == b if isinstance(a, str) else abs(a - b) < 1e-9 for a, b in zip(one, two))


def test_fold_metrics_has_every_metric(spark):
    both = clf(spark, [(1, [0.9]), (0, [0.2])]).unionByName(
        reg(spark, [(1, 2), (3, 4)]).withColumn("task", F.lit("r")), allowMissingColumns=True)
    rows = {r["task"]: r for r in fm.fold_metrics(both).collect()}
    assert set(rows["t"].asDict()) == {"task", "fold", "model", *metric_names()}
    assert rows["t"]["rmse"] is None and rows["r"]["accuracy"] is None and rows["r"]["rmse"] == 1


def test_errors_for_ranking(spark):
    df = spark.createDataFrame([(0.8,), (0.0,)], "v double")
    assert [r[0] for r in df.select(to_error(F.col("v"), "accuracy")).collect()] == [pytest.approx(0.2), 1.0]
    assert [r[0] for r in df.select(to_error(F.col("v"), "rpd")).collect()] == [1.25, float("inf")]
    assert [r[0] for r in df.select(to_error(F.col("v"), "mae")).collect()] == [0.8, 0.0]


def test_registering(spark):
    register_metric("bias", "regression", False, lambda y, p: F.avg(p - y))
    try:
        assert "bias" in metric_names("regression")
        assert fm.registered_metrics(reg(spark, [(1, 2), (3, 5)]), "regression", KEYS).first()["bias"] == 1.5
    finally:
        unregister_metric("bias")
    for bad in (lambda: register_metric("rmse", "regression", False, None), lambda: unregister_metric("rmse"),
                lambda: register_metric("x", "nothing", False, None)):
        with pytest.raises(ValueError):
            bad()
    assert "bias" not in METRICS


def test_one_read_and_no_job_before_the_action(spark, tmp_path):
    rows = [("t", f, m, "regression", float(i), i + 0.5 * f, None) for i in range(20) for f in (0, 1) for m in "ab"]
    rows += [("u", 0, "a", "binary", float(i % 2), None, [0.3 + 0.02 * i]) for i in range(20)]
    spark.createDataFrame(rows, "task string, fold int, model string, problem_type string, y_true double, y_pred double, proba array<double>").write.parquet(f"{tmp_path}/p")
    source = spark.read.parquet(f"{tmp_path}/p")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.sparkContext.setJobGroup("plan", "while the plan is made")
    try:
        out = fm.fold_metrics(source)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
    assert out.count() == 5


def test_rows_of_hot_keys_are_summed_in_ranges(spark, rng):
    from collections import defaultdict

    from spectrafold.operators.ordering import ordered
    rows = [("h", float(v), int(w)) for v, w in zip(rng.integers(0, 60, 400), rng.integers(1, 4, 400))] + [("c", 1.0, 2), ("c", 1.0, 5), ("c", 0.5, 1)]
    frame = spark.createDataFrame(rows, "k string, v double, w int")
    got = ordered(frame, ["k"], {"v": "v"}, ["w"], also={"total": F.sum("w")}, hot_rows=25).collect()
    sums = defaultdict(int)
    for k, v, w in rows:
        sums[k, v] += w
    for r in got:
        assert (r.v_w_before, r.v_w_ties) == (sum(n for (k, v), n in sums.items() if k == r.k and v < r.v), sums[r.k, r.v])
        assert r.total == sum(n for (k, _), n in sums.items() if k == r.k)
    assert len(got) == len(rows)
