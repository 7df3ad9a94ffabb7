"""Imputation, pair counts, ratings, significance and reports on small cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators import elo as elo_ops
from spectrafold.operators import ranking as rk
from spectrafold.operators import reports as rp
from spectrafold.operators import results as rs


def tidy(spark, cells):
    """cells: (dataset, fold, model, error)."""
    rows = [(d, f, m, float(e), "rmse", "regression", 1.0, 0.5, "run", 100) for d, f, m, e in cells]
    return spark.createDataFrame(rows, "dataset string, fold int, model string, metric_error double, metric string, task string, "
                                       "time_train_s double, time_infer_s double, ta_name string, num_instances long")


@pytest.fixture(scope="module")
def field(spark):
    """Ten tasks, two folds, four models of clearly different strength; D ran on two tasks only."""
    rng = np.random.default_rng(3)
    cells = [(f"d{t}", f, m, base + rng.normal(0, 0.2)) for t in range(10) for f in range(2)
             for m, base in (("RF", 1.0), ("A", 0.8), ("B", 1.3), ("D", 0.9)) if m != "D" or t < 2]
    return tidy(spark, cells).cache()


def test_imputation(field):
    got = rs.impute_missing(field).toPandas()
    assert set(got["model"]) == {"RF", "A", "B"} and not got["imputed"].any()  # D: 80 % missing
    got = rs.impute_missing(field, max_imputed_pct=90).toPandas()
    d = got[got["model"] == "D"]
    assert len(d) == 20 and d["imputed"].sum() == 16 and d.loc[d["imputed"], "time_train_s"].isna().all()
    rf = got[got["model"] == "RF"].set_index(["dataset", "fold"])["metric_error"]
    filled = d[d["imputed"]].set_index(["dataset", "fold"])["metric_error"]
    assert (filled == rf.loc[filled.index]).all()


def test_imputation_drops_cells_without_the_reference(field):
    got = rs.impute_missing(field.where("NOT (model = 'RF' AND dataset = 'd3')"))
    assert got.where("dataset = 'd3'").count() == 0


def test_pairs_in_small_tiles_equal_one_tile(field):
    cells = rk.as_cells(field.withColumnRenamed("metric_error", "error"), ["dataset", "fold"]).withColumn(
        "chunk", F.lit(0)).withColumn("weights", F.array(F.lit(1.0), F.lit(0.5)))
    key = lambda df: sorted((r["round"], r["model_i"], r["model_j"], round(r["score"], 9), round(r["n"], 9)) for r in df.collect())
    assert key(rk.pair_scores(cells, tile=2, budget=100)) == key(rk.pair_scores(cells))


def test_winrate_and_battles(spark):
    df = tidy(spark, [("a", 0, "x", 1), ("a", 0, "y", 2), ("b", 0, "x", 3), ("b", 0, "y", 3), ("c", 0, "x", 9)])
    m = {(r["model_i"], r["model_j"]): (r["winrate"], r["n_tasks"]) for r in rk.winrate_matrix(df).collect()}
    assert m == {("x", "y"): (0.75, 2), ("y", "x"): (0.25, 2)}
    assert rk.battles(df).collect()[0].asDict() == {"model_i": "x", "model_j": "y", "score_i": 1.5, "score_j": 0.5, "n_battles": 2}


def test_ratings_recover_known_strengths():
    theta = np.array([0.0, 0.7, -0.4])
    n = np.full((3, 3), 100.0)
    np.fill_diagonal(n, 0)
    score = n / (1 + np.exp(-(theta[:, None] - theta[None, :])))
    assert np.allclose(elo_ops.fit_ratings(score, n), theta - theta.mean(), atol=1e-4)
    won = np.array([[0.0, 5.0], [0.0, 0.0]])
    assert np.isfinite(elo_ops.fit_ratings(won, won + won.T)).all()


def test_elo(field):
    got = elo_ops.elo(field, rounds=40).toPandas().set_index("model")
    assert abs(got.loc["RF", "elo"] - 1000) < 1e-9
    assert got.loc["A", "elo"] > 1000 > got.loc["B", "elo"]
    assert (got["elo_plus"] >= 0).all() and (got["elo_minus"] >= 0).all()
    again = elo_ops.elo(field.repartition(5), rounds=40).toPandas().set_index("model")
    assert np.allclose(got["elo"].sort_index(), again["elo"].sort_index(), atol=1e-6)


def test_elo_without_battles_and_draws(spark):
    alone = tidy(spark, [("a", 0, "RF", 1), ("b", 0, "x", 1)])
    assert {r["elo"] for r in elo_ops.elo(alone, rounds=5).collect()} == {1000.0}
    df = tidy(spark, [(f"d{i}", 0, m, e) for i in range(6) for m, e in (("RF", 1), ("x", 2))]).withColumn("learnable", F.lit(False))
    assert all(abs(r["elo"] - 1000) < 1e-6 for r in elo_ops.elo(elo_ops.learnable_draw(df), rounds=10).collect())


def test_bootstrap_weights_have_mean_and_variance_one(spark):
    w = spark.range(400).select(F.explode(elo_ops.poisson_weights(F.col("id"), 50, 1)).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.05


def test_score_all_ranks_single_type_models(spark):
    rng = np.random.default_rng(0)
    rows = tidy(spark, [(f"d{t}", f, m, 1 + b + rng.normal(0, 0.1)) for t in range(6) for f in range(2)
                        for m, b in (("RF", 0.1), ("A", 0.0), ("S", 0.2)) if m != "S" or t < 3])
    rows = rows.withColumn("task", F.when(F.col("dataset") < "d3", "classification").otherwise("regression"))
    got = rk.score_all(rows, rounds=10).toPandas()
    top = got[got["group"] == "all"].set_index("model")
    assert top.loc["S", "evaluated_on"] == "classification" and top.loc["A", "evaluated_on"] == "all"
    assert top.loc["S", "n_tasks"] == 3 and top.loc["A", "n_tasks"] == 6
    assert set(got.loc[got["group"] == "regression", "model"]) == {"RF", "A"}
    assert got["median_time_total_s"].eq(1.5).all()
    assert (got["improvability_plus"] >= 0).all() and (got["improvability_minus"] >= 0).all() and got["improvability_plus"].max() > 0


# Published quantiles of the studentized range (5 %, infinite degrees of freedom).
@pytest.mark.parametrize("k,q", [(2, 2.772), (3, 3.314), (5, 3.858), (10, 4.474), (20, 5.012)])
def test_studentized_range(k, q):
    assert abs(rk.studentized_range_quantile(0.95, k) - q) < 2e-3


@pytest.mark.parametrize("x,df,p", [(3.841459, 1, 0.05), (18.307038, 10, 0.05), (2.558212, 10, 0.99), (29.588298, 10, 0.001)])
def test_chi2_tail(x, df, p):
    assert abs(rk.chi2_tail(x, df) / p - 1) < 1e-5


def test_critical_difference(field):
    ranks, groups, test = rk.critical_difference(field.where("model <> 'D'"))
    assert [r["model"] for r in ranks.orderBy("position").collect()][-1] == "B"
    assert test["tasks"] == 10 and test["pvalue"] < 0.05
    assert all(r["first"] < r["last"] for r in groups.collect())
    with pytest.raises(ValueError):
        rk.critical_difference(field.where("dataset < 'd3'"))


def test_fronts(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.4), ("c", 2.0, 0.7), ("d", 3.0, 0.7), ("e", 4.0, 0.9), ("f", 9.0, 0.85)],
                               "model string, t double, s double")
    assert sorted(r["model"] for r in rk.pareto_front(df, "t", "s").collect()) == ["a", "c", "e"]
    assert sorted(r["model"] for r in rk.near_pareto(df, "t", "s", 0.1).collect()) == ["a", "c", "d", "e", "f"]


def test_fronts_over_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(f"m{i:04d}", "gh"[i % 2], float(rng.integers(0, 900)), float(rng.integers(0, 40))) for i in range(3000)]
    df = spark.createDataFrame(rows + [("n", "g", None, 50.0), ("o", "h", 1.0, None)], "model string, g string, t double, s double").repartition(7)
    for by in ([], ["g"]):
        front, near = set(), set()
        for m, g, t, v in rows:
            peers = [(u, w, k) for k, h, u, w in rows if h == g or not by]
            if not any(u < t and w >= v or u == t and (-w, k) < (-v, m) for u, w, k in peers):
                front.add(m)
            if max(w for u, w, _ in peers if u <= t) - v <= 1:
                near.add(m)
        assert {r["model"] for r in rk.pareto_front(df, "t", "s", by=by).collect()} == front
        assert {r["model"] for r in rk.near_pareto(df, "t", "s", 1.0, by=by).collect()} == near
    assert rk.pareto_front(df.limit(0), "t", "s").isEmpty()


def test_ratings_in_groups_equal_ratings_of_each(spark, field):
    rows = field.withColumn("g", F.lit("x")).unionByName(field.where("dataset < 'd6' AND model <> 'D'").withColumn("g", F.lit("y")))
    got = {(r["g"], r["model"]): round(r["elo"], 6) for r in elo_ops.elo(rows, rounds=20, by=["g"]).collect()}
    alone = {(g, r["model"]): round(r["elo"], 6) for g in "xy" for r in elo_ops.elo(rows.where(F.col("g") == g), rounds=20).collect()}
    assert got == alone and len(got) == 7


def test_merging(field, spark):
    with pytest.raises(ValueError, match="already"):
        rs.merge_reference(field, field)
    with pytest.raises(ValueError, match="no reference"):
        rs.load_reference(field, ["nothing"])
    with pytest.raises(ValueError):
        rs.select_metric(field, regression="accuracy")
    with pytest.raises(ValueError, match="missing"):
        rs.load_own_results(field.drop("metric"), spark.createDataFrame([("d0", 2, 5)], "task string, n_folds int, num_instances long"))


def test_truth_tables_of_trivial_keys(spark):
    rows = [("p", 0, "x", 0.0), ("p", 1, "x", 0.0), ("p", 0, "y", 1.0), ("p", 1, "y", 1.0),
            ("q", 0, "x", 0.0), ("q", 1, "x", 0.1), ("q", 0, "y", 0.5), ("q", 1, "y", 0.5),
            ("t", 0, "x", 0.20001), ("t", 0, "y", 0.20002), ("t", 1, "x", 0.3), ("t", 1, "y", 0.3)]
    df = spark.createDataFrame([(*r, "binary") for r in rows], "dataset string, fold int, model string, metric_error double, problem_type string")
    assert {r["dataset"]: r["reason"] for r in rs.trivial_keys(df).collect()} == {"p": "perfect:x", "t": "tie:2"}
    mixed = df.withColumn("problem_type", F.when(F.col("fold") == 0, "binary").otherwise("regression"))
    assert "p" not in {r["dataset"] for r in rs.trivial_keys(mixed).collect()}
    assert rs.configured_keys(df, {"trivial_filter": {"enabled": False}}, "trivial_filter").count() == 0


def test_hardware_classes(spark):
    rows = [("NVIDIA A100-SXM4-40GB", 1), ("Apple MPS", 1), (None, 0), (None, None), ("", 1), ("RTX 4090", 1)]
    df = spark.createDataFrame(rows, "g string, n int")
    assert [r[0] for r in df.select(rp.hardware_class(F.col("g"), F.col("n"))).collect()] == [
        "a100", "apple-mps", "cpu", "unknown", "unknown", "rtx-4090"]


def test_compare_needs_its_reference_model(spark):
    from spectrafold.plans.compare import compare

    schema = "dataset string, fold int, model string, metric_error double, metric string, task string, time_train_s double, time_infer_s double, num_instances long"
    own = spark.createDataFrame([("a", 0, "mine", 0.1, "rmse", "regression", 1.0, 1.0, 10)], schema)
    ref = spark.createDataFrame([("a", 0, "other", 0.2, "rmse", "regression", 1.0, 1.0, 10)], schema)
    protocol = spark.createDataFrame([("a", "regression", 1, 10)], "task string, problem_type string, n_folds int, num_instances long")
    with pytest.raises(ValueError, match="no results to fill"):
        compare(own, ref, protocol, reference_model="RF")
    out = compare(own, ref, protocol, reference_model="other", ratings=False)
    assert {r.model: (r["rank"], r.own) for r in out.board.collect()} == {"mine": (1.0, True), "other": (2.0, False)}
    assert out.coverage.first().tasks_complete == 1 and out.outside.count() == 0


def test_score_all_groups_runs_with_default_rounds(spark, monkeypatch):
    import __spark_entry__ as entry
    from registry import ranking as registered

    seen, whole = {}, registered.rk.score_all
    monkeypatch.setattr(registered.rk, "score_all", lambda rows, **kwargs: seen.update(kwargs) or whole(rows, **kwargs))
    assert "group" in entry.queries()["score_all_groups"](spark, "/root/testdata/sf0.001").columns and "rounds" not in seen


def test_fronts_of_few_keys_are_not_exchanged_by_key(spark):
    """The rows of a key stay with the tasks that read them until they are cut into ranges."""
    rows = spark.range(4000).selectExpr("concat('g', id % 2) as g", "cast(id as string) as model", "cast(id * 37 % 4001 as double) as t", "cast(id % 91 as double) as s")
    near = rk.near_pareto(rows, "t", "s", 1.0, by=["g"])
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g#" in plan and "_range#" in plan
    assert len(re.findall(r"hashpartitioning\(g#\d+, \d+\)", plan)) == 1  # that of the ranges' best values
    data = sorted((r["t"], r["s"], r["g"]) for r in rows.collect())
    best, want = {}, 0
    for _, s, g in data:
        best[g] = max(best.get(g, s), s)
        want += best[g] - s <= 1.0
    assert near.count() == want
