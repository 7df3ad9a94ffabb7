"""Scans and sinks on files written by the test."""

import json

import pytest
from pyspark.sql import types as T

from spectrafold.sources import results, sinks, spectra


@pytest.fixture(scope="module")
def wide_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide") / "d.parquet")
    df = spark.createDataFrame([(7, 3.0, float("nan"), 1.0, "g1", 0.5, "x"), (8, 6.0, 5.0, 4.0, None, None, None)],
                               "id long, `1000.5` double, `900` double, `2e2` double, _group_id string, conc double, kind string")
    df.write.parquet(path)
    return path


def test_wide_tables(spark, wide_path):
    rows, axis = spectra.read_spectra(spark, wide_path, "d", id_column="id")
    assert axis.first()["wavenumbers"] == [200.0, 900.0, 1000.5]
    a, b = rows.orderBy("spectrum_id").collect()
    assert a["intensities"] == [1.0, None, 3.0] and b["intensities"] == [4.0, 5.0, 6.0]
    assert a["targets"] == {"conc": 0.5} and a["label"] == "x" and a["group_id"] == "g1" and b["label"] is None
    assert spectra.channel_count(spark, wide_path) == 3
    plan = spectra.read_columns(spark, wide_path, ["conc"])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<conc:double>" in plan


def test_channel_names():
    assert spectra.channel_value("412.5") == 412.5
    assert spectra.channel_value("nan") is None and spectra.channel_value("label") is None
    schema = T.StructType.fromDDL("`10` double, `9.5` double, y double")
    assert spectra.channel_columns(schema) == ["9.5", "10"] and spectra.target_columns(schema) == ["y"]


def test_task_types():
    text, number = (T.StructType.fromDDL(f"`1` double, y {t}") for t in ("string", "double"))
    assert spectra.infer_task_type(text) == "classification" and spectra.infer_task_type(number) == "regression"
    assert spectra.infer_task_type(number, "Classification") == "classification" and spectra.infer_task_type(text, 1) == "regression"
    with pytest.raises(ValueError):
        spectra.infer_task_type(T.StructType.fromDDL("`1` double"))


def test_predictions_from_paths(spark, tmp_path):
    for seed in (1, 2):
        folder = tmp_path / f"seed_{seed}" / "predictions"
        folder.mkdir(parents=True)
        (folder / "sugar_mix_0_MY_PLS_2_predictions.csv").write_text(",target\n5,1.5\n6,2.5\n")
        (folder / "acid_1_KNN_predictions.csv").write_text(",target,0,1\n5,1,0.25,0.75\n")
        (folder / "sugar_mix_0_ground_truth.csv").write_text(",target\n5,1\n6,2\n")
    got = results.read_predictions(spark, str(tmp_path)).orderBy("key", "seed", "spectrum_id").collect()
    assert [(r.key, r.model, r.seed) for r in got] == [("acid_1", "KNN", 1), ("acid_1", "KNN", 2)] + [("sugar_mix_0", "MY_PLS_2", s) for s in (1, 1, 2, 2)]
    assert got[0].proba == [0.25, 0.75] and got[0].proba_classes == ["0", "1"] and got[-1].proba is None and got[-1].prediction == 2.5
    truth = results.read_ground_truth(spark, str(tmp_path)).collect()
    assert sorted((r.seed, r.key, r.spectrum_id, r.y_true) for r in truth) == [(s, "sugar_mix_0", i, float(i - 4)) for s in (1, 2) for i in (5, 6)]


def test_registries(spark, tmp_path):
    path = tmp_path / "ex.json"
    path.write_text(json.dumps({"_comment": "text", "trivial": {"_criterion": "x", "a_0": {"why": "y"}}, "not_learnable": {"b_1": {}}, "note": "z"}))
    got = {tuple(r) for r in results.read_exclusions(spark, str(path)).collect()}
    assert got == {("a_0", "trivial"), ("b_1", "not_learnable")}
    path = tmp_path / "targets.json"
    path.write_text(json.dumps([{"dataset": "a", "target_idx": 0, "excluded": False, "num_instances": 5}, {"dataset": "a", "target_idx": 1, "excluded": True}]))
    assert results.read_target_list(spark, str(path)).where("excluded").count() == 1


def test_unreadable_results_are_skipped(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "model=a"))
    (tmp_path / "model=b").mkdir()
    (tmp_path / "model=b" / "part-0.parquet").write_bytes(b"not parquet")
    got = results.scan_results(spark, str(tmp_path), T.StructType.fromDDL("id long, model string"))
    assert got.count() == 3


def test_sinks(spark, tmp_path):
    folds = spark.createDataFrame([("t", "d", 0, "regression", 0, 5, 1)], "task string, dataset string, target_idx int, problem_type string, repeat int, spectrum_id long, fold int")
    for path in (str(tmp_path / "f.parquet"), str(tmp_path / "f.csv")):
        sinks.write_folds(folds, path)
    assert spark.read.parquet(str(tmp_path / "f.parquet")).schema["fold"].dataType == T.ByteType()
    assert spark.read.option("header", True).csv(str(tmp_path / "f.csv")).columns == sinks.FOLD_COLUMNS
    res = spark.createDataFrame([("b", 0, "m", 1.0), ("a", 1, "m", 2.0), ("a", 0, "m", 4.0)], "dataset string, fold int, model string, metric_error double")
    sinks.write_reference(res, str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    assert rows.count() == 3 and all("zstd" in f for f in rows.inputFiles())
    board = spark.createDataFrame([("all", "m", 1.0), ("regression", "m", 2.0)], "`group` string, model string, elo double")
    sinks.write_leaderboards(board, str(tmp_path / "lb"))
    assert sorted(p.name for p in (tmp_path / "lb").iterdir() if p.is_dir()) == ["group=all", "group=regression"]
    sinks.write_summary(res.withColumnRenamed("dataset", "key"), str(tmp_path / "s"))
    got = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert "metric_error_mean" in got.columns and "metric_error_std" in got.columns


def test_row_ids_do_not_depend_on_the_split(spark, tmp_path):
    path = str(tmp_path / "wide 100%")
    spark.range(5000, numPartitions=3).selectExpr("id AS y", "id * 0.5 AS `400.5`", "id * 2.0 AS `401`").write.option(
        "parquet.block.size", 4096).parquet(path)
    ids = lambda: {r["spectrum_id"]: r["y"] for r in spectra.read_spectra(spark, path, "d")[0].selectExpr("spectrum_id", "targets['y'] AS y").collect()}
    whole, before = ids(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        assert spark.read.parquet(path).rdd.getNumPartitions() > 3
        assert ids() == whole and len(whole) == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
