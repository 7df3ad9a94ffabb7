"""Incremental scoring: each key once, incomplete keys wait, repeated input adds nothing."""

from pyspark.sql import functions as F

from spectrafold.streaming.metrics import append_new_files, generations, latest, live_cells, state_schema, stream_fold_metrics, stream_scan_results

SCHEMA = "task string, fold int, model string, problem_type string, spectrum_id long, y_true double, y_pred double"


def put(spark, path, rows):
    spark.createDataFrame([("t", f, m, "regression", i, float(i), i + 1.0) for f, m, i in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, **kwargs):
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    stream_fold_metrics(source, str(tmp_path / "out"), str(tmp_path / "ck"), staging=str(tmp_path / "staged"), **kwargs).awaitTermination()
    return latest(spark.read.parquet(str(tmp_path / "out")))


def state(spark, tmp_path):
    return live_cells(spark, str(tmp_path / "staged"), state_schema(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))))


def test_keys_are_scored_again_from_all_their_rows(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [(0, "a", 1), (0, "a", 2), (1, "a", 3)])
    assert run(spark, tmp_path).count() == 2
    put(spark, str(tmp_path / "in"), [(0, "a", 9), (0, "a", 2), (0, "b", 1)])  # more of fold 0, and a copy
    got = run(spark, tmp_path)
    assert got.count() == 3 and got.where("rmse = 1").count() == 3
    assert state(spark, tmp_path).count() == 5


def test_incomplete_keys_wait_and_leave_when_scored(spark, tmp_path):
    need = spark.createDataFrame([("t", 0, 3), ("t", 1, 1)], "task string, fold int, n_expected long")
    put(spark, str(tmp_path / "in"), [(0, "a", 1), (0, "a", 2), (1, "a", 3)])
    assert run(spark, tmp_path, expected=need).count() == 1
    put(spark, str(tmp_path / "in"), [(0, "a", 2)])  # a copy does not complete the key
    assert run(spark, tmp_path, expected=need).count() == 1
    put(spark, str(tmp_path / "in"), [(0, "a", 4), (1, "a", 3)])
    got = run(spark, tmp_path, expected=need)
    assert got.count() == 2 and got.where("fold = 0 AND mae = 1").count() == 1
    assert state(spark, tmp_path).count() == 0


def test_a_lost_checkpoint_changes_no_result(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [(0, "a", 1)])
    before = run(spark, tmp_path).drop("batch_id").collect()
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))  # everything comes again
    stream_fold_metrics(source, str(tmp_path / "out"), str(tmp_path / "ck2"), staging=str(tmp_path / "staged2")).awaitTermination()
    assert latest(spark.read.parquet(str(tmp_path / "out"))).drop("batch_id").collect() == before


def test_only_new_result_files(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [(0, "a", 1), (1, "a", 1)])
    for extra, want in (((0, "a", 5), 2), ((2, "a", 5), 3)):
        stream = stream_scan_results(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        append_new_files(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["task", "fold", "model"]).awaitTermination()
        put(spark, str(tmp_path / "in"), [extra])
        append_new_files(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["task", "fold", "model"]).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).agg(F.count_distinct("fold", "model")).first()[0] == want
        assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_state_is_added_up_and_old_files_go(spark, tmp_path):
    for i in range(6):
        put(spark, str(tmp_path / "in"), [(0, "a", i), (0, "a", 0), (i % 2, "b", 100 + i)])
        got = run(spark, tmp_path, compact_every=2, slots=3)
    rows = {(r.fold, r.model): r for r in got.collect()}
    assert set(rows) == {(0, "a"), (0, "b"), (1, "b")} and all(abs(r.rmse - 1) < 1e-12 for r in rows.values())
    cells = state(spark, tmp_path)
    assert {(r.fold, r.model): r.n for r in cells.groupBy("fold", "model").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {(0, "a"): 6, (0, "b"): 3, (1, "b"): 3}
    whole, parts = (generations(spark, str(tmp_path / "staged" / x)) for x in ("whole", "cells"))
    assert len(whole) <= 2 and len(parts) <= 4


def test_a_batch_reads_only_the_state_of_its_keys(spark, tmp_path):
    from spectrafold.streaming.metrics import read_cells
    put(spark, str(tmp_path / "in"), [(i, "a", i) for i in range(40)])
    run(spark, tmp_path, slots=8)
    schema = state_schema(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")))
    some = read_cells(spark, str(tmp_path / "staged"), schema, 1, [3])
    assert {r.slot for r in some.select("slot").distinct().collect()} == {3}
    assert "PartitionFilters: [isnotnull(slot" in some._jdf.queryExecution().executedPlan().toString()


def test_a_scored_key_is_not_scored_again(spark, tmp_path):
    need = spark.createDataFrame([("t", 0, 2)], "task string, fold int, n_expected long")
    for rows in ([(0, "a", 1), (0, "a", 2)], [(0, "a", 7)], [(0, "a", 8), (0, "b", 1)], [(0, "b", 2)]):
        put(spark, str(tmp_path / "in"), rows)
        run(spark, tmp_path, expected=need, compact_every=2)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.model, r.batch_id) for r in out.collect()) == [("a", 0), ("b", 3)]
