"""Split invariants, the greedy rule's golden vector, and its run-length form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators import splits, tasks


@pytest.fixture(scope="module")
def grouped(spark):
    return spark.range(300).select(
        F.lit("t").alias("task"), F.lit("d").alias("dataset"), F.col("id").alias("spectrum_id"),
        F.concat(F.lit("g"), F.floor(F.col("id") / 5).cast("string")).alias("group_id"),
        F.concat(F.lit("c"), F.pmod(F.floor(F.col("id") / 7), F.lit(3)).cast("string")).alias("label")).cache()


def sequential(counts, k):
    totals, held, out = counts.sum(axis=0), np.zeros((k, counts.shape[1])), []
    for row in counts:
        fold = splits.most_even_fold(held, row, totals)
        held[fold] += row
        out.append(fold)
    return out


def test_greedy_rule_gives_the_published_folds():
    # A published fold vector of the same rule (3 folds, group order shuffled with seed 0).
    y = np.array(list("aabbbcaacbbbaaccbaabcbac" * 2))
    groups = np.repeat(np.arange(16), 3)
    want = [2, 2, 2, 2, 2, 2, 0, 0, 0, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 0, 0, 0,
            2, 2, 2, 0, 0, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 1, 1, 1]
    classes = np.unique(y)
    counts = np.array([[np.sum(y[groups == g] == c) for c in classes] for g in range(16)], dtype=float)
    order = np.arange(16)
    np.random.RandomState(0).shuffle(order)
    order = order[np.argsort(-counts[order].std(axis=1), kind="stable")]
    fold = np.empty(16, dtype=int)
    fold[order] = sequential(counts[order], 3)
    assert fold[groups].tolist() == want


@pytest.mark.parametrize("k", [2, 3, 5])
def test_runs_of_equal_groups_equal_one_by_one(k, rng):
    counts = rng.integers(0, 5, (6, 3)).astype(float) + np.eye(6, 3)
    counts = counts[np.argsort(-counts.std(axis=1), kind="stable")]
    copies = rng.integers(1, 40, 6)
    got = []
    for (first, cycle), n in zip(splits.deal_profiles(counts, copies, k), copies):
        got += [first[i] if i < len(first) else cycle[(i - len(first)) % k] for i in range(n)]
    assert got == sequential(np.repeat(counts, copies, axis=0), k)


@pytest.mark.parametrize("hot_rows", [3, 10**6])
@pytest.mark.parametrize("kind", ["kfold", "stratified_kfold", "group_kfold", "stratified_group_kfold"])
def test_folds_partition_rows_and_keep_groups_whole(grouped, kind, hot_rows):
    folds = getattr(splits, kind)(grouped, 3, 2, hot_rows=hot_rows)
    rows = folds.join(grouped.select("spectrum_id", "group_id", "label"), "spectrum_id").toPandas()
    assert len(rows) == 600 and rows.groupby(["repeat", "spectrum_id"]).size().eq(1).all()
    assert set(rows["fold"]) == {0, 1, 2}
    sizes = rows.groupby(["repeat", "fold"]).size()
    if "group" in kind:
        assert rows.groupby(["repeat", "group_id"])["fold"].nunique().eq(1).all()
        assert sizes.max() - sizes.min() <= 25
    else:
        assert sizes.max() - sizes.min() <= 3
    if kind.startswith("stratified"):
        per_class = rows.groupby(["repeat", "label", "fold"]).size().unstack()
        assert (per_class.max(axis=1) - per_class.min(axis=1)).max() <= (1 if kind == "stratified_kfold" else 6)
    a, b = (rows[rows["repeat"] == r].set_index("spectrum_id")["fold"].sort_index() for r in (0, 1))
    assert (a != b).any()


def test_hot_and_plain_paths_agree(grouped):
    for kind in ("kfold", "stratified_kfold", "group_kfold", "stratified_group_kfold"):
        one, two = (sorted(map(tuple, getattr(splits, kind)(grouped, 3, 2, hot_rows=h).collect())) for h in (3, 10**6))
        assert one == two


def test_unlabeled_rows_never_tested(grouped):
    some = grouped.withColumn("label", F.when(F.col("spectrum_id") % 4 > 0, F.col("label")))
    folds = splits.group_kfold(some.where(F.col("label").isNotNull()), 3, 1)
    rows = splits.semi_supervised_folds(some, folds, 3, group="group_id").join(some.select("spectrum_id", "group_id", "label"), "spectrum_id").toPandas()
    assert rows.loc[rows["label"].isna(), "part"].eq("train").all()
    for _, g in rows.groupby("fold"):
        assert not set(g.loc[g["part"] == "test", "group_id"]) & set(g.loc[g["part"] == "train", "group_id"])


def test_infer_groups_without_matches_gives_null(spark):
    df = spark.createDataFrame([("d", 1, {"a": 1.0}), ("d", 2, {"a": 2.0}), ("d", 3, {"a": 0.0}), ("d", 4, {"a": float("nan")})],
                               "dataset string, spectrum_id long, targets map<string,double>")
    assert {r["group_id"] for r in splits.infer_groups(df).collect()} == {None}
    again = df.unionByName(spark.createDataFrame([("d", 9, {"a": 2.0})], df.schema))
    got = {r["spectrum_id"]: r["group_id"] for r in splits.infer_groups(again).collect()}
    assert got == {1: "1", 2: "2", 3: "3", 4: "4", 9: "2"}


def test_rare_classes_and_lost_tasks(spark):
    rows = [("a", i, "x") for i in range(12)] + [("a", 100 + i, "y") for i in range(3)] + [("b", i, lab) for i, lab in enumerate("xyxyxyxyxyxyxyxyxyxy")]
    df = spark.createDataFrame(rows, "task string, spectrum_id long, label string")
    got = tasks.filter_rare_classes(df, min_samples=9).toPandas()
    assert set(got["task"]) == {"b"} and len(got) == 20
    assert tasks.filter_rare_classes(df, min_samples=0) is df


def test_missing_names_raise(spark):
    spec = spark.createDataFrame([("d__0", "d", "regression")], "task string, dataset string, problem_type string")
    with pytest.raises(ValueError, match="nowhere"):
        tasks.protocol_tasks(spec, tasks=["d", "nowhere"])
    folds = spark.createDataFrame([("d__0", 0, 1, 0)], "task string, repeat int, spectrum_id long, fold int")
    with pytest.raises(KeyError):
        splits.train_test_ids(folds, "d__0", 0, repeat=5)


def test_tiers(spark):
    edges = spark.createDataFrame([(99, 999, 1, None, None, 29, 10), (100, 1000, 2, True, 1800.0, 30, 10), (100_000, 3000, 2, False, 1800.5, 100, 10)],
                                  "n_samples long, n_features long, n_targets int, is_grouped boolean, freq_max double, max_class long, min_class long")
    got = tasks.categorize(edges.withColumn("dataset", F.lit("d"))).toPandas()
    assert got["scale_tier"].tolist() == ["micro", "tiny", "large"]
    assert got["dimensionality_tier"].tolist() == ["low", "medium", "high"]
    assert got["split_type"].tolist() == ["unknown", "grouped", "iid"]
    assert got["imbalance_tier"].tolist() == ["balanced", "moderate", "severe"]
    assert got["wavenumber_coverage"].tolist() == [None, "fingerprint", "extended"]
