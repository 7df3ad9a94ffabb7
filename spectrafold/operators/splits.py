"""Cross-validation splits as table operations; orders come from md5, so every split is reproducible."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.operators.ordering import HOT_ROWS, hash_order, hash_rank, with_values
from spectrafold.session import materialize


def target_key(targets: str = "targets") -> Column:
    """The measured targets of a row as an array, zero and NaN/NULL entries left out (both mean "not measured")."""
    values = F.map_values(F.map_from_entries(F.array_sort(F.map_entries(targets))))
    return F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v != 0))


def named_target_key(targets: str = "targets") -> Column:
    """The older key: (name, value) pairs of the non-zero targets, sorted by name, as JSON."""
    kept = F.map_filter(targets, lambda _, v: v.isNotNull() & (v != 0))
    return F.when(F.size(kept) > 0, F.to_json(F.array_sort(F.map_entries(kept))))


def infer_groups(
    df: DataFrame, *, by: Sequence[str] = ("dataset",), id_column: str = "spectrum_id", targets: str = "targets",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows whose measured target vector matches share a group; NULL for a dataset without any match.

    The group is the smallest id with that vector; rows without a measured target stay alone.
    """
    by = list(by)
    rows = df.withColumn("_key", target_key(targets))
    measured = F.size("_key") > 0
    keys = rows.where(measured).groupBy(*by, "_key").agg(F.count(F.lit(1)).alias("_n"), F.min(id_column).alias("_first"))
    matched = keys.groupBy(*by).agg(F.max("_n").alias("_most"), F.sum("_n").alias("_n")).where(F.col("_most") > 1)
    rows = with_values(rows, keys, [*by, "_key"], ["_first"])
    rows = with_values(rows, matched.withColumn("_any", F.lit(True)), by, ["_any"])
    group = F.coalesce(F.col("_first"), F.col(id_column)).cast("string")
    return rows.withColumn("group_id", F.when(F.col("_any"), group)).drop("_key", "_first", "_any")


def infer_groups_named(
    df: DataFrame, *, id_column: str = "spectrum_id", targets: str = "targets",
) -> DataFrame:
    """Group label by named non-zero targets; rows without any get a label of their own."""
    return df.withColumn("group_id", F.coalesce(
        named_target_key(targets), F.concat(F.lit("__unique_"), F.col(id_column).cast("string"))))


def with_repeats(df: DataFrame, repeats: int | str | Column) -> DataFrame:
    """One copy of every row per repeat, ``repeat`` = 0, 1, ..."""
    n = F.lit(repeats) if isinstance(repeats, int) else repeats
    n = F.col(n) if isinstance(n, str) else n
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))


def kfold(
    df: DataFrame, k: int = 3, repeats: int | str | Column = 1, *, by: Sequence[str] = ("task",),
    id_column: str = "spectrum_id", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(by, repeat, id, fold) of a shuffled k-fold, a fresh shuffle per repeat."""
    keys = [*by, "repeat"]
    rows = with_repeats(df, repeats).select(*keys, id_column)
    ranked = hash_rank(rows, keys, hash_order(F.col("repeat"), id_column), id_column, "_rank", hot_rows=hot_rows)
    return ranked.select(*keys, id_column, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("tinyint").alias("fold"))


def stratified_kfold(
    df: DataFrame, k: int = 3, repeats: int | str | Column = 1, *, label: str = "label", by: Sequence[str] = ("task",),
    id_column: str = "spectrum_id", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """As :func:`kfold`, shuffled and dealt within each class."""
    keys = [*by, "repeat"]
    rows = with_repeats(df, repeats).select(*keys, id_column, label)
    ranked = hash_rank(rows, [*keys, label], hash_order(F.col("repeat"), id_column), id_column, "_rank", hot_rows=hot_rows)
    return ranked.select(*keys, id_column, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("tinyint").alias("fold"))


def _spread_to_rows(df, assigned, by, repeats, group, id_column, hot_rows):
    """Give every row of every repeat its group's fold."""
    rows = with_repeats(df, repeats).select(*by, "repeat", id_column, group)
    out = with_values(rows, assigned, [*by, "repeat", group], ["fold"])
    return out.select(*by, "repeat", id_column, F.col("fold").cast("tinyint").alias("fold"))


def group_kfold(
    df: DataFrame, k: int = 3, repeats: int | str | Column = 1, *, group: str = "group_id", by: Sequence[str] = ("task",),
    id_column: str = "spectrum_id", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Shuffled groups dealt to folds; a group is never split."""
    keys = [*by, "repeat"]
    extra = [repeats] if isinstance(repeats, str) else []
    groups = df.groupBy(*by, group, *extra).agg(F.count(F.lit(1)).alias("_n"))
    ranked = hash_rank(with_repeats(groups, repeats), keys, hash_order(F.col("repeat"), group), group, "_rank", hot_rows=hot_rows)
    assigned = ranked.select(*keys, group, "_n", F.pmod(F.col("_rank") - 1, F.lit(k)).alias("fold"))
    return _spread_to_rows(df, assigned, by, repeats, group, id_column, hot_rows)


def most_even_fold(held: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> int:
    """The fold that a group with these class counts leaves most even; ties go to the fold with fewest rows.

    *held* is the fold x class count table so far. Evenness is the mean over classes of the standard
    deviation of the folds' class shares; values within float tolerance of the best so far tie.
    """
    k = len(held)
    trials = held[None] + np.eye(k)[:, :, None] * counts
    spread = (trials / totals).std(axis=1).mean(axis=1)
    rows = held.sum(axis=1)
    best = 0
    for fold in range(1, k):
        if np.isclose(spread[fold], spread[best]):  # the last bits must not decide
            better = rows[fold] < rows[best]
        else:
            better = spread[fold] < spread[best]
        best = fold if better else best
    return best


def deal_profiles(counts: np.ndarray, copies: np.ndarray, k: int) -> list[tuple[list[int], list[int]]]:
    """Folds for runs of identical groups, in visiting order: (first folds, cycle repeated ever after) per run.

    Once k identical groups in a row went to k different folds, every fold grew by the same counts, so
    evenness and ties are as they were and the next k groups go the same way: the run is periodic.
    """
    totals = (counts * copies[:, None]).sum(axis=0)
    held = np.zeros((k, counts.shape[1]))
    plans = []
    for profile, n in zip(counts, copies):
        dealt: list[int] = []
        cycle: list[int] = []
        while len(dealt) < n:
            fold = most_even_fold(held, profile, totals)
            held[fold] += profile
            dealt.append(fold)
            if len(set(dealt[-k:])) == k and len(dealt) >= k:
                cycle = dealt[-k:]
                rest = int(n) - len(dealt)
                held += (rest // k) * profile
                for fold in cycle[: rest % k]:
                    held[fold] += profile
                break
        plans.append((dealt, cycle))
    return plans


def stratified_group_kfold(
    df: DataFrame, k: int = 3, repeats: int = 1, *, label: str = "label", group: str = "group_id",
    by: Sequence[str] = ("task",), id_column: str = "spectrum_id", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Groups kept whole, classes spread evenly over folds: groups with the most uneven class counts first.

    The rule is sequential over groups, but groups with the same class counts are interchangeable. A worker
    therefore sees one row per distinct class-count profile of a (task, repeat), not the groups or the rows;
    a group finds its fold by its (hash) position among the groups of its profile.
    """
    by = list(by)
    counts = df.groupBy(*by, group, label).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(*by, group).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct(F.col(label).alias("c"), "n")))).alias("_profile"),
        F.sum("n").alias("_n"))
    profiles = with_repeats(groups.groupBy(*by, "_profile").agg(F.count(F.lit(1)).alias("_copies")), repeats)
    types = [f"{c} {df.schema[c].dataType.simpleString()}" for c in by]
    schema = ", ".join([*types, "repeat int", "_profile string", "_copies long", "_first array<int>", "_cycle array<int>"])

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        tables = [{e["c"]: e["n"] for e in json.loads(p)} for p in pdf["_profile"]]
        classes = sorted({c for t in tables for c in t}, key=str)
        matrix = np.array([[t.get(c, 0) for c in classes] for t in tables], dtype=float)
        shuffle = [hashlib.md5(f"{r}|{p}".encode()).hexdigest() for r, p in zip(pdf["repeat"], pdf["_profile"])]
        order = np.lexsort((np.array(shuffle), -matrix.std(axis=1)))
        pdf = pdf.iloc[order].reset_index(drop=True)
        plans = deal_profiles(matrix[order], pdf["_copies"].to_numpy(), k)
        pdf["_first"], pdf["_cycle"] = [p[0] for p in plans], [p[1] for p in plans]
        return pdf[[*by, "repeat", "_profile", "_copies", "_first", "_cycle"]]

    plans = profiles.groupBy(*by, "repeat").applyInPandas(assign, schema)
    placed = hash_rank(with_repeats(groups, repeats), [*by, "repeat", "_profile"], hash_order(F.col("repeat"), group),
                       group, "_pos", hot_rows=hot_rows)
    placed = with_values(placed, plans, [*by, "repeat", "_profile"], ["_first", "_cycle"])
    n_first = F.size("_first")
    fold = F.when(F.col("_pos") <= n_first, F.get("_first", (F.col("_pos") - 1).cast("int"))).otherwise(
        F.get("_cycle", F.pmod(F.col("_pos") - 1 - n_first, F.lit(k)).cast("int")))
    return _spread_to_rows(df, placed.withColumn("fold", fold), by, repeats, group, id_column, hot_rows)


def semi_supervised_folds(
    df: DataFrame, folds: DataFrame, k: int = 3, *, label: str = "label", group: str | None = None,
    by: Sequence[str] = ("task",), id_column: str = "spectrum_id", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(by, repeat, fold, id, part) rows: labeled rows in train/test as in *folds*, unlabeled rows in train only.

    With *group*, an unlabeled row is left out of a fold that tests its group.
    """
    by = list(by)
    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
    labeled = folds.select(*by, "repeat", id_column, F.col("fold").alias("_own"), every).select(
        *by, "repeat", F.col("fold").cast("tinyint").alias("fold"), id_column,
        F.when(F.col("fold") == F.col("_own"), "test").otherwise("train").alias("part"))
    keep = [*by, id_column] + ([group] if group else [])
    free = df.where(F.col(label).isNull()).select(*keep)
    repeats = folds.groupBy(*by).agg((F.max("repeat") + 1).alias("_repeats")).join(
        free.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    free = with_values(free, repeats, by, ["_repeats"])
    free = with_repeats(free.where(F.col("_repeats").isNotNull()), "_repeats")
    free = free.select("*", every).withColumn("fold", F.col("fold").cast("tinyint"))
    if group:
        sizes = free.groupBy(*by, "repeat", "fold", group).agg(F.count(F.lit(1)).alias("_n"))
        tested = folds.join(df.select(*keep), [*by, id_column]).where(F.col(group).isNotNull()).select(
            *by, "repeat", "fold", group).distinct().withColumn("_tested", F.lit(True))
        tested = sizes.join(tested, [*by, "repeat", "fold", group])
        free = with_values(free, tested, [*by, "repeat", "fold", group], ["_tested"])
        free = free.where(F.col("_tested").isNull())
    return labeled.unionByName(free.select(*by, "repeat", "fold", id_column, F.lit("train").alias("part")))


def train_test_split(
    df: DataFrame, test: float = 0.2, seed: int = 0, *, by: Sequence[str] = ("task",), label: str | None = None,
    id_column: str = "spectrum_id", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """*df* plus ``part``: the first ceil(test * n) rows in hash order are test, per class with *label*."""
    keys = [*by, label] if label else list(by)
    return _head_is_test(df, keys, test, hash_order(seed, id_column), id_column, hot_rows, id_column)


def _head_is_test(df, keys, test, order, tie, hot_rows, spread):
    ranked = hash_rank(df, keys, order, tie, "_rank", hot_rows=hot_rows)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = with_values(ranked, sizes.withColumn("_size", F.col("_n")), keys, ["_size"])
    is_test = F.col("_rank") <= F.ceil(F.lit(test) * F.col("_size"))
    return ranked.withColumn("part", F.when(is_test, "test").otherwise("train")).drop("_rank", "_size")


def group_shuffle_split(
    df: DataFrame, test: float = 0.2, seed: int = 0, *, group: str = "group_id", by: Sequence[str] = ("task",),
    id_column: str = "spectrum_id", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Whole groups to the test part: ceil(test * groups) of them, in hash order.

    When no group has two rows this is the plain split of groups of one, i.e. of rows.
    """
    by = list(by)
    groups = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("_rows"))
    split = _head_is_test(groups, by, test, hash_order(seed, group), group, hot_rows, group)
    return with_values(df, split, [*by, group], ["part"])


def task_folds(
    prepared: DataFrame, *, problem_type: str, k: int = 3, repeats: int = 1, label: str = "label",
    by: Sequence[str] = ("task",), id_column: str = "spectrum_id", grouped: bool | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The test folds of prepared tasks: (stratified) and (grouped) as the task asks for; unlabeled rows get none.

    *grouped* names whether groups count; by default they do when there is a ``group_id`` column.
    """
    labeled = prepared.where(F.col(label).isNotNull())
    kw = {"by": by, "id_column": id_column, "hot_rows": hot_rows}
    grouped = "group_id" in prepared.columns if grouped is None else grouped
    if grouped and problem_type == "classification":
        return stratified_group_kfold(labeled, k, repeats, label=label, **kw)
    if grouped:
        return group_kfold(labeled, k, repeats, **kw)
    if problem_type == "classification":
        return stratified_kfold(labeled, k, repeats, label=label, **kw)
    return kfold(labeled, k, repeats, **kw)


def partition_check(folds: DataFrame, *, by: Sequence[str] = ("task",), id_column: str = "spectrum_id") -> DataFrame:
    """Per (by, repeat): rows, distinct ids and whether the test folds partition the task's rows."""
    per_id = folds.groupBy(*by, "repeat", id_column).agg(F.count(F.lit(1)).alias("_c"))
    return per_id.groupBy(*by, "repeat").agg(
        F.sum("_c").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"),
    ).withColumn("is_partition", F.col("n_rows") == F.col("n_ids"))


def export_folds(
    prepared: DataFrame, *, id_column: str = "spectrum_id", by: Sequence[str] = ("task",), **kwargs
) -> DataFrame:
    """:func:`task_folds`, computed once and checked: every used spectrum is in one test fold per repeat."""
    folds = materialize(task_folds(prepared, by=by, id_column=id_column, **kwargs))
    bad = partition_check(folds, by=by, id_column=id_column).where(~F.col("is_partition")).limit(5).collect()
    if bad:
        raise AssertionError(f"the test folds do not partition the rows: {[r.asDict() for r in bad]}")
    return folds


def train_test_ids(folds: DataFrame, task: str, fold: int, repeat: int = 0) -> DataFrame:
    """(spectrum_id, part) of one task's fold; a task without folds raises."""
    rows = folds.where((F.col("task") == task) & (F.col("repeat") == repeat))
    if rows.isEmpty():
        raise KeyError(f"no folds for task {task!r} (repeat {repeat})")
    return rows.select("spectrum_id", F.when(F.col("fold") == fold, "test").otherwise("train").alias("part"))


def bag_folds(train: DataFrame, k: int = 8, *, group: str | None = None, by: Sequence[str] = ("task", "repeat", "fold"),
              id_column: str = "spectrum_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner folds (``bag``) of the training rows of every outer fold, groups kept whole when given."""
    by = list(by)
    if group:
        groups = train.groupBy(*by, group).agg(F.count(F.lit(1)).alias("_n"))
        ranked = hash_rank(groups, by, hash_order("bag", group), group, "_rank", hot_rows=hot_rows)
        assigned = ranked.withColumn("bag", F.pmod(F.col("_rank") - 1, F.lit(k)))
        rows = with_values(train.select(*by, id_column, group), assigned, [*by, group], ["bag"])
        return rows.select(*by, id_column, F.col("bag").cast("int").alias("bag"))
    ranked = hash_rank(train.select(*by, id_column), by, hash_order("bag", id_column), id_column, "_rank", hot_rows=hot_rows)
    return ranked.select(*by, id_column, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int").alias("bag"))


def check_result_folds(tested: DataFrame, assignments: DataFrame, protocol: DataFrame) -> DataFrame:
    """Whether each result was tested on its task's canonical fold.

    *tested*: framework, task, repeat, fold, spectrum_id (NULL for a result without stored ids);
    *assignments*: task, cap, is_protocol, repeat, fold, spectrum_id (one set per legal row cap);
    *protocol*: task, n_repeats. Status: match, match_capped, mismatch, extra_repeat, not_in_protocol,
    no_test_indices.
    """
    result = ["framework", "task", "repeat", "fold"]
    sizes = tested.groupBy(*result).agg(F.count("spectrum_id").alias("n_test"))
    expected = assignments.groupBy("task", "cap", "is_protocol", "repeat", "fold").agg(F.count(F.lit(1)).alias("expected"))
    hits = (tested.join(assignments, ["task", "repeat", "fold", "spectrum_id"])
            .groupBy(*result, "cap", "is_protocol").agg(F.count(F.lit(1)).alias("hits")))
    full = (sizes.join(hits, result)
            .join(expected.withColumnRenamed("cap", "_cap").withColumnRenamed("is_protocol", "_p"), ["task", "repeat", "fold"])
            .where(F.col("cap").eqNullSafe(F.col("_cap")) & (F.col("is_protocol") == F.col("_p"))
                   & (F.col("hits") == F.col("n_test")) & (F.col("expected") == F.col("n_test")))
            .groupBy(*result).agg(F.max("is_protocol").alias("_protocol"),
                                  F.max_by("cap", F.struct("is_protocol", F.col("cap"))).alias("max_train_samples")))
    out = sizes.join(protocol.select("task", "n_repeats"), "task", "left").join(full, result, "left")
    status = (F.when(F.col("n_test") == 0, "no_test_indices")
              .when(F.col("n_repeats").isNull(), "not_in_protocol")
              .when(F.col("repeat") >= F.col("n_repeats"), "extra_repeat")
              .when(F.col("_protocol"), "match")
              .when(F.col("_protocol").isNotNull(), "match_capped")
              .otherwise("mismatch"))
    usable = status.isin("match", "match_capped")
    return out.select(*result, F.when(F.col("n_test") > 0, F.col("n_test")).alias("n_test"), status.alias("status"),
                      F.when(usable, F.col("max_train_samples")).alias("max_train_samples"))
