"""Comparisons of benchmark versions, models and run times; each report is one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.functions.names import with_licence, with_names
from spectrafold.operators.ordering import HOT_ROWS, has_hot_keys, order_statistic
from spectrafold.operators.ranking import normalized_scores, per_task

# ---------------------------------------------------------------- versions


def load_version(results: DataFrame, *, exclude: Sequence[str] = ("DUMMY",)) -> DataFrame:
    """(task, key, model, score, sd, time) of a results table; score is the negated mean error."""
    df = results.where(~F.col("model").isin(*exclude)) if exclude else results
    return df.groupBy("task", F.col("dataset").alias("key"), "model").agg(
        F.avg(-F.col("metric_error")).alias("score"), F.stddev_samp("metric_error").alias("sd"),
        F.avg(F.col("time_train_s") + F.col("time_infer_s")).alias("time"))


def load_legacy_version(clf: DataFrame, reg: DataFrame, *, exclude: Sequence[str] = ("DUMMY",)) -> DataFrame:
    """The same from the older per-seed tables (f1_score / rmse); imputed rows are dropped, keys rewritten."""
    both = clf.select("key", "model", "imputed", F.col("f1_score").alias("score"), F.lit("classification").alias("task")).unionByName(
        reg.select("key", "model", "imputed", (-F.col("rmse")).alias("score"), F.lit("regression").alias("task")))
    both = both.where(~F.col("imputed")).withColumn("key", F.regexp_replace("key", r"_(\d+)$", "__$1"))
    if exclude:
        both = both.where(~F.col("model").isin(*exclude))
    return both.groupBy("task", "key", "model").agg(
        F.avg("score").alias("score"), F.stddev_samp("score").alias("sd"), F.lit(None).cast("double").alias("time"))


def shared(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys of equal task type in both versions, models in both)."""
    keys = a.select("key", "task").distinct().join(b.select("key", "task").distinct(), ["key", "task"]).select("key")
    return keys, a.select("model").intersect(b.select("model"))


def restrict(scores: DataFrame, keys: DataFrame, models: DataFrame) -> DataFrame:
    return scores.join(keys, "key", "left_semi").join(models, "model", "left_semi")


def winners(scores: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Best model per key (ties: the first name), with family and category when *models* is given."""
    order = F.struct((-F.col("score")).alias("s"), "model")
    best = scores.groupBy("key").agg(
        F.min_by("model", order).alias("model"), F.max("score").alias("score"), F.min_by("task", order).alias("task"),
        F.min_by("sd", order).alias("sd"), F.min_by("time", order).alias("time"))
    return best if models is None else with_names(best, models)


def wins_by_family(old: DataFrame, new: DataFrame) -> DataFrame:
    """Share of keys won per category and family in two versions (winners with names), and the change."""
    def shares(w: DataFrame, name: str) -> DataFrame:
        n = w.agg(F.count(F.lit(1))).scalar()
        return w.groupBy("category", "family").agg(F.count(F.lit(1)).alias(f"wins_{name}")).withColumn(
            f"share_{name}", 100.0 * F.col(f"wins_{name}") / n)

    out = shares(old, "old").join(shares(new, "new"), ["category", "family"], "full").na.fill(0)
    return out.withColumn("change", F.col("share_new") - F.col("share_old"))


def winner_flow(old: DataFrame, new: DataFrame, min_wins: int = 3) -> DataFrame:
    """(old family, new family, keys): who took over which key. Families with fewer than *min_wins* wins in
    both versions together are merged per category."""
    both = old.select("key", F.lit("old").alias("v"), "family", "category").unionByName(
        new.select("key", F.lit("new").alias("v"), "family", "category"))
    totals = both.groupBy("family").agg(F.count(F.lit(1)).alias("_wins"), F.min_by("category", F.when(F.col("v") == "old", 0).otherwise(1)).alias("_cat"))
    node = F.when(F.col("_wins") >= min_wins, F.col("family")).otherwise(
        F.concat(F.lit("other "), F.lower(F.col("_cat"))))
    named = both.join(totals, "family").withColumn("node", node)
    per_key = named.groupBy("key").agg(
        F.max(F.when(F.col("v") == "old", F.col("node"))).alias("old_family"), F.max(F.when(F.col("v") == "new", F.col("node"))).alias("new_family"))
    return per_key.where(F.col("old_family").isNotNull() & F.col("new_family").isNotNull()).groupBy("old_family", "new_family").agg(
        F.count(F.lit(1)).alias("keys"))


def rank_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rank by rating in two boards among the models of both; the average rank of ties is cut to an integer."""
    pair = old.select("model", F.col("elo").alias("_o")).join(new.select("model", F.col("elo").alias("_n")), "model")

    def rank(c: str) -> Column:
        w = W.orderBy(F.desc(c))
        return F.floor(F.rank().over(w) + (F.count(F.lit(1)).over(W.partitionBy(c)) - 1) / 2.0).cast("int")

    return pair.withColumn("old_rank", rank("_o")).withColumn("new_rank", rank("_n")).select(
        "model", "old_rank", "new_rank", (F.col("old_rank") - F.col("new_rank")).alias("gain"))


def progress_by_release(errors: DataFrame, releases: DataFrame, baseline: str = "PLS", factor: float = 0.95) -> DataFrame:
    """Per release date: tasks where the best model so far is below *factor* x the baseline's error, and the
    mean share of its error that today's best removes. *errors*: dataset, model, error; *releases*: model, release_date.

    The range condition release <= date is a running minimum per task; every task carries its last value to
    the dates on which nothing was released for it.
    """
    dated = errors.join(releases.where(F.col("release_date").isNotNull()), "model").groupBy("dataset", "release_date").agg(F.min("error").alias("_e"))
    tasks = errors.groupBy("dataset").agg(F.max(F.when(F.col("model") == baseline, F.col("error"))).alias("_base"))
    today = dated.groupBy("dataset").agg(F.min("_e").alias("_today"))
    upto = W.partitionBy("dataset").orderBy("release_date")
    best = dated.withColumn("_best", F.min("_e").over(upto)).withColumn("_prev", F.lag("_best").over(upto)).join(
        tasks, "dataset").join(today, "dataset")
    beaten = lambda e: F.coalesce((e < factor * F.col("_base")).cast("int"), F.lit(0))
    gap = lambda e: F.when(e > 0, F.greatest((e - F.col("_today")) / e, F.lit(0.0))).otherwise(0.0)
    # Changes per date, summed up over dates: tasks x dates never exist as rows.
    steps = best.groupBy("release_date").agg(
        F.sum(beaten(F.col("_best")) - F.when(F.col("_prev").isNull(), 0).otherwise(beaten(F.col("_prev")))).alias("_b"),
        F.sum(gap(F.col("_best")) - F.when(F.col("_prev").isNull(), 0.0).otherwise(gap(F.col("_prev")))).alias("_g"))
    n_tasks = errors.select("dataset").distinct().agg(F.count(F.lit(1))).scalar()
    run = W.orderBy("release_date")
    return steps.select("release_date", F.sum("_b").over(run).alias("tasks_beaten"),
                        (100.0 * F.sum("_g").over(run)).alias("_g")).withColumn("improvability", F.col("_g") / n_tasks).drop("_g")


def headroom(errors: DataFrame, domains: DataFrame, dummy: str = "DUMMY", exclude: Sequence[str] = ()) -> DataFrame:
    """Per task: best error / the trivial model's error, with its domain and the solved flag (at most 5 %)."""
    out = errors.groupBy("dataset").agg(
        F.min(F.when(~F.col("model").isin(dummy, *exclude), F.col("error"))).alias("best"),
        F.max(F.when(F.col("model") == dummy, F.col("error"))).alias("trivial"))
    share = F.col("best") / F.col("trivial")
    return out.join(domains, "dataset", "left").select(
        "dataset", F.coalesce("domain", F.lit("?")).alias("domain"), share.alias("headroom"), (share <= 0.05).alias("solved"))


def headroom_by_domain(rows: DataFrame) -> DataFrame:
    return rows.groupBy("domain").agg(
        F.median("headroom").alias("median_headroom"), F.count_if("solved").alias("solved"), F.count(F.lit(1)).alias("tasks"))


def winner_by_shape(won: DataFrame, sizes: DataFrame, focus: str, n: int = 500, p: int = 2000) -> DataFrame:
    """Per quadrant of spectra x channels: tasks and the share won by category *focus*. *sizes*: key, n_spectra, n_features."""
    quadrant = lambda c, at, low, high: F.when(F.col(c) < at, low).otherwise(high)
    return won.join(sizes, "key").groupBy(
        quadrant("n_spectra", n, "few", "many").alias("spectra"), quadrant("n_features", p, "narrow", "wide").alias("channels")
    ).agg(F.count(F.lit(1)).alias("tasks"), (100.0 * F.avg((F.col("category") == focus).cast("double"))).alias("share"))


def winner_by_domain(won: DataFrame, domains: DataFrame) -> DataFrame:
    """Tasks and share won per (domain, category) with a total row per category over all domains."""
    rows = won.join(domains, "key", "left").withColumn("domain", F.coalesce("domain", F.lit("?")))
    counts = rows.groupingSets([[F.col("domain"), F.col("category")], [F.col("category")]], F.col("domain"), F.col("category")).agg(
        F.count(F.lit(1)).alias("tasks"))
    counts = counts.withColumn("domain", F.coalesce("domain", F.lit("All tasks")))
    return counts.withColumn("share", 100.0 * F.col("tasks") / F.sum("tasks").over(W.partitionBy("domain")))


# Lower bounds and labels of the histogram of ties.
TIE_BINS = ((0, "0"), (1, "1"), (2, "2"), (3, "3-4"), (5, "5-9"), (10, "10-19"), (20, "20+"))


def ties_within_noise(scores: DataFrame) -> DataFrame:
    """Per key: models within one fold standard deviation of the winner, the runner-up's margin (relative to
    the winner's error), the noise, and the bin of the tie count."""
    key = W.partitionBy("key")
    order = key.orderBy(F.desc("score"), "model")
    rows = scores.withColumn("_i", F.row_number().over(order)).withColumn(
        "_best", F.first("score").over(order)).withColumn("_sd", F.first("sd").over(order))
    close = F.col("score") >= F.col("_best") - F.col("_sd")
    scale = F.greatest(-F.max("_best"), F.lit(1e-12))
    second = F.max(F.when(F.col("_i") == 2, F.col("score")))
    out = rows.groupBy("key").agg(
        F.count_if(close & (F.col("_i") > 1)).alias("tied"), F.max(F.when(F.col("_i") == 2, close)).alias("runner_tied"),
        ((F.max("_best") - second) / scale).alias("margin"), (F.max("_sd") / scale).alias("noise"))
    label = F.lit(TIE_BINS[0][1])
    for low, name in TIE_BINS[1:]:
        label = F.when(F.col("tied") >= low, F.lit(name)).otherwise(label)
    return out.withColumn("bin", label)


def cheapest_near_winner(scores: DataFrame, tolerance: float = 0.05, exclude: Sequence[str] = ()) -> DataFrame:
    """Per key: the winner and the fastest model within *tolerance* of its error, with the speed-up."""
    d = scores.where(~F.col("model").isin(*exclude)) if exclude else scores
    order = F.struct((-F.col("score")).alias("s"), "model")
    best = d.groupBy("key").agg(F.min_by("model", order).alias("winner"), F.max("score").alias("_best"), F.min_by("time", order).alias("winner_time"))
    near = d.join(best, "key").where(-F.col("score") <= (1 + tolerance) * -F.col("_best"))
    cheap = F.struct("time", "model")
    out = near.where(F.col("time").isNotNull()).groupBy("key").agg(
        F.max("winner").alias("winner"), F.max("winner_time").alias("winner_time"), F.min_by("model", cheap).alias("cheapest"), F.min("time").alias("cheapest_time"))
    return out.withColumn("speed_up", F.col("winner_time") / F.col("cheapest_time")).withColumn("same", F.col("winner") == F.col("cheapest"))


def cheapest_summary(rows: DataFrame, fast: float = 10.0) -> DataFrame:
    """Keys with a cheaper model, its median speed-up, and the share of keys solved under *fast* seconds."""
    return rows.agg(
        F.count_if(~F.col("same")).alias("cheaper"), F.median(F.when(~F.col("same"), F.col("speed_up"))).alias("median_speed_up"),
        (100.0 * F.avg((F.col("cheapest_time") < fast).cast("double"))).alias("share_fast"))


def regret(results: DataFrame, models: Sequence[str] | None = None, within: float = 0.05) -> DataFrame:
    """1 - normalized score of always using one model: median over tasks and the share within *within*."""
    scores = normalized_scores(per_task(results))
    if models is not None:
        scores = scores.where(F.col("model").isin(*models))
    r = 1 - F.col("score")
    return scores.groupBy("model").agg(F.median(r).alias("median_regret"), F.avg((r <= within).cast("double")).alias("share_within"))


def best_by_licence(board: DataFrame, models: DataFrame, n: int = 30) -> DataFrame:
    """The best model of every licence class (*models*: model, licence) among the top *n* by rating."""
    top = with_licence(board.orderBy(F.desc("elo"), "model").limit(n), models)
    order = F.struct((-F.col("elo")).alias("e"), "model")
    return top.groupBy("licence").agg(F.min_by("model", order).alias("model"), F.max("elo").alias("elo"), F.count(F.lit(1)).alias("models"))


# ---------------------------------------------------------------- times


def hardware_class(gpu: Column, gpu_count: Column) -> Column:
    """Coarse hardware bucket of a run; without a GPU name it is ``cpu`` only if none was counted."""
    g = F.lower(gpu)
    out = F.when(gpu.isNull() | (gpu == ""), F.when(gpu_count == 0, "cpu").otherwise("unknown")).when(g.contains("mps"), "apple-mps")
    for name in ("b200", "h200", "h100", "a100"):
        out = out.when(g.contains(name), name)
    return out.otherwise(F.replace(g, F.lit(" "), F.lit("-")))


def model_speed(times: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per (model, hardware class): geometric mean slowdown against the fastest model of the same task and
    hardware (at least two models), upper-median times, and task counts.

    *times*: dataset, target_idx, repeat, fold, model, hardware_class, time_train_s, time_infer_s.
    """
    task = ["dataset", "target_idx", "repeat", "fold", "hardware_class"]
    long = times.where(F.col("hardware_class") != "unknown").unpivot([*task, "model"], ["time_train_s", "time_infer_s"], "measure", "seconds").where(
        F.col("seconds").isNotNull())
    # The models of one task and hardware share a cell: at most one row per model.
    cell = W.partitionBy(*task, "measure")
    rows = long.withColumn("_fastest", F.min("seconds").over(cell)).withColumn("_models", F.count(F.lit(1)).over(cell))
    slow = F.when(F.col("_models") >= 2, F.log(F.col("seconds") / F.col("_fastest")))
    keys = ["model", "hardware_class"]
    is_train = F.col("measure") == "time_train_s"
    split = has_hot_keys(long, [*keys, "measure"], hot_rows)
    upper = lambda c: F.get(F.sort_array(c), F.floor(F.size(c) / 2).cast("int"))
    seconds = lambda c: [] if split else [upper(F.collect_list(F.when(c, F.col("seconds"))))]
    stats = rows.groupBy(*keys).agg(
        F.count_if(is_train).alias("n_tasks_on_this_hw"), F.count_if(is_train & (F.col("_models") >= 2)).alias("n_comparable_tasks"),
        F.exp(F.avg(F.when(is_train, slow))).alias("geo_mean_train_slowdown"), F.exp(F.avg(F.when(~is_train, slow))).alias("geo_mean_infer_slowdown"),
        *[c.alias("median_train_s") for c in seconds(is_train)], *[c.alias("median_infer_s") for c in seconds(~is_train)])
    if not split:
        return stats
    middle = order_statistic(long, [*keys, "measure"], "seconds", lambda n: F.floor(n / 2) + 1, "_m", hot_rows=hot_rows)
    medians = middle.groupBy(*keys).agg(
        F.max(F.when(is_train, F.col("_m"))).alias("median_train_s"), F.max(F.when(~is_train, F.col("_m"))).alias("median_infer_s"))
    return stats.join(medians, keys)


def time_per_100k(board: DataFrame, columns: Sequence[str] = ("median_time_total_per_1k_s",)) -> DataFrame:
    """Per-1,000-spectra times as times per 100,000."""
    out = board
    for c in columns:
        out = out.withColumn(c.replace("_per_1k_s", "_per_100k_s"), F.col(c) * 100.0)
    return out


def performance_per_task(results: DataFrame, model: str, column: str = "ta_name") -> DataFrame:
    """Mean, standard deviation and count of the error per (dataset, method) of one model."""
    return results.where(F.col(column) == model).groupBy("dataset", "method").agg(
        F.avg("metric_error").alias("mean"), F.stddev_samp("metric_error").alias("std"), F.count("metric_error").alias("count"))


def pairwise_scatter(results: DataFrame, a: str, b: str) -> DataFrame:
    """Mean error of two models per task, and whether the first is lower."""
    two = per_task(results.where(F.col("model").isin(a, b)))
    out = two.groupBy("dataset").agg(
        F.max(F.when(F.col("model") == a, F.col("error"))).alias("error_a"), F.max(F.when(F.col("model") == b, F.col("error"))).alias("error_b"))
    return out.withColumn("a_lower", F.col("error_a") < F.col("error_b"))


def tasks_won(results: DataFrame) -> DataFrame:
    """Tasks on which each model has the lowest mean error (ties: the first name)."""
    best = per_task(results).groupBy("dataset").agg(F.min_by("model", F.struct("error", "model")).alias("model"))
    return best.groupBy("model").agg(F.count(F.lit(1)).alias("tasks_won"))

