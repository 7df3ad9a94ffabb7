"""Exact ranks and order statistics that never put a whole hot group into one task.

A group may hold a third of all rows. A plain ``row_number`` or ``percentile`` over it would run in a
single task, so a group above ``hot_rows`` is cut into ordered buckets first: ranks inside a bucket plus
the number of rows in the buckets before it are the ranks in the group. Buckets are a deterministic
function of the data (a hash prefix, or split points from a hash sample of the values), so a recomputed
task lands on the same answer. Groups below ``hot_rows`` are one bucket and pay no extra shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.session import materialize, measured_broadcast

#: Rows of one key above which the key is split over several tasks.
HOT_ROWS = 1_000_000
#: Rows of one key above which Spark's own ``median`` is not used: a task holds the distinct values of up to 128 keys.
MEDIAN_ROWS = 100_000
#: Hex digits of the hash prefix that names a bucket, at least; groups with more rows have more.
PREFIX = 3
#: Split points of one hot key in :func:`ordered` at most.
SPLITS = 511
#: Sampled values per split point.
OVERSAMPLE = 64


def hash_order(seed, *cols: str | Column) -> Column:
    """A reproducible shuffle order: md5 of the seed and the columns, independent of partitioning."""
    parts = [seed if isinstance(seed, Column) else F.lit(str(seed))]
    parts += [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than *hot_rows* rows and their number ``_n``: at most ``count(df) / hot_rows`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)


def has_hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> bool:
    """Whether any key has more than *hot_rows* rows: one pass over the key columns, done before planning so
    that tables without hot keys get the plain one-shuffle plan."""
    return not hot_keys(df, keys, hot_rows).isEmpty()


def hash_rank(
    df: DataFrame, keys: Sequence[str], order: Column, tie: str, name: str = "rank",
    *, hot_rows: int = HOT_ROWS, at_most: int | None = None, split: bool | None = None,
) -> DataFrame:
    """*df* with the 1-based position of each row in its key group, ordered by a hash and then by *tie*.

    Equals ``row_number() OVER (PARTITION BY keys ORDER BY order, tie)``. With *at_most* only the first
    rows of every group are kept, and buckets past that point are dropped before they are sorted. *split* says
    whether there are hot groups (None: look).
    """
    keys = list(keys)
    hot = None if split is False else materialize(hot_keys(df, keys, hot_rows))
    if hot is None or (split is None and hot.isEmpty()):
        ranked = df.withColumn("_h", order).withColumn(
            name, F.row_number().over(W.partitionBy(*keys).orderBy("_h", tie)).cast("long")).drop("_h")
        return ranked if at_most is None else ranked.where(F.col(name) <= at_most)
    digits = F.greatest(F.lit(PREFIX), F.ceil(F.log(16.0, F.col("_n") / float(hot_rows))).cast("int") + 1)
    rows = (
        df.withColumn("_h", order)
        .join(measured_broadcast(hot.select(*keys, digits.alias("_digits"))), keys, "left")
        .withColumn("_b", F.when(F.col("_digits").isNotNull(), F.substr("_h", F.lit(1), F.col("_digits"))).otherwise(F.lit("")))
        .drop("_digits")
    )
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.where(F.col("_b") != "").groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    )
    rows = rows.join(offsets, [*keys, "_b"], "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
    if at_most is not None:
        rows = rows.where(F.col("_before") < at_most)
    rows = rows.withColumn(name, F.col("_before") + F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_h", tie)))
    if at_most is not None:
        rows = rows.where(F.col(name) <= at_most)
    return rows.drop("_h", "_b", "_before")


def running_totals(
    v: DataFrame, keys: Sequence[str], value: str, cols: Sequence[str], *, hot_rows: int = HOT_ROWS, split: bool | None = None,
) -> DataFrame:
    """For rows unique in (keys, value): ``<c>_before`` (sum over smaller values) and ``<c>_total`` per group."""
    keys, cols = list(keys), list(cols)
    hot = None if split is False else materialize(hot_keys(v, keys, hot_rows))
    if hot is None or (split is None and hot.isEmpty()):
        before = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        group = W.partitionBy(*keys)
        return v.select(
            "*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in cols],
            *[F.sum(c).over(group).alias(f"{c}_total") for c in cols])
    hot = measured_broadcast(hot.withColumn("_m", F.ceil(F.col("_n") / hot_rows).cast("int") + 1))
    unit = F.pmod(F.xxhash64(value), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sampled = v.select(*keys, value).join(hot, keys).where(unit < OVERSAMPLE * F.col("_m") / F.col("_n"))
    splits = (
        sampled.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_s"), F.max("_m").alias("_m"))
        .select(*keys, F.transform(
            F.sequence(F.lit(1), F.col("_m") - 1),
            lambda i: F.element_at("_s", F.greatest(F.lit(1), F.floor(i * F.size("_s") / F.col("_m")).cast("int"))),
        ).alias("_s"))
    )
    # Every hot group has one split point per hot_rows rows.
    b = v.join(measured_broadcast(materialize(splits)), keys, "left").withColumn(
        "_b", F.when(F.col("_s").isNull(), F.lit(-1)).otherwise(
            F.size(F.filter("_s", lambda s: s <= F.col(value))))
    ).drop("_s")
    w = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = b.where(F.col("_b") >= 0).groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_{c}") for c in cols])
    offsets = offsets.select(
        *keys, "_b",
        *[F.coalesce(F.sum(f"_{c}").over(w), F.lit(0)).alias(f"_{c}_off") for c in cols],
        *[F.sum(f"_{c}").over(W.partitionBy(*keys)).alias(f"_{c}_all") for c in cols],
    )
    b = b.join(offsets, [*keys, "_b"], "left")
    inside = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys, "_b")
    for c in cols:
        b = b.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.coalesce(F.col(f"_{c}_off"), F.lit(0)))
    for c in cols:
        b = b.withColumn(f"{c}_total", F.coalesce(F.col(f"_{c}_all"), F.sum(c).over(whole)))
    return b.drop("_b", *[f"_{c}_off" for c in cols], *[f"_{c}_all" for c in cols])


def ordered(rows: DataFrame, keys: Sequence[str], values: dict[str, str], weights: Sequence[str], *, also: dict[str, Column] | None = None,
            hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """*rows* with, for each name and column of *values* and each weight, ``<name>_<weight>_before`` (its sum over the key's
    rows of smaller value) and ``<name>_<weight>_ties`` (over those of equal value), and the aggregates *also* of the key.

    The plan is fixed: nothing is looked at before it runs. Keys of up to *hot_rows* rows meet in one exchange and are sorted
    once for each value; hot keys, of which there are at most rows / *hot_rows*, are split by :func:`_in_ranges`. Without any,
    adaptive execution drops that branch; with *hot_rows* None, who calls knows that there are none. Keys and values are not null; *rows* should know that (by a filter), or joins that find
    it out make the exchanges below differ, and they are run for each branch.
    """
    keys, also = list(keys), also or {}
    group, kept = W.partitionBy(*keys), [*rows.columns, *also]
    cells = [(v, c, w, f"{v}_{w}") for v, c in values.items() for w in weights]
    summed = [*[a.over(group).alias(k) for k, a in also.items()],
              *[F.sum(w).over(group.orderBy(c).rangeBetween(W.unboundedPreceding, 0)).alias(f"{x}_before") for v, c, w, x in cells],
              *[F.sum(w).over(W.partitionBy(*keys, c)).alias(f"{x}_ties") for v, c, w, x in cells]]  # so far with the ties
    less = [*kept, *[f"{x}_ties" for *_, x in cells], *[(F.col(f"{x}_before") - F.col(f"{x}_ties")).alias(f"{x}_before") for *_, x in cells]]
    if hot_rows is None:
        return rows.select("*", *summed).select(*less)
    hot = rows.groupBy(*keys).agg(_all_rows(rows, keys).alias("_n")).where(F.col("_n") > hot_rows).select(*keys, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")  # a semi or anti join would be pushed below that exchange
    plain = marked.where(F.col("_hot").isNull()).drop("_hot").select("*", *summed)
    split = _in_ranges(marked.where("_hot").drop("_hot"), keys, values, weights, also, hot_rows)
    return plain.unionByName(split).select(*less)


def _all_rows(rows: DataFrame, keys: Sequence[str]) -> Column:
    """Number of rows, by looking at every column: so no branch of a plan prunes one, and all share the exchange below."""
    return F.count_if(F.hash(*[F.col(c) for c in rows.columns if c not in keys]) <= (1 << 31) - 1)


def _up_to(value: str):
    return lambda x: x <= F.col(value)


def _in_ranges(rows: DataFrame, keys: list[str], values: dict[str, str], weights: Sequence[str], also: dict[str, Column], hot_rows: int) -> DataFrame:
    """:func:`ordered` for hot keys. A sketch of a key's values gives a split point about every *hot_rows* rows, up to SPLITS
    of them; rows are summed within their ranges, and what lies in the ranges before is added, so that where the split points
    lie changes no result."""
    names = list(values)
    points = F.expr(f"cast(split('{','.join(repr(i / (SPLITS + 1)) for i in range(1, SPLITS + 1))}', ',') as array<double>)")
    n_splits = F.least(F.lit(SPLITS), F.floor(_all_rows(rows, keys) / float(hot_rows)).cast("int"))
    found = rows.groupBy(*keys).agg(
        n_splits.alias("_n"), *[F.percentile_approx(c, points, 4 * SPLITS).alias(f"_s_{v}") for v, c in values.items()],
        *[a.alias(k) for k, a in also.items()])

    def chosen(points: str) -> Column:  # as many points as the key's rows need, spread evenly
        place = lambda i: F.floor(i * (SPLITS + 1) / (F.col("_n") + 1)).cast("int")
        return F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.element_at(points, place(i)))

    found = found.select(*keys, *also, *[chosen(f"_s_{v}").alias(f"_s_{v}") for v in names])
    buckets = [F.size(F.filter(f"_s_{v}", _up_to(c))).alias(f"_b_{v}") for v, c in values.items()]
    placed = rows.join(found, keys).select(*rows.columns, *also, *buckets)
    ranges = placed.select(*keys, *weights, F.explode(F.array(*[F.struct(F.lit(i).alias("v"), F.col(f"_b_{v}").alias("b")) for i, v in enumerate(names)])).alias("_r"))
    ranges = ranges.groupBy(*keys, "_r").agg(*[F.sum(w).alias(w) for w in weights])
    below = W.partitionBy(*keys, "_r.v").orderBy("_r.b").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "_r", F.struct(*[F.coalesce(F.sum(w).over(below), F.lit(0)).alias(w) for w in weights]).alias("_o"))
    offsets = ranges.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_o"))).alias("_o"))
    out = []
    for i, (v, c) in enumerate(values.items()):
        inside, equal = W.partitionBy(*keys, f"_b_{v}").orderBy(c).rangeBetween(W.unboundedPreceding, 0), W.partitionBy(*keys, f"_b_{v}", c)
        offset = F.element_at("_o", F.struct(F.lit(i).alias("v"), F.col(f"_b_{v}").alias("b")))
        out += [(F.sum(w).over(inside) + offset[w]).alias(f"{v}_{w}_before") for w in weights] + [F.sum(w).over(equal).alias(f"{v}_{w}_ties") for w in weights]
    return placed.join(offsets, keys).select(*rows.columns, *also, *out)


def average_ranks(v: DataFrame, keys: Sequence[str], value: str, n: str, name: str, *, hot_rows: int = HOT_ROWS,
                  split: bool | None = None) -> DataFrame:
    """Rows (keys, value, n copies) with the rank their copies share: mean position, 1-based."""
    run = running_totals(v, keys, value, [n], hot_rows=hot_rows, split=split)
    return run.withColumn(name, F.col(f"{n}_before") + (F.col(n) + 1) / 2.0)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", *, weight: str | None = None,
                 hot_rows: int = HOT_ROWS, split: bool | None = None) -> DataFrame:
    """The exact median of the non-null *value* per group (mean of the two middle values for even counts).

    *weight* counts the copies a row stands for. Spark's ``median`` keeps the distinct values of its groups in memory: good
    for small groups of single rows only. Others take the value that covers the middle position, from running counts.
    """
    keys = list(keys)
    if weight is None and not split and not has_hot_keys(df, keys, min(hot_rows, MEDIAN_ROWS)):
        return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.median(value).alias(name))
    copies = F.count(F.lit(1)) if weight is None else F.sum(weight)
    v = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(copies.alias("_k"))
    run = running_totals(v, keys, value, ["_k"], hot_rows=hot_rows, split=True if weight is None else split)
    total, before, upto = F.col("_k_total"), F.col("_k_before"), F.col("_k_before") + F.col("_k")
    low, high = F.floor((total + 1) / 2), F.floor(total / 2) + 1
    covers = lambda pos: (before < pos) & (upto >= pos)
    return (
        run.where(covers(low) | covers(high)).groupBy(*keys)
        .agg(((F.min(value) + F.max(value)) / 2).alias(name))
    )


def order_statistic(df: DataFrame, keys: Sequence[str], value: str, position, name: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The value at a 1-based *position* of each group; *position* maps the group's count column to a column."""
    keys = list(keys)
    v = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    run = running_totals(v, keys, value, ["_k"], hot_rows=hot_rows)
    pos = position(F.col("_k_total"))
    hit = (F.col("_k_before") < pos) & (F.col("_k_before") + F.col("_k") >= pos)
    return run.where(hit).select(*keys, F.col(value).alias(name))


def with_values(rows: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """*rows* with the *values* of a one-row-per-key *table*. A left join: adaptive execution broadcasts a table that turns
    out small, and splits the partitions of hot keys otherwise. Without *keys* the table has one row, which all get."""
    if not keys:
        return rows.join(F.broadcast(table.select(*values)), F.lit(True), "left")
    return rows.join(table.select(*keys, *values), list(keys), "left")


#: Ranges that :func:`best_before` cuts a key into at most.
RANGES = 256


def best_before(rows: DataFrame, keys: Sequence[str], order: str, best: Column) -> DataFrame:
    """*rows* cut into ranges of *order* (``_range``), with the largest *best* of the key's ranges before (``_earlier``, null
    in the first): the first half of a running maximum, the other is a window within (*keys*, ``_range``).

    A sketch of the key's *order* (numbers or dates, not null) gives the cuts; rows of equal *order* share a range, and where
    the cuts lie changes no result. Between tasks go the cuts and one value for each range, at most RANGES for a key. The cuts
    are computed first and broadcast if small: with few keys, an exchange by key would put a key's rows into one task.
    """
    keys = list(keys)
    cuts = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 4 * RANGES)).alias("_cuts"))
    cuts = measured_broadcast(materialize(cuts))
    placed, step = with_values(rows, cuts, keys, ["_cuts"]).withColumn("_range", F.lit(0)), RANGES // 2
    while step:  # binary search: the number of cuts below the row
        placed = placed.withColumn("_range", F.col("_range") + F.when(F.get("_cuts", F.col("_range") + (step - 1)) < F.col(order), step).otherwise(0))
        step //= 2
    placed = placed.drop("_cuts")
    below = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    tops = placed.groupBy(*keys, "_range").agg(F.max(best).alias("_top")).withColumn("_earlier", F.max("_top").over(below))
    return with_values(placed, tops, [*keys, "_range"], ["_earlier"])
