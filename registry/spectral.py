"""Queries: scans, per-spectrum steps, fitted steps, recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import steps
from registry.views import POSITIVE, SPECTRA, axis, long, positive_spectra, r, rounded, spectra, table
from spectrafold.functions import kernels
from spectrafold.functions import spectral as native
from spectrafold.functions.batches import kernel_column
from spectrafold.operators import augment as aug
from spectrafold.operators import fitted
from spectrafold.plans.preprocessor import Preprocessor
from spectrafold.plans.recipes import recipe_names
from spectrafold.sources import results as result_sources
from spectrafold.sources import spectra as sources

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# ---------------------------------------------------------------- scans


def wide(spark, sf):
    """The spectra as a wide table whose columns are named by wavenumber, in scrambled order."""
    order = [(i * 7) % 64 for i in range(64)]
    return spectra(spark, sf).select(
        "spectrum_id", *[F.col("intensities")[i].alias(f"{400 + 25 * i}.0") for i in order],
        F.col("group_id").alias("_group_id"), "y", "label")


@query("wide_to_spectra", "WITH" + SPECTRA + f"""
SELECT dataset, spectrum_id, CAST(channel AS BIGINT) AS channel, 400e0 + 25e0 * channel AS wavenumber, {r('x')} AS intensity
FROM xl JOIN (SELECT spectrum_id AS s, dataset FROM x) ON s = spectrum_id""")
def _(spark, sf):
    found, shifts = sources.wide_to_spectra(wide(spark, sf), "emb", id_column="spectrum_id")
    out = sources.spectra_to_long(found, shifts)
    return rounded(out.withColumn("channel", F.col("channel").cast("long")))


@query("wide_targets", "WITH" + SPECTRA + f"SELECT spectrum_id, {r('y')} AS y, label, group_id FROM x")
def _(spark, sf):
    found, _ = sources.wide_to_spectra(wide(spark, sf), "emb", id_column="spectrum_id")
    return rounded(found.select("spectrum_id", F.element_at("targets", "y").alias("y"), "label", "group_id"))


@query("wide_labels", "WITH" + SPECTRA + """
SELECT spectrum_id, label, CAST(spectrum_id % 3 AS VARCHAR) AS batch, group_id AS site, CAST(spectrum_id % 3 AS VARCHAR) AS chosen FROM x""")
def _(spark, sf):
    rows = wide(spark, sf).withColumn("batch", F.pmod("spectrum_id", F.lit(3)).cast("int")).withColumn("site", F.col("_group_id"))
    found, _ = sources.wide_to_spectra(rows, "emb", id_column="spectrum_id", classes=("batch",), label="batch")
    named = [F.element_at("labels", c).alias(c) for c in ("label", "batch", "site")]
    return found.select("spectrum_id", *named, F.col("label").alias("chosen"))


@query("read_columns", "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1")
def _(spark, sf):
    rows = sources.read_columns(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_quantity"])
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("scan_results", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    return result_sources.scan_results(spark, f"{sf}/part.parquet").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("flatten_exclusions", "SELECT DISTINCT p_type AS key, p_brand AS category FROM part")
def _(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_type").distinct()
    body = part.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", F.lit("note")))).alias("m"))
    body = body.select("p_brand", F.to_json(F.map_concat("m", F.create_map(F.lit("_criterion"), F.lit("text")))).alias("j"))
    doc = body.agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "j"))).alias("doc")).select(
        F.map_concat("doc", F.create_map(F.lit("_comment"), F.lit("text"))).alias("doc"))
    return result_sources.flatten_exclusions(doc)


# ---------------------------------------------------------------- per-spectrum steps, JVM side


def step(name: str, sql: str, column, digits: int = 6, source=spectra):
    @query(name, sql)
    def _(spark, sf):
        return long(source(spark, sf).withColumn("intensities", column(F.col("intensities"))), digits=digits)


WINDOW = "OVER (PARTITION BY spectrum_id)"

step("snv", "WITH" + SPECTRA + f"""
SELECT spectrum_id, CAST(channel AS BIGINT) AS channel, {r(f'(x - avg(x) {WINDOW}) / stddev_pop(x) {WINDOW}')} AS x FROM xl""", native.snv)

step("vector_normalize", "WITH" + SPECTRA + f"""
SELECT spectrum_id, CAST(channel AS BIGINT) AS channel, {r(f'x / sqrt(sum(x * x) {WINDOW})')} AS x FROM xl""", native.vector_normalize)

step("crop_fraction", "WITH" + SPECTRA + f"""
SELECT spectrum_id, CAST(channel - 10 AS BIGINT) AS channel, {r('x')} AS x FROM xl WHERE channel >= 10 AND channel < 48""",
     native.crop_fraction)

step("avg_pool", "WITH" + SPECTRA + f"""
SELECT spectrum_id, CAST(channel // 5 AS BIGINT) AS channel, {r('avg(x)')} AS x FROM xl WHERE channel < 60 GROUP BY 1, 2""",
     lambda x: native.avg_pool(x, 5))

step("decimate", "WITH" + SPECTRA + f"""
SELECT spectrum_id, CAST(channel // 5 AS BIGINT) AS channel, {r('x')} AS x FROM xl WHERE channel < 60 AND channel % 5 = 0""",
     lambda x: native.decimate(x, 5))

step("bin_channels", "WITH" + SPECTRA + f""",
edges AS (SELECT i, CAST(round_even(i * 64 / 12e0, 0) AS INTEGER) AS a, CAST(round_even((i + 1) * 64 / 12e0, 0) AS INTEGER) AS b FROM range(12) t(i))
SELECT spectrum_id, CAST(i AS BIGINT) AS channel, {r('avg(x)')} AS x FROM xl JOIN edges ON channel >= a AND channel < b GROUP BY 1, 2""",
     lambda x: native.bin_channels(x, 12))

step("nan_to_zero", "WITH" + SPECTRA + f"""
SELECT spectrum_id, CAST(channel AS BIGINT) AS channel, {r("CASE WHEN abs(x) > 1e-1 THEN 0e0 ELSE x END")} AS x FROM xl""",
     lambda x: native.nan_to_zero(F.transform(x, lambda v: F.when(F.abs(v) > 0.1, F.lit(float("nan"))).otherwise(v))))


@query("crop_physical", "WITH" + SPECTRA + f"""
SELECT spectrum_id, CAST(channel - 4 AS BIGINT) AS channel, {r('x')} AS x FROM xl WHERE 400 + 25 * channel BETWEEN 500 AND 1800""")
def _(spark, sf):
    return long(native.crop_physical(spectra(spark, sf), axis(spark, sf), 500.0, 1800.0))


@query("distinct_spectra", "WITH" + SPECTRA + """
SELECT label, count(*) AS rows_, count(DISTINCT list_transform(v, lambda e: round(e, 1))) AS spectra_ FROM x GROUP BY 1""")
def _(spark, sf):
    coarse = spectra(spark, sf).withColumn("intensities", F.transform("intensities", lambda v: F.round(v, 1) + 0.0))
    rows = coarse.withColumn("digest", native.spectrum_digest("intensities"))
    return rows.groupBy("label", "digest").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(
        F.sum("n").alias("rows_"), F.count(F.lit(1)).alias("spectra_"))


@query("once_per_distinct", "WITH" + SPECTRA + f""",
c AS (SELECT spectrum_id, channel, round(x, 1) AS x FROM xl)
SELECT spectrum_id, CAST(channel AS BIGINT) AS channel, {r(f'x / CASE WHEN sum(x * x) {WINDOW} = 0 THEN 1 ELSE sqrt(sum(x * x) {WINDOW}) END')} AS x FROM c""")
def _(spark, sf):
    coarse = spectra(spark, sf).withColumn("intensities", F.transform("intensities", lambda v: F.round(v, 1)))
    return long(native.once_per_distinct(
        coarse, lambda d: d.withColumn("intensities", native.vector_normalize("intensities"))))


# ---------------------------------------------------------------- per-spectrum steps, Arrow kernels


def kernel_step(name: str, kernel, sql: str | None = None, source=spectra, digits: int = 6):
    @query(name, sql)
    def _(spark, sf):
        return long(source(spark, sf).withColumn("intensities", kernel_column("intensities", kernel)), digits=digits)


kernel_step("savgol", kernels.savgol, steps.chained([steps.savgol(9, 3, 0)], source="xl", base=SPECTRA))
kernel_step("savgol_derivative", kernels.savgol_derivative, steps.chained([steps.savgol(11, 2, 1)], source="xl", base=SPECTRA))
kernel_step("despike", lambda x: kernels.despike(x, threshold=3.0, kernel=3), steps.chained([steps.despike(3.0)], source="xl", base=SPECTRA))
kernel_step("wavelet_denoise", kernels.wavelet_denoise, steps.chained([steps.wavelet(kernels.WAVELETS["sym7"])], source="xl", base=SPECTRA))
kernel_step("baseline_asls", kernels.baseline_asls, steps.chained([steps.asls()]), source=positive_spectra)
kernel_step("baseline_airpls", kernels.baseline_airpls, steps.chained([steps.airpls()]), source=positive_spectra)
kernel_step("baseline_arpls", kernels.baseline_arpls, steps.chained([steps.arpls()]), source=positive_spectra)
kernel_step("baseline_rubberband", kernels.baseline_rubberband, steps.chained([steps.rubberband]), source=positive_spectra)

# ---------------------------------------------------------------- fitted steps: each fold's state comes from the other folds
# Scatter correction divides by slopes near 0, so values reach 1000; three decimals are compared.


def folded(spark, sf, source=spectra):
    return source(spark, sf).withColumn("fold", F.pmod("spectrum_id", F.lit(3)).cast("int"))


@query("msc_by_fold", steps.chained([steps.msc], digits=3))
def _(spark, sf):
    rows = folded(spark, sf, positive_spectra)
    return long(fitted.MSC().fit(rows, ["task"], "fold").transform(rows), digits=3)


@query("msc_region", "WITH" + POSITIVE + f""",
ref AS (SELECT channel, avg(x) AS m FROM pos GROUP BY 1),
fit AS (SELECT spectrum_id, regr_slope(x, m) AS slope, regr_intercept(x, m) AS icept FROM pos JOIN ref USING (channel)
  WHERE channel >= 16 AND channel < 48 GROUP BY 1)
SELECT spectrum_id, CAST(channel AS BIGINT) AS channel, {r('(x - icept) / slope', 3)} AS x FROM pos JOIN fit USING (spectrum_id)""")
def _(spark, sf):
    rows = positive_spectra(spark, sf)
    state = fitted.MSC(0.25, 0.75).fit(rows).state
    joined = rows.withColumn("reference", state.scalar())
    return long(joined.withColumn("intensities", native.msc("intensities", "reference", 0.25, 0.75)), digits=3)


@query("standard_scaler_by_fold", steps.chained([steps.scaling]))
def _(spark, sf):
    rows = folded(spark, sf, positive_spectra)
    return long(fitted.StandardScaler().fit(rows, ["task"], "fold").transform(rows))


@query("emsc_by_fold", steps.chained([steps.emsc(4)], digits=3))
def _(spark, sf):
    rows = folded(spark, sf, positive_spectra)
    return long(fitted.EMSC().fit(rows, ["task"], "fold").transform(rows), digits=3)


@query("lvse_by_fold")
def _(spark, sf):
    rows = folded(spark, sf)
    return long(fitted.LVSE().fit(rows, ["task"], "fold").transform(rows), digits=6)


@query("gcu")
def _(spark, sf):
    rows = positive_spectra(spark, sf)
    return long(fitted.GCU().fit(rows, ["task"]).transform(rows), digits=6)


@query("recipe_snv_avgpool", "WITH" + SPECTRA + f""",
s AS (SELECT spectrum_id, channel, (x - avg(x) {WINDOW}) / stddev_pop(x) {WINDOW} AS x FROM xl)
SELECT spectrum_id, CAST(channel // 5 AS BIGINT) AS channel, {r('avg(x)')} AS x FROM s WHERE channel < 60 GROUP BY 1, 2""")
def _(spark, sf):
    rows = spectra(spark, sf)
    return long(Preprocessor({"snv": True, "avgpool": True}).fit(rows).transform(rows))


_bc, _sg, _snv, _crr = steps.asls(), steps.savgol(9, 3, 0), steps.snv, steps.despike(6.0)
#: The steps of the recipes, in order, for the SQL twins; an ensemble has blocks.
RECIPE_STEPS = {
    "none": [[]], "snv": [[_snv]], "msc": [[steps.msc]], "emsc": [[steps.emsc(4)]], "sg": [[_sg]], "bc": [[_bc]], "stdscale": [[steps.scaling]],
    "bc_sg": [[_sg, _bc]], "bc_snv": [[_bc, _snv]], "bc_sg_snv": [[_sg, _bc, _snv]], "bc_sg_msc": [[_sg, _bc, steps.msc]],
    "airpls_snv": [[steps.airpls(), _snv]], "arpls_snv": [[steps.arpls(), _snv]], "sg_rubberband_snv": [[_sg, steps.rubberband, _snv]],
    "crr_snv": [[_crr, _snv]], "sg_d1_snv": [[steps.savgol(11, 2, 1), _snv]], "sg_d2_snv": [[steps.savgol(15, 2, 2), _snv]],
    "all": [[_crr, _sg, _bc, steps.msc, _snv, steps.scaling]], "avgpool": [[steps.avg_pool]], "decimate": [[steps.decimate]],
    "bc_snv_avgpool": [[_bc, _snv, steps.avg_pool]], "wavelet_bc_snv": [[steps.wavelet(kernels.WAVELETS["sym7"]), _bc, _snv]],
    "prep_ensemble": [[_snv], [steps.emsc(4)], [steps.airpls(), _snv], []],
}


def recipe_query(name: str):
    blocks = RECIPE_STEPS.get(name)
    digits = 3 if {"msc", "emsc"} & set(name.split("_")) or name in ("all", "prep_ensemble") else 5

    @query(f"recipe_{name}", steps.chained(*blocks, digits=digits) if blocks else None)
    def _(spark, sf):
        rows = folded(spark, sf, positive_spectra)
        return long(Preprocessor.named(name, by=["task"], hold_out="fold").fit(rows).transform(rows), digits=digits)


for _name in recipe_names():
    recipe_query(_name)


@query("augment")
def _(spark, sf):
    rows = spectra(spark, sf).select("spectrum_id", "label", "intensities")
    out = aug.augment(rows, 2, noise=0.01, shift=2, mixup_alpha=0.4)
    return long(out, digits=6, keys=("spectrum_id", "copy", "label"))


@query("augment_shape", "WITH" + SPECTRA + """, copies AS (SELECT c FROM (VALUES (-1), (0), (1), (2), (3)) t(c))
SELECT c AS copy, label, count(*) AS n FROM x, copies GROUP BY 1, 2""")
def _(spark, sf):
    rows = spectra(spark, sf).select("spectrum_id", "label", "intensities")
    return aug.augment(rows, 3, noise=0.01, shift=1, mixup_alpha=0.2).groupBy("copy", "label").agg(F.count(F.lit(1)).alias("n"))
