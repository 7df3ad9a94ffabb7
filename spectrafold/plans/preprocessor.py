"""The user's surface: fit a recipe on training spectra, replay it on others, as pyspark.ml stages.

Plan rules: consecutive per-spectrum steps are fused into one Arrow pass; they run before any fit, so they
are computed once per spectrum and not once per fold; a fitted step adds one aggregation job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial
from itertools import groupby

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.functions import kernels
from spectrafold.functions.batches import chain, kernel_column
from spectrafold.functions.spectral import crop_physical, nan_to_zero
from spectrafold.operators import fitted
from spectrafold.plans.recipes import enabled_steps, recipe, recipe_params
from spectrafold.session import materialize

FITTED = ("msc", "emsc", "standard_scaling", "gcu", "lvse")
COSTLY = ("wavelet_denoise", "baseline_correction", "airpls", "arpls", "rubberband")


def spectrum_kernel(step: str, p: dict):
    """The kernel of a per-spectrum step with its parameters."""
    return {
        "crop": lambda: partial(kernels.crop_fraction, start=p["prep_crop_start_frac"], end=p["prep_crop_end_frac"]),
        "cosmic_ray_removal": lambda: partial(
            kernels.despike, threshold=p["prep_crr_threshold"], kernel=p["prep_crr_kernel_size"]),
        "denoising": lambda: partial(kernels.savgol, window=p["prep_denoise_wl"], poly=p["prep_denoise_po"]),
        "wavelet_denoise": lambda: partial(
            kernels.wavelet_denoise, wavelet=p["prep_wavelet_name"], level=p["prep_wavelet_level"]),
        "baseline_correction": lambda: partial(kernels.baseline_asls, lam=p["prep_bl_lam"], p=p["prep_bl_p"]),
        "airpls": lambda: partial(kernels.baseline_airpls, lam=p["prep_airpls_lam"],
                                  max_iter=p["prep_airpls_max_iter"], tol=p["prep_airpls_tol"]),
        "arpls": lambda: partial(kernels.baseline_arpls, lam=p["prep_arpls_lam"], max_iter=p["prep_arpls_max_iter"]),
        "rubberband": lambda: kernels.baseline_rubberband,
        "derivative": lambda: partial(kernels.savgol_derivative, window=p["prep_deriv_wl"], poly=p["prep_deriv_po"],
                                      deriv=p["prep_deriv_order"]),
        "snv": lambda: kernels.snv,
        "vecnorm": lambda: kernels.vector_normalize,
        "avgpool": lambda: partial(kernels.avg_pool, size=p["prep_avgpool_size"]),
        "decimate": lambda: partial(kernels.decimate, step=p["prep_decimate_step"]),
        "nan_to_zero": lambda: kernels.nan_to_zero,
    }[step]()


def fitted_step(step: str, p: dict):
    return {
        "msc": lambda: fitted.MSC(p["prep_msc_start_frac"], p["prep_msc_end_frac"]),
        "emsc": lambda: fitted.EMSC(p["prep_emsc_poly_order"]),
        "standard_scaling": fitted.StandardScaler,
        "gcu": lambda: fitted.GCU(p["prep_gcu_rho"], p["prep_gcu_random_state"]),
        "lvse": lambda: fitted.LVSE(p["prep_lvse_n_regions"], p["prep_lvse_k_per_region"]),
    }[step]()


def run_stages(df: DataFrame, stages: Sequence, column: str) -> DataFrame:
    """Stages in order: consecutive kernels and fitted steps are one Arrow pass, others are functions of the table."""
    for plain, group in groupby(stages, lambda s: isinstance(s, (Kernel, fitted.FittedStep))):
        if not plain:
            for stage in group:
                df = stage(df)
        else:
            df = run_chains(df, {column: list(group)}, column)
    return df


def run_chains(df: DataFrame, chains: dict[str, list], column: str) -> DataFrame:
    """Each chain of kernels and fitted steps run on *column*, into the column that names it, in one Arrow pass."""
    done = fitted.replay_all(df, {name: [s.run if isinstance(s, Kernel) else s for s in steps] for name, steps in chains.items()}, column)
    if done is not None:
        return done
    for name, steps in sorted(chains.items(), key=lambda c: c[0] == column):  # states too large to broadcast: step by step
        rows = df.withColumn("_kept", F.col(column)) if name != column else df
        for step in steps:
            rows = rows.withColumn(column, kernel_column(column, step.run)) if isinstance(step, Kernel) else step.transform(rows)
        df = rows.withColumn(name, F.col(column)).withColumn(column, F.col("_kept")).drop("_kept") if name != column else rows
    return df


class Kernel:
    """Consecutive per-spectrum steps as one kernel."""

    def __init__(self, steps: Sequence[str], params: dict):
        self.run = chain([spectrum_kernel(s, params) for s in steps])


class Preprocessor(Estimator):
    """Fits a recipe. ``by`` names the keys that have a training set of their own (e.g. task and fold).

    With ``hold_out`` the input holds every row once with its test fold, and each fold's state is fitted on
    the other folds. ``axis`` (dataset, wavenumbers) is needed for ``crop_physical`` only.
    """

    def __init__(self, preprocessing=None, overrides: dict | None = None, *, by: Sequence[str] = (),
                 hold_out: str | None = None, axis: DataFrame | None = None, column: str = "intensities"):
        super().__init__()
        self.params_ = recipe_params(preprocessing, overrides)
        self.by, self.hold_out, self.axis, self.column = list(by), hold_out, axis, column

    @classmethod
    def named(cls, name: str, **kwargs) -> Preprocessor:
        switches, overrides = recipe(name)
        return cls(switches, overrides or None, **kwargs)

    def _fit(self, dataset: DataFrame) -> PreprocessorModel:
        if self.params_["prep_ensemble_enabled"] and self.params_["prep_ensemble_blocks"]:
            blocks = []
            for block in self.params_["prep_ensemble_blocks"]:
                rest = {k: v for k, v in self.params_.items() if not k.endswith("_enabled") and not k.startswith("prep_ensemble")}
                blocks.append(Preprocessor(block, rest, by=self.by, hold_out=self.hold_out, axis=self.axis,
                                           column=self.column)._fit(dataset))
            return PreprocessorModel(self.column, [], blocks=blocks, width=_width(dataset, self.column))
        steps = enabled_steps(self.params_)
        width = _width(dataset, self.column)
        # *df*: the rows so far, that is *since* run on *base*
        stages, run, df, base, since = [], [], dataset, dataset, []
        last = [s for s in steps if s in ("gcu", "lvse")]
        for step in [s for s in steps if s not in last]:
            if step == "crop_physical":
                if self.axis is None:
                    raise ValueError("crop_physical needs the wavenumber axis")
                cut = partial(_crop, axis=self.axis, params=self.params_, column=self.column)
                stages.append(cut)
                df = cut(df)
                base, since = df, []
            elif step in FITTED:
                if run:
                    kernel, run = Kernel(run, self.params_), []
                    stages.append(kernel)
                    since.append(kernel)
                    df = run_stages(base, since, self.column)
                if any(s in COSTLY for s in steps) and len(stages) == 1:
                    df = materialize(df)
                    base, since = df, []
                done = fitted_step(step, self.params_).fit(df, self.by, self.hold_out, self.column)
                stages.append(done)
                since.append(done)
                df = run_stages(base, since, self.column)
            else:
                run.append(step)
        if not last:
            run.append("nan_to_zero")
        if run:
            stages.append(Kernel(run, self.params_))
            df = run_stages(base, [*since, stages[-1]], self.column)
        if last:
            models = [fitted_step(s, self.params_).fit(df, self.by, self.hold_out, self.column) for s in last]
            stages.append(partial(_side_by_side, models=models, column=self.column))
        return PreprocessorModel(self.column, stages, width=width)


def _width(df: DataFrame, column: str) -> tuple[int, int]:
    r = df.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    return r[0], r[1]


def _crop(df: DataFrame, axis: DataFrame, params: dict, column: str) -> DataFrame:
    return crop_physical(df, axis, params["prep_crop_physical_start_cm"], params["prep_crop_physical_end_cm"], column)


def _side_by_side(df: DataFrame, models, column: str) -> DataFrame:
    names = [f"_{column}_{i}" for i in range(len(models))]
    df = run_chains(df, {name: [model] for model, name in zip(models, names)}, column)
    return df.withColumn(column, nan_to_zero(F.concat(*names))).drop(*names)


class PreprocessorModel(Model):
    """A fitted recipe; ``transform`` replays it and never refits."""

    def __init__(self, column: str, stages: list, blocks: list | None = None, width: tuple[int, int] | None = None):
        super().__init__()
        self.column, self.stages, self.blocks, self.width = column, stages, blocks or [], width

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bad = (F.size(self.column) < self.width[0]) | (F.size(self.column) > self.width[1])
        message = f"fitted on {self.width[0]} to {self.width[1]} channels, got another width"
        df = dataset.withColumn(self.column, F.when(bad, F.raise_error(F.lit(message)).cast("array<double>")).otherwise(F.col(self.column)))
        if self.blocks:
            names = [f"_block_{i}" for i in range(len(self.blocks))]
            chains = {name: block.stages for name, block in zip(names, self.blocks)}
            if all(isinstance(s, (Kernel, fitted.FittedStep)) for stages in chains.values() for s in stages):
                df = run_chains(df, chains, self.column)
            else:
                for block, name in zip(self.blocks, names):
                    df = block.replay(df.withColumn(name, F.col(self.column)), name)
            return df.withColumn(self.column, F.concat(*names)).drop(*names)
        return self.replay(df, self.column)

    def replay(self, df: DataFrame, column: str) -> DataFrame:
        """Run the stages on another column of the same content."""
        if column != self.column:
            df = df.withColumnRenamed(self.column, "_kept").withColumnRenamed(column, self.column)
        df = run_stages(df, self.stages, self.column)
        if column != self.column:
            df = df.withColumnRenamed(self.column, column).withColumnRenamed("_kept", self.column)
        return df


def feature_names(names: Sequence[str], width: int) -> list[str]:
    """Input names when the width is unchanged, else ``feature_0``, ``feature_1``, ..."""
    return list(names) if len(names) == width else [f"feature_{i}" for i in range(width)]


# ---------------------------------------------------------------- single-step transformers


def _single(name: str, step: str, arguments: dict[str, tuple[str, object]]):
    """A Preprocessor class with one step on; *arguments* maps its arguments to (parameter, default)."""

    class SingleStep(Preprocessor):
        def __init__(self, **kwargs):
            given = {a: kwargs.pop(a, default) for a, (_, default) in arguments.items()}
            super().__init__({step: True}, {arguments[a][0]: v for a, v in given.items()}, **kwargs)

    SingleStep.__name__ = SingleStep.__qualname__ = name
    return SingleStep


CosmicRayRemoval = _single("CosmicRayRemoval", "cosmic_ray_removal", {
    "threshold": ("prep_crr_threshold", 6), "kernel_size": ("prep_crr_kernel_size", 3)})
Crop = _single("Crop", "crop", {"start": ("prep_crop_start_frac", 0.15), "end": ("prep_crop_end_frac", 0.75)})
PhysicalCrop = _single("PhysicalCrop", "crop_physical", {
    "start_cm": ("prep_crop_physical_start_cm", 400.0), "end_cm": ("prep_crop_physical_end_cm", 1800.0)})
AsLSBaseline = _single("AsLSBaseline", "baseline_correction", {"lam": ("prep_bl_lam", 1e5), "p": ("prep_bl_p", 0.01)})
AirPLSBaseline = _single("AirPLSBaseline", "airpls", {
    "lam": ("prep_airpls_lam", 1e5), "max_iter": ("prep_airpls_max_iter", 15), "tol": ("prep_airpls_tol", 1e-3)})
ArPLSBaseline = _single("ArPLSBaseline", "arpls", {"lam": ("prep_arpls_lam", 1e5), "max_iter": ("prep_arpls_max_iter", 15)})
RubberbandBaseline = _single("RubberbandBaseline", "rubberband", {})
MSC = _single("MSC", "msc", {"start": ("prep_msc_start_frac", 0.0), "end": ("prep_msc_end_frac", 1.0)})
EMSC = _single("EMSC", "emsc", {"poly_order": ("prep_emsc_poly_order", 4)})
SavitzkyGolaySmoothing = _single("SavitzkyGolaySmoothing", "denoising", {
    "window_length": ("prep_denoise_wl", 9), "polyorder": ("prep_denoise_po", 3)})
WaveletDenoising = _single("WaveletDenoising", "wavelet_denoise", {
    "wavelet": ("prep_wavelet_name", "sym7"), "level": ("prep_wavelet_level", 4)})
SavitzkyGolayDerivative = _single("SavitzkyGolayDerivative", "derivative", {
    "deriv": ("prep_deriv_order", 1), "window_length": ("prep_deriv_wl", 11), "polyorder": ("prep_deriv_po", 2)})
SNV = _single("SNV", "snv", {})
VectorNormalization = _single("VectorNormalization", "vecnorm", {})
AveragePooling = _single("AveragePooling", "avgpool", {"size": ("prep_avgpool_size", 5)})
Decimation = _single("Decimation", "decimate", {"step": ("prep_decimate_step", 5)})
GCU = _single("GCU", "gcu", {"rho": ("prep_gcu_rho", 16), "random_state": ("prep_gcu_random_state", 0)})
LVSE = _single("LVSE", "lvse", {"n_regions": ("prep_lvse_n_regions", 16), "k_per_region": ("prep_lvse_k_per_region", 4)})
