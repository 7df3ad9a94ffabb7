"""Fitted steps: equal to NumPy on the training rows, replayed without refitting, recipes in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.functions import kernels as k
from spectrafold.functions import spectral as native
from spectrafold.functions.batches import apply_kernel, kernel_column
from spectrafold.operators import fitted
from spectrafold.plans import preprocessor as prep
from spectrafold.plans.recipes import RECIPES, STEP_ORDER, enabled_steps, recipe_names, recipe_params, recipe_steps
from tests.conftest import matrix_of

FOLD = np.arange(40) % 3


@pytest.mark.parametrize("make,apply", [
    (lambda: fitted.MSC(), lambda x, tr: k.msc(x, tr.mean(0))),
    (lambda: fitted.EMSC(3), lambda x, tr: k.emsc(x, tr.mean(0), 3)),
    (lambda: fitted.StandardScaler(), lambda x, tr: (x - tr.mean(0)) / tr.std(0)),
])
def test_state_comes_from_the_other_folds(spectra_df, smooth, make, apply):
    got = matrix_of(make().fit(spectra_df, ["task"], "fold").transform(spectra_df))
    for f in range(3):
        assert np.allclose(got[FOLD == f], apply(smooth[FOLD == f], smooth[FOLD != f]), rtol=1e-6, atol=1e-6)


def test_transform_never_refits(spectra_df, smooth):
    step = fitted.StandardScaler().fit(spectra_df.where("fold = 0"))
    got = matrix_of(step.transform(spectra_df.where("fold = 1")))
    tr = smooth[FOLD == 0]
    assert np.allclose(got, (smooth[FOLD == 1] - tr.mean(0)) / tr.std(0))


def test_large_states_meet_rows_in_groups(spectra_df):
    step = fitted.MSC().fit(spectra_df, ["task"], "fold")
    a = matrix_of(step.transform(spectra_df))
    b = matrix_of(fitted.replay(spectra_df, step.state, step.by, step.kernel, limit=0))
    assert np.allclose(a, b)


def test_constant_channel_is_only_centred(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "spectrum_id long, intensities array<double>")
    assert np.allclose(matrix_of(fitted.StandardScaler().fit(df).transform(df)), [[-1, 0], [1, 0]])


def test_lvse_spans_the_singular_subspace(spectra_df, smooth):
    got = matrix_of(fitted.LVSE(4, 2).fit(spectra_df).transform(spectra_df))
    assert got.shape == (40, 8)
    z = (smooth - smooth.mean(0)) / smooth.std(0)
    for i, idx in enumerate(np.array_split(np.arange(60), 4)):
        _, _, vt = np.linalg.svd(z[:, idx], full_matrices=False)
        want = z[:, idx] @ vt[:2].T
        assert np.allclose(np.abs(got[:, 2 * i: 2 * i + 2]), np.abs(want), atol=1e-6)


def test_gcu_is_a_repeatable_nonnegative_factorization(spectra_df, smooth):
    a = fitted.GCU(rho=4, max_iter=6).fit(spectra_df)
    got = matrix_of(a.transform(spectra_df))
    assert got.shape == (40, 4) and (got >= 0).all()
    parts = np.array(a.state.first()["parts"])
    x = smooth - smooth.min()
    assert (parts >= 0).all()
    best = np.linalg.norm(np.linalg.svd(x, compute_uv=False)[4:])  # no rank-4 approximation is closer
    assert best <= np.linalg.norm(x - got @ parts) < 1.1 * best
    assert np.allclose(got, matrix_of(fitted.GCU(rho=4, max_iter=6).fit(spectra_df).transform(spectra_df)))


def test_native_steps_equal_kernels(spectra_df, smooth):
    pairs = {
        "snv": (native.snv, k.snv), "norm": (native.vector_normalize, k.vector_normalize), "crop": (native.crop_fraction, k.crop_fraction),
        "pool": (native.avg_pool, k.avg_pool), "decimate": (native.decimate, k.decimate),
        "bins": (lambda x: native.bin_channels(x, 7), lambda x: k.bin_channels(x, 7)),
    }
    for column, kernel in pairs.values():
        assert np.allclose(matrix_of(spectra_df.withColumn("intensities", column("intensities"))), kernel(smooth))
    reference = F.array(*[F.lit(float(v)) for v in smooth.mean(0)])
    assert np.allclose(matrix_of(spectra_df.withColumn("intensities", native.msc("intensities", reference, 0.2, 0.8))), k.msc(smooth, smooth.mean(0), 0.2, 0.8))


def test_batches_of_mixed_width_and_null(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [4.0, 8.0]), (4, [5.0, 7.0, 9.0])], "spectrum_id long, intensities array<double>")
    got = df.withColumn("intensities", kernel_column("intensities", lambda x: x - x.mean(axis=1, keepdims=True))).orderBy("spectrum_id").collect()
    assert [r["intensities"] for r in got] == [[-1, 0, 1], None, [-2, 2], [-2, 0, 2]]
    assert apply_kernel.__doc__


def test_physical_crop_checks(spark):
    axis = spark.createDataFrame([("d", [800.0, 600.0, 400.0])], "dataset string, wavenumbers array<double>")
    df = spark.createDataFrame([("d", 1, [1.0, 2.0, 3.0])], "dataset string, spectrum_id long, intensities array<double>")
    assert native.crop_physical(df, axis, 400, 600).first()["intensities"] == [2, 3]
    assert native.crop_positions(axis, 500, 900).first()["partial"]
    for low, high in ((900, 1000), (650, 700), (600, 400), (float("nan"), 700)):
        with pytest.raises(ValueError):
            native.crop_physical(df, axis, low, high)


# ---------------------------------------------------------------- recipes


def test_recipes_resolve_and_run_in_order():
    assert len(recipe_names()) == 26
    for name in recipe_names():
        if name != "prep_ensemble":
            steps = recipe_steps(name)
            assert steps == sorted(steps, key=STEP_ORDER.index)
            assert set(steps) == set(RECIPES[name][0])
    with pytest.raises(ValueError):
        recipe_steps("prep_ensemble")
    with pytest.raises(KeyError):
        recipe_steps("nothing")


def test_recipe_params_precedence():
    p = recipe_params({"derivative": True}, {"prep_deriv_order": 2})
    assert p["prep_deriv_enabled"] and p["prep_deriv_order"] == 2 and not p["prep_snv_enabled"]
    assert enabled_steps(recipe_params({"snv": True, "crop": True})) == ["crop", "snv"]
    everything = recipe_params(True)
    assert not everything["prep_crop_physical_enabled"] and everything["prep_lvse_enabled"] and not everything["prep_aug_enabled"]
    for bad in ({"prep_snv_enabled": False}, {"prep_unknown": 1}):
        with pytest.raises(ValueError):
            recipe_params({"snv": True}, bad)
    with pytest.raises(ValueError):
        recipe_params({"avgpool": True, "decimate": True})


def test_recipe_equals_its_kernels(spectra_df, smooth):
    got = matrix_of(prep.Preprocessor.named("bc_sg_snv").fit(spectra_df).transform(spectra_df))
    assert np.allclose(got, k.snv(k.baseline_asls(k.savgol(smooth))), atol=1e-8)
    got = matrix_of(prep.Preprocessor.named("bc_sg_msc").fit(spectra_df).transform(spectra_df))
    x = k.baseline_asls(k.savgol(smooth))
    assert np.allclose(got, k.msc(x, x.mean(0)), atol=1e-6)


def test_ensemble_blocks_stand_side_by_side(spectra_df, smooth):
    got = matrix_of(prep.Preprocessor.named("prep_ensemble").fit(spectra_df).transform(spectra_df))
    want = np.concatenate([k.snv(smooth), k.emsc(smooth, smooth.mean(0)), k.snv(k.baseline_airpls(smooth)), smooth], axis=1)
    assert np.allclose(got, want, atol=1e-6)


def test_gcu_and_lvse_are_concatenated(spectra_df):
    model = prep.Preprocessor({"gcu": True, "lvse": True}, {"prep_gcu_rho": 3, "prep_lvse_n_regions": 2, "prep_lvse_k_per_region": 2}).fit(spectra_df)
    assert matrix_of(model.transform(spectra_df)).shape == (40, 7)


def test_constant_rows_become_zero_and_widths_are_checked(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, [1.0, 2.0, 3.0])], "spectrum_id long, intensities array<double>")
    model = prep.SNV().fit(df)
    assert np.allclose(matrix_of(model.transform(df))[0], 0)
    with pytest.raises(Exception, match="another width"):
        model.transform(df.withColumn("intensities", F.slice("intensities", 1, 2))).collect()
    assert prep.feature_names(["a", "b"], 2) == ["a", "b"] and prep.feature_names(["a"], 2) == ["feature_0", "feature_1"]


def test_single_step_transformers(spectra_df, smooth):
    got = matrix_of(prep.SavitzkyGolayDerivative(deriv=2, window_length=15).fit(spectra_df).transform(spectra_df))
    assert np.allclose(got, k.savgol(smooth, 15, 2, 2))
    got = matrix_of(prep.AveragePooling(size=4).fit(spectra_df).transform(spectra_df))
    assert np.allclose(got, k.avg_pool(smooth, 4))


def test_large_offsets_cost_no_digits(spark, spectra_df, smooth):
    from spectrafold.operators import estimators as est

    rows = est.numeric_target(spectra_df)
    far = rows.withColumn("intensities", F.transform("intensities", lambda v: v + 1e6))
    a, b = (est.cross_val_linear(x, est.ridge(1.0), classify=False).orderBy("spectrum_id").toPandas()["y_pred"].to_numpy() for x in (rows, far))
    assert np.allclose(a, b, atol=1e-6)


def test_gcu_by_fold_uses_the_other_folds(spectra_df):
    step = fitted.GCU(rho=3, max_iter=8).fit(spectra_df, ["task"], "fold")
    state = {r["fold"]: r for r in step.state.collect()}
    assert sorted(state) == [0, 1, 2] and all(isinstance(r["converged"], bool) for r in state.values())
    alone = fitted.GCU(rho=3, max_iter=8).fit(spectra_df.where("fold <> 1"), ["task"]).state.first()
    assert np.allclose(np.array(alone["parts"]), np.array(state[1]["parts"]))
    assert step.transform(spectra_df).count() == spectra_df.count()


@pytest.mark.parametrize("name", ["all", "prep_ensemble"])
def test_a_recipe_is_one_pass(spectra_df, name, monkeypatch):
    """One Python worker for a task replays all steps and blocks; slices and step by step give the same values."""
    model = prep.Preprocessor.named(name, by=["task"], hold_out="fold").fit(spectra_df)
    out = model.transform(spectra_df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    whole = matrix_of(out)
    monkeypatch.setattr(fitted, "SLICE_BYTES", 1000)
    assert np.allclose(matrix_of(model.transform(spectra_df)), whole, rtol=1e-9, atol=1e-9)
    monkeypatch.setattr(fitted, "replay_all", lambda *a, **k: None)
    assert np.allclose(matrix_of(model.transform(spectra_df)), whole, rtol=1e-9, atol=1e-9)
