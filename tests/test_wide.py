"""Linear models fitted by passes over the rows against those fitted on whole matrices of cross products."""

import numpy as np
import pytest

from spectrafold.operators import estimators as est
from spectrafold.operators import wide
from tests.test_estimators import by_fold, nipals, predictions


@pytest.fixture(scope="module")
def regression(spectra_df):
    return est.numeric_target(spectra_df)


@pytest.fixture(scope="module")
def classes(spectra_df):
    return est.one_hot(spectra_df)


@pytest.mark.parametrize("name,k", [("ridge", 0.5), ("pcr", 5), ("pls", 4)])
def test_regressors(regression, name, k):
    got = predictions(wide.cross_val_wide(regression, getattr(wide, name)(k), False), "y_pred")
    assert np.allclose(got, predictions(est.cross_val_linear(regression, getattr(est, name)(k), False), "y_pred"), atol=1e-7)


@pytest.mark.parametrize("name,k", [("ridge", 0.5), ("pcr", 5), ("pls", 3), ("pca_lda", 6)])
def test_classifiers(classes, name, k):
    got = predictions(wide.cross_val_wide(classes, getattr(wide, name)(k), True), "proba")
    assert np.allclose(got, predictions(est.cross_val_linear(classes, getattr(est, name)(k), True), "proba"), atol=1e-7)


@pytest.fixture(scope="module")
def long_spectra(spark):
    """40 spectra of 3,000 channels: a few smooth directions and noise."""
    rng = np.random.default_rng(3)
    t = np.linspace(0, 1, 3000)
    x = rng.normal(size=(40, 6)) @ np.array([np.sin((j + 1) * 5 * t) * 3.0 / (j + 1) for j in range(6)]) + 0.05 * rng.normal(size=(40, 3000))
    y = x[:, 100] - 2 * x[:, 2000]
    rows = [("t", 0, i % 3, i, v.tolist(), "c", float(w)) for i, (v, w) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "task string, repeat int, fold int, spectrum_id long, intensities array<double>, label string, y double")
    return x, y[:, None], est.numeric_target(df.repartition(5)).cache()


def test_more_channels_than_rows(long_spectra):
    x, y, rows = long_spectra

    def dual(x, y, new):
        c = x - x.mean(0)
        return y.mean(0) + (new - x.mean(0)) @ c.T @ np.linalg.solve(c @ c.T + 2.0 * np.eye(len(c)), y - y.mean(0))

    got = predictions(wide.cross_val_wide(rows, wide.ridge(2.0), False), "y_pred")
    assert np.allclose(got, by_fold(x, y, dual)[:, 0], atol=1e-8)
    got = predictions(wide.cross_val_wide(rows, wide.pls(4), False), "y_pred")
    assert np.allclose(got, by_fold(x, y, nipals)[:, 0], atol=1e-6)

    def components(x, y, new):
        _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
        s = (x - x.mean(0)) @ vt[:6].T
        return y.mean(0) + (new - x.mean(0)) @ vt[:6].T @ np.linalg.lstsq(s, y - y.mean(0), rcond=None)[0]

    got = predictions(wide.cross_val_wide(rows, wide.pcr(6, block=4), False), "y_pred")
    assert np.allclose(got, by_fold(x, y, components)[:, 0], atol=1e-6)


def test_vectors_too_large_to_broadcast(regression):
    one = predictions(wide.cross_val_wide(regression, wide.pcr(5), False), "y_pred")
    other = predictions(wide.cross_val_wide(regression.repartition(7), wide.pcr(5, block=6), False, broadcast_bytes=0), "y_pred")
    assert np.allclose(one, other, atol=1e-8)


def test_too_few_passes_raise(regression):
    with pytest.raises(RuntimeError, match="3 fits need more than 2 passes"):
        wide.fit_wide(regression, wide.pls(4), passes=2)


def test_blocks_are_bounded(long_spectra):
    _, _, rows = long_spectra
    blocks = wide.packed(rows.coalesce(1), ["task", "repeat", "fold"], "intensities", limit=100_000).collect()
    assert max(len(b["x"]) for b in blocks) < 124_000 and sum(b["rows"] for b in blocks) == 40


def test_several_keys_and_spectra_without_variance(spark):
    data = [(t, 0, i % 2, i, [float(i if t == "a" else 1), 2.0, float(i * i if t == "a" else 5)], float(i)) for t in ("a", "b") for i in range(8)]
    rows = est.numeric_target(spark.createDataFrame(data, "task string, repeat int, fold int, spectrum_id long, intensities array<double>, y double"))
    for name, k in (("ridge", 1.0), ("pcr", 2), ("pls", 2)):
        got = {(r["task"], r["spectrum_id"]): r["y_pred"] for r in wide.cross_val_wide(rows, getattr(wide, name)(k), False).collect()}
        for r in est.cross_val_linear(rows, getattr(est, name)(k), False).collect() if name != "pcr" else []:
            assert abs(got[r["task"], r["spectrum_id"]] - r["y_pred"]) < 1e-7
        assert len(got) == 16
        assert all(abs(got["b", i] - (4.0 if i % 2 == 0 else 3.0)) < 1e-9 for i in range(8))  # the mean of the other fold


def test_no_rows(spark, regression):
    assert wide.fit_wide(regression.where("false"), wide.ridge(1.0)).count() == 0
