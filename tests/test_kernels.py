"""NumPy kernels against dense, direct formulations and invariants."""

import numpy as np
import pytest

from spectrafold.functions import kernels as k


def second_differences(n):
    return np.diff(np.eye(n), 2, axis=0)


def test_smoother_solves_the_dense_system(rng):
    n = 37
    w, y = rng.uniform(0.01, 1, (n, 4)), rng.normal(size=(n, 4))
    d = second_differences(n)
    z = k.Smoother(n, 1e4).solve(w, y)
    for j in range(4):
        assert np.allclose(z[:, j], np.linalg.solve(np.diag(w[:, j]) + 1e4 * d.T @ d, w[:, j] * y[:, j]), rtol=1e-8)


@pytest.mark.parametrize("n", [3, 4, 5])
def test_smoother_on_tiny_spectra(n, rng):
    d, y = second_differences(n), rng.normal(size=(n, 2))
    z = k.Smoother(n, 10.0).solve(np.ones_like(y), y)
    assert np.allclose(z, np.linalg.solve(np.eye(n) + 10.0 * d.T @ d, y))


def test_asls_matches_direct_reweighting(smooth):
    n = smooth.shape[1]
    d = second_differences(n)
    got = k.baseline_asls(smooth, 1e4, 0.01)
    for y, out in zip(smooth[:5], got):
        w = np.ones(n)
        for _ in range(10):
            z = np.linalg.solve(np.diag(w) + 1e4 * d.T @ d, w * y)
            w = np.where(y > z, 0.01, 0.99)
        assert np.allclose(out, y - z, atol=1e-8)
    assert np.array_equal(k.baseline_asls(smooth, 0.0), smooth)


def test_airpls_matches_direct_reweighting(smooth):
    n = smooth.shape[1]
    d = second_differences(n)
    got = k.baseline_airpls(smooth, 1e3, 15, 1e-3)
    for y, out in zip(smooth[:6], got):
        w = np.ones(n)
        for t in range(1, 16):
            r = y - np.linalg.solve(np.diag(w) + 1e3 * d.T @ d, w * y)
            total = abs(r[r < 0].sum())
            if total < 1e-3 * np.abs(y).sum() or t == 15:
                break
            w = np.where(r < 0, np.exp(t * np.minimum(r, 0) / total), 0.0)
        assert np.allclose(out, r, atol=1e-7)
    assert np.allclose(k.baseline_airpls(np.zeros((2, 20))), 0)


def test_arpls_removes_drift(smooth):
    got = k.baseline_arpls(smooth, 1e4)
    assert np.isfinite(got).all()
    assert np.abs(np.median(got, axis=1)).max() < 0.2  # the drift (up to 5) is gone


def test_rubberband_is_the_lower_hull(smooth):
    got = k.baseline_rubberband(smooth)
    assert got.min() > -1e-9
    assert np.allclose(got[:, [0, -1]], 0)
    y = smooth[0]
    n = len(y)
    low = [min(y[i] + (y[j] - y[i]) * (c - i) / max(j - i, 1) for i in range(c + 1) for j in range(c, n)) for c in range(n)]
    assert np.allclose(got[0], y - np.array(low))


@pytest.mark.parametrize("deriv,poly", [(0, 3), (1, 2), (2, 3)])
def test_savgol_reproduces_polynomials(deriv, poly):
    t = np.arange(40.0)
    p = np.poly1d(np.arange(1.0, poly + 2))
    got = k.savgol(p(t)[None, :], 9, poly, deriv)
    assert np.allclose(got[0], np.polyder(p, deriv)(t) if deriv else p(t), rtol=1e-7, atol=1e-6)


def test_savgol_known_taps_and_window_rules(rng):
    x = rng.normal(size=(3, 30))
    taps = np.array([-21, 14, 39, 54, 59, 54, 39, 14, -21]) / 231
    assert np.allclose(k.savgol(x, 9, 3)[:, 15], x[:, 11:20] @ taps)
    assert np.allclose(k.savgol(x, 8, 3), k.savgol(x, 9, 3))  # even window + 1
    with pytest.raises(ValueError):
        k.savgol(x, 31, 3)


@pytest.mark.parametrize("name", sorted(k.WAVELETS))
def test_wavelets_are_orthonormal_and_reconstruct(name, rng):
    low, high = k.wavelet_filters(name)
    assert abs(low.sum() - np.sqrt(2)) < 1e-10
    for shift in range(len(low) // 2):
        assert abs(low[2 * shift:] @ low[: len(low) - 2 * shift] - (shift == 0)) < 1e-10
    for n in (31, 64, 101):
        x = rng.normal(size=(2, n))
        a, d = k._analyse(x, low), k._analyse(x, high)
        assert a.shape[1] == (n + len(low) - 1) // 2
        assert np.allclose((k._synthesise(a, low[::-1]) + k._synthesise(d, high[::-1]))[:, :n], x, atol=1e-9)


def test_wavelet_denoise_lowers_noise(rng):
    t = np.linspace(0, 1, 256)
    clean = np.sin(4 * np.pi * t)[None, :].repeat(4, 0)
    noisy = clean + rng.normal(0, 0.1, clean.shape)
    assert np.abs(k.wavelet_denoise(noisy) - clean).mean() < 0.6 * np.abs(noisy - clean).mean()


def test_despike_replaces_spikes_only(rng):
    x = np.sin(np.linspace(0, 3, 100))[None, :].repeat(3, 0) + rng.normal(0, 0.01, (3, 100))
    spiked = x.copy()
    spiked[1, 50] += 30
    got = k.despike(spiked)
    assert np.array_equal(got[0], x[0]) and np.array_equal(got[2], x[2])
    assert abs(got[1, 50]) < 15
    assert np.array_equal(k.despike(np.ones((2, 9))), np.ones((2, 9)))  # MAD 0


def test_scaling_and_pooling():
    x = np.arange(12.0)[None, :]
    assert np.allclose(k.avg_pool(x, 5), [[2, 7]])
    assert np.array_equal(k.decimate(x, 5), [[0, 5]])
    assert k.bin_channels(x, 5).shape == (1, 5)
    assert k.bin_channels(x, 12) is x
    s = k.snv(x)
    assert abs(s.mean()) < 1e-12 and abs(s.std() - 1) < 1e-12
    assert np.isnan(k.snv(np.ones((1, 4)))).all()
    assert np.array_equal(k.nan_to_zero(k.snv(np.ones((1, 4)))), np.zeros((1, 4)))
    assert np.array_equal(k.vector_normalize(np.zeros((1, 4))), np.zeros((1, 4)))
    with pytest.raises(ValueError):
        k.avg_pool(x, 13)


def test_crop_fraction_rounds_half_to_even():
    assert k.crop_fraction(np.zeros((1, 10)), 0.25, 0.75).shape[1] == 6  # round(2.5) = 2, round(7.5) = 8
    assert k.crop_fraction(np.zeros((1, 10)), 0.99, 0.99).shape[1] == 1


def test_emsc_removes_polynomials(rng):
    reference = rng.normal(size=50)
    w = np.linspace(-1, 1, 50)
    x = 3 * reference + 2 + w - 4 * w**2
    assert np.allclose(k.emsc(x[None, :], reference, 4)[0], reference)
    assert np.allclose(k.msc((2 * reference + 1)[None, :], reference)[0], reference)


def test_nonneg_weights_meet_the_optimality_conditions(rng):
    parts, x = rng.random((4, 30)), rng.normal(size=(20, 30))
    w = k.nonneg_weights(x, parts, sweeps=2000, tol=1e-14)
    slope = (w @ parts - x) @ parts.T
    assert (w >= 0).all()
    assert (slope > -1e-6).all() and np.abs(slope * w).max() < 1e-6


def precise_airpls(y, lam, max_iter=15, tol=1e-3):
    """airPLS with 60 decimal digits (banded elimination), for one spectrum."""
    from decimal import Decimal, localcontext

    with localcontext() as context:
        context.prec = 60
        n, lam, y = len(y), Decimal(lam), [Decimal(float(v)) for v in y]
        penalty = [[Decimal(0)] * 3 for _ in range(n)]  # diagonals of lam * D'D
        for i in range(n - 2):
            for a, u in enumerate((1, -2, 1)):
                for b, v in enumerate((1, -2, 1)):
                    if b >= a:
                        penalty[i + a][b - a] += lam * u * v
        w, size = [Decimal(1)] * n, sum(abs(v) for v in y)
        for t in range(1, max_iter + 1):
            m = [[penalty[i][0] + w[i], penalty[i][1], penalty[i][2]] for i in range(n)]
            z = [w[i] * y[i] for i in range(n)]
            for i in range(n):
                for step in (1, 2):
                    if i + step < n:
                        f = m[i][step] / m[i][0]
                        m[i + step][0] -= f * m[i][step]
                        if step == 1 and i + 2 < n:
                            m[i + 1][1] -= f * m[i][2]
                        z[i + step] -= f * z[i]
            for i in range(n - 1, -1, -1):
                z[i] = (z[i] - sum(m[i][s] * z[i + s] for s in (1, 2) if i + s < n)) / m[i][0]
            residual = [a - b for a, b in zip(y, z)]
            on_it = Decimal("1e-10") * max(abs(v) for v in y)
            negative = abs(sum(v for v in residual if v < -on_it))
            if negative < Decimal(tol) * size or sum(v < -on_it for v in residual) < 2 or t == max_iter:
                return [float(v) for v in residual]
            w = [(Decimal(t) * v / negative).exp() if v < -on_it else Decimal(0) for v in residual]


def test_baselines_on_hard_spectra():
    """Spectra on which few weights stay positive: the plain normal equations lose them."""
    import duckdb

    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.array([r[1] for r in rows], float)
    with np.errstate(all="raise", under="ignore"):
        for lam in (1e5, 1e9):
            got = k.baseline_airpls(x, lam)
            assert np.isfinite(got).all()
            for i in (282, 567, 783, 1619, *range(0, 2000, 250)):
                assert np.abs(got[i] - precise_airpls(x[i], lam)).max() < 1e-6
        for lam in (1e5, 1e9):
            w = np.random.default_rng(0).random((64, 20)) ** 8
            z = k.Smoother(64, lam).solve(w, np.ascontiguousarray(x[:20].T))
            bend = np.diff(np.eye(64), 2, axis=0) * lam**0.5
            for j in range(20):
                rows_ = np.vstack([np.diag(np.sqrt(w[:, j])), bend])
                want = np.linalg.lstsq(rows_, np.r_[np.sqrt(w[:, j]) * x[j], np.zeros(62)], rcond=None)[0]
                assert np.abs(z[:, j] - want).max() < 1e-6
            assert np.isfinite(k.baseline_asls(x, lam)).all() and np.isfinite(k.baseline_arpls(x, lam)).all()
