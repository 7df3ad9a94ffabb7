"""Estimators on summed cross products against direct fits; neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators import augment as aug
from spectrafold.operators import estimators as est
from spectrafold.operators.knn import cross_val_knn, nearest

FOLD = np.arange(40) % 3


@pytest.fixture(scope="module")
def regression(spectra_df):
    return est.numeric_target(spectra_df)


@pytest.fixture(scope="module")
def classes(spectra_df):
    return est.one_hot(spectra_df)


def predictions(df, column):
    return np.array([r[column] for r in df.orderBy("spectrum_id").collect()])


def by_fold(x, y, fit):
    out = np.empty((len(x), y.shape[1]))
    for f in range(3):
        out[FOLD == f] = fit(x[FOLD != f], y[FOLD != f], x[FOLD == f])
    return out


def target(smooth):
    return (smooth[:, 10] + smooth[:, 30])[:, None]


def test_ridge(regression, smooth):
    def fit(x, y, new):
        mx, my = x.mean(0), y.mean(0)
        return my + (new - mx) @ np.linalg.solve((x - mx).T @ (x - mx) + 0.5 * np.eye(60), (x - mx).T @ (y - my))

    got = predictions(est.cross_val_linear(regression, est.ridge(0.5), False), "y_pred")
    assert np.allclose(got, by_fold(smooth, target(smooth), fit)[:, 0], atol=1e-7)


def test_pcr(regression, smooth):
    def fit(x, y, new):
        mx, my = x.mean(0), y.mean(0)
        _, _, vt = np.linalg.svd(x - mx, full_matrices=False)
        s = (x - mx) @ vt[:5].T
        return my + (new - mx) @ vt[:5].T @ np.linalg.lstsq(s, y - my, rcond=None)[0]

    got = predictions(est.cross_val_linear(regression, est.pcr(5), False), "y_pred")
    assert np.allclose(got, by_fold(smooth, target(smooth), fit)[:, 0], atol=1e-5)


def nipals(x, y, new, k=4):
    mx, my, sx, sy = x.mean(0), y.mean(0), x.std(0, ddof=1), y.std(0, ddof=1)
    e, f = (x - mx) / sx, (y - my) / sy
    w_, p_, q_ = [], [], []
    for _ in range(k):
        u = f[:, :1]
        for _ in range(500):
            w = e.T @ u
            w /= np.linalg.norm(w)
            t = e @ w
            q = f.T @ t / (t.T @ t)
            u = f @ q / (q.T @ q)
        p = e.T @ t / (t.T @ t)
        e, f = e - t @ p.T, f - t @ q.T
        w_.append(w[:, 0]), p_.append(p[:, 0]), q_.append(q[:, 0])
    w, p, q = np.array(w_).T, np.array(p_).T, np.array(q_).T
    b = w @ np.linalg.inv(p.T @ w) @ q.T
    return my + ((new - mx) / sx @ b) * sy


def test_pls(regression, classes, smooth):
    got = predictions(est.cross_val_linear(regression, est.pls(4), False), "y_pred")
    assert np.allclose(got, by_fold(smooth, target(smooth), nipals)[:, 0], atol=1e-5)
    one_hot = np.eye(2)[np.arange(40) % 2]
    got = predictions(est.cross_val_linear(classes, est.pls(3), True), "proba")
    want = by_fold(smooth, one_hot, lambda x, y, n: est.softmax(nipals(x, y, n, 3)))
    assert np.allclose(got, want, atol=1e-5)


def test_pca_lda(classes, smooth):
    labels = np.arange(40) % 2

    def fit(x, y, new):
        lab = y.argmax(1)
        mx = x.mean(0)
        _, _, vt = np.linalg.svd(x - mx, full_matrices=False)
        s, t = (x - mx) @ vt[:6].T, (new - mx) @ vt[:6].T
        m = np.array([s[lab == c].mean(0) for c in (0, 1)])
        pooled = sum((s[lab == c] - m[c]).T @ (s[lab == c] - m[c]) for c in (0, 1)) / (len(s) - 2)
        inv = np.linalg.inv(pooled)
        return est.softmax(t @ inv @ m.T - 0.5 * np.sum(m @ inv * m, axis=1) + np.log([np.mean(lab == c) for c in (0, 1)]))

    got = predictions(est.cross_val_linear(classes, est.pca_lda(6), True), "proba")
    assert np.allclose(got, by_fold(smooth, np.eye(2)[labels], fit), atol=1e-5)


def test_dummy(classes):
    got = predictions(est.cross_val_dummy(classes), "proba")
    for f in range(3):
        assert np.allclose(got[FOLD == f], np.eye(2)[(np.arange(40) % 2)[FOLD != f]].mean(0))


@pytest.mark.parametrize("pivots,block_rows", [(1, 1000), (6, 5), (12, 7)])
def test_nearest_equals_brute_force(spectra_df, smooth, pivots, block_rows):
    got = nearest(spectra_df, 4, pivots=pivots, block_rows=block_rows).collect()
    found = {(r["spectrum_id"], r["position"]): (r["neighbour"], r["distance"]) for r in got}
    assert len(found) == 160
    for i in range(40):
        d = np.where(FOLD != FOLD[i], np.linalg.norm(smooth - smooth[i], axis=1), np.inf)
        for pos, j in enumerate(np.argsort(d, kind="stable")[:4], 1):
            assert found[i, pos][0] == j and abs(found[i, pos][1] - d[j]) < 1e-6


def test_nearest_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(0, 1, (20, 6)) * 1e3, 30, axis=0)  # 30 copies of each: ties go to the smaller id
    x[7], x[11, 2] = np.nan, np.inf
    rows = spark.createDataFrame([("t", 0, i % 3, 1000 - i, v.tolist()) for i, v in enumerate(x)],
                                 "task string, repeat int, fold int, spectrum_id long, intensities array<double>")
    got = {(r["spectrum_id"], r["position"]): r["neighbour"] for r in nearest(rows, 12, pivots=3, block_rows=40).collect()}
    ids, fold, finite = 1000 - np.arange(600), np.arange(600) % 3, np.isfinite(x).all(axis=1)
    want = {}
    for i in np.flatnonzero(finite):
        ok = np.flatnonzero(finite & (fold != fold[i]))
        d = np.sqrt(((x[ok] - x[i]) ** 2).sum(axis=1))
        want |= {(ids[i], p): ids[ok[j]] for p, j in enumerate(np.lexsort((ids[ok], d))[:12], 1)}
    assert got == want


def test_pairs_of_blocks_are_not_shuffled(spark):
    """Small blocks don't multiply: rows meet where they are read, by a product of packed blocks."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([("t", 0, i % 3, i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (3000, 4)))],
                                 "task string, repeat int, fold int, spectrum_id long, intensities array<double>")
    out = nearest(rows, 3, pivots=4, block_rows=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and out.count() == 9000


def test_knn_with_fewer_neighbours_than_k(spectra_df):
    few = est.one_hot(spectra_df.where("spectrum_id < 4"))
    got = {r["spectrum_id"]: r["proba"] for r in cross_val_knn(few, 5).collect()}
    assert np.allclose(got[1], [2 / 3, 1 / 3])  # neighbours 0, 2, 3


def test_cross_validate_reports_failing_folds(regression, classes):
    def fit(x, y):
        if len(x) == 26:  # the two larger training sets have 27 rows
            raise RuntimeError("bad fold")
        return y.mean()

    got = est.cross_validate(regression, fit, lambda m, x: np.full(len(x), m)).toPandas()
    assert got["error"].notna().sum() == 1 and "bad fold" in got.loc[got["error"].notna(), "error"].iloc[0]
    assert len(got) == 27
    labels_only = est.cross_validate(classes, lambda x, y: 0, lambda m, x: np.zeros(len(x)), classify=True).toPandas()
    assert labels_only["error"].str.contains("no probabilities").all()
    small = est.cross_validate(regression, lambda x, y: y.mean(), lambda m, x: np.full(len(x), m), test_rows=4).toPandas()
    assert sorted(small["spectrum_id"]) == list(range(40)) and small["error"].isna().all()


def test_classifiers_learn_from_a_bounded_sample(classes):
    out = est.cross_validate(classes, lambda x, y: len(x), lambda n, x: np.full((len(x), 2), float(n)), classify=True, max_train=9).toPandas()
    assert out["proba"].map(lambda p: p[0]).eq(9).all() and len(out) == classes.count()


def component_rows(spark, shift=0):
    rows = [("t", 0, m, i + (shift if m == "B" else 0), i % 2, [p]) for m, p in (("A", 0.7), ("B", 0.2)) for i in range(6)]
    return spark.createDataFrame(rows, "task string, fold int, model string, spectrum_id long, y_true int, proba array<double>")


def test_cawpe(spark):
    rows = component_rows(spark)
    got = est.cawpe_ensemble(rows, rows, ["A", "B"]).collect()
    assert len(got) == 6 and all(abs(r["proba"][1] - 0.45) < 1e-12 for r in got)  # both right on half the rows
    with pytest.raises(Exception, match="different rows"):
        est.cawpe_ensemble(rows, component_rows(spark, 1), ["A", "B"]).collect()
    assert est.cawpe_ensemble(rows, rows, ["A", "B", "C"]).count() == 0


def test_augmentation(spectra_df, smooth):
    base = spectra_df.select("spectrum_id", "label", "intensities")
    got = aug.augment(base, 2, noise=0.0, shift=3, mixup_alpha=0.5)
    rows = got.toPandas()
    assert rows.groupby("copy").size().to_dict() == {-1: 40, 0: 40, 1: 40, 2: 40}
    for r in rows[rows["copy"] > 0].itertuples():
        x = smooth[r.spectrum_id]
        assert any(np.allclose(r.intensities, x[np.clip(np.arange(60) - s, 0, 59)]) for s in range(-3, 4))
    again = aug.augment(base.repartition(5), 2, noise=0.0, shift=3, mixup_alpha=0.5).toPandas()
    key = ["spectrum_id", "copy"]
    assert np.allclose(np.stack(rows.sort_values(key)["intensities"]), np.stack(again.sort_values(key)["intensities"]))
    noisy = aug.augment(base, 1, noise=0.1).where("copy = 1").orderBy("spectrum_id").toPandas()
    spread = (np.stack(noisy["intensities"]) - smooth).std()
    assert abs(spread / (0.1 * smooth.std()) - 1) < 0.1


def test_mixup_targets(spectra_df, smooth):
    rows = spectra_df.select("spectrum_id", "label", "y", "intensities")
    got = aug.mixup(rows, 0.4, classify=False).toPandas()
    assert len(got) == 40
    for r in got.itertuples():  # y is linear in the spectrum, so it blends along
        assert abs(r.y - (r.intensities[10] + r.intensities[30])) < 1e-9
    same = aug.mixup(rows.drop("y"), 0.4, classify=True).toPandas()
    assert (same.sort_values("spectrum_id")["label"] == [f"c{i % 2}" for i in range(40)]).all()
    tiled = aug.augment_tiled(rows.drop("y"), 3, noise=0.0, shift=1)
    assert tiled.groupBy("copy").agg(F.count(F.lit(1)).alias("n")).toPandas()["n"].tolist() == [40, 40, 40]
