import numpy as np
import pytest

from spectrafold.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def rng():
    return np.random.default_rng(7)


@pytest.fixture(scope="session")
def smooth():
    """Smooth positive spectra with peaks, 40 rows of 60 channels."""
    rng = np.random.default_rng(1)
    t = np.linspace(0, 1, 60)
    rows = [2 + a * t + np.exp(-((t - c) ** 2) / 0.003) * h + rng.normal(0, 0.01, 60)
            for a, c, h in zip(rng.uniform(0, 3, 40), rng.uniform(0.2, 0.8, 40), rng.uniform(1, 2, 40))]
    return np.array(rows)


@pytest.fixture(scope="session")
def spectra_df(spark, smooth):
    """The smooth spectra as rows: task, repeat, fold, spectrum_id, intensities, label, y."""
    rows = [("t", 0, i % 3, i, x.tolist(), f"c{i % 2}", float(x[10] + x[30])) for i, x in enumerate(smooth)]
    return spark.createDataFrame(
        rows, "task string, repeat int, fold int, spectrum_id long, intensities array<double>, label string, y double").cache()


def matrix_of(df, column="intensities", order="spectrum_id"):
    return np.array([r[column] for r in df.orderBy(order).collect()])
