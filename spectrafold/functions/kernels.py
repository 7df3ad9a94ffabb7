"""NumPy kernels over a batch of spectra (rows x channels), run inside Arrow batches by Spark tasks.

Every kernel works on the whole batch at once; only despiking of flagged rows loops over rows.
"""

from __future__ import annotations

import math

import numpy as np

from spectrafold.functions.spectral import fraction_bounds

# ---------------------------------------------------------------- cropping, scaling, pooling


def crop_fraction(x: np.ndarray, start: float = 0.15, end: float = 0.75) -> np.ndarray:
    first, last = fraction_bounds(x.shape[1], start, end)
    return x[:, first:last]


def snv(x: np.ndarray) -> np.ndarray:
    centred = x - x.mean(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return centred / np.sqrt((centred**2).mean(axis=1, keepdims=True))


def vector_normalize(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1.0, norm)


def avg_pool(x: np.ndarray, size: int = 5) -> np.ndarray:
    runs = x.shape[1] // size
    if runs < 1:
        raise ValueError(f"cannot pool {x.shape[1]} channels with window {size}")
    return x[:, : runs * size].reshape(len(x), runs, size).mean(axis=2)


def decimate(x: np.ndarray, step: int = 5) -> np.ndarray:
    runs = x.shape[1] // step
    if runs < 1:
        raise ValueError(f"cannot decimate {x.shape[1]} channels with step {step}")
    return x[:, : runs * step : step]


def bin_channels(x: np.ndarray, n_bins: int) -> np.ndarray:
    p = x.shape[1]
    if p <= n_bins:
        return x
    edges = np.rint(np.linspace(0, p, n_bins + 1)).astype(int)
    return np.add.reduceat(x, edges[:-1], axis=1) / np.diff(edges)


def nan_to_zero(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0.0, x)


# ---------------------------------------------------------------- despiking


def despike(x: np.ndarray, threshold: float = 6.0, kernel: int = 3) -> np.ndarray:
    """Points whose first difference is an outlier (modified z-score) become the mean of unflagged neighbours.

    Scores are computed once. All spectra move from channel to channel together: a flagged channel is replaced where a
    neighbour within *kernel* is clean, and counts as clean from then on; passes repeat while flags disappear.
    """
    step = np.diff(x, axis=1)
    centre = step - np.median(step, axis=1, keepdims=True)
    mad = np.median(np.abs(centre), axis=1, keepdims=True)
    scaled = 0.6745 * np.abs(centre) / np.where(mad > 0, mad, 1.0)
    hit = (scaled > threshold) & (mad > 0)
    rows, last = np.flatnonzero(hit.any(axis=1)), x.shape[1] - 1  # the last channel has no difference and is no neighbour
    out = x.copy()
    y, dirty = out[rows], hit[rows]
    left = dirty.sum()
    while left:
        for i in np.flatnonzero(dirty.any(axis=0)):
            low, high = max(0, i - kernel), min(last, i + 1 + kernel)
            clean = ~dirty[:, low:high]
            count = clean.sum(axis=1)
            now = dirty[:, i] & (count > 0)
            y[now, i] = np.where(clean, y[:, low:high], 0.0).sum(axis=1)[now] / count[now]
            dirty[now, i] = False
        before, left = left, dirty.sum()
        if left == before:
            break
    out[rows] = y
    return out


# ---------------------------------------------------------------- Savitzky-Golay


def _polynomial_fit(window: int, poly: int, deriv: int) -> tuple[np.ndarray, np.ndarray]:
    """(interior taps, edge operator): the *deriv*-th derivative of the window's polynomial fit.

    Row i of the edge operator evaluates the fit at window position i.
    """
    t = np.arange(window) - window // 2
    scale = max(window // 2, 1)
    fit = np.linalg.pinv(np.vander(t / scale, poly + 1, increasing=True))  # samples -> coefficients
    powers = np.arange(poly + 1)
    factor = np.array([math.perm(k, deriv) for k in powers], dtype=float) / float(scale) ** deriv
    exponent = np.maximum(powers - deriv, 0)
    design = (t[:, None] / scale) ** exponent[None, :] * factor[None, :]
    operator = design @ fit
    return operator[window // 2], operator


def savgol(x: np.ndarray, window: int = 9, poly: int = 3, deriv: int = 0) -> np.ndarray:
    """Savitzky-Golay filter; the edge channels come from the polynomial of the first / last window."""
    window, poly = int(window), int(poly)
    window += 1 - window % 2
    poly = min(poly, window - 1)
    poly = max(poly, deriv)
    n = x.shape[1]
    if window > n:
        raise ValueError(f"window {window} is wider than the spectrum ({n} channels)")
    taps, operator = _polynomial_fit(window, poly, deriv)
    half = window // 2
    out = np.empty(x.shape, dtype=float)
    inner = np.zeros((len(x), n - window + 1))
    for j, tap in enumerate(taps):
        inner += tap * x[:, j : j + n - window + 1]
    out[:, half : n - half] = inner
    out[:, :half] = x[:, :window] @ operator[:half].T
    out[:, n - half :] = x[:, n - window :] @ operator[window - half :].T
    return out


def savgol_derivative(x: np.ndarray, window: int = 11, poly: int = 2, deriv: int = 1) -> np.ndarray:
    return savgol(x, window, poly, int(deriv))


# ---------------------------------------------------------------- wavelets

# Decomposition low-pass filters of orthogonal wavelets (published constants).
WAVELETS = {
    "db6": (
        -0.00107730108499558, 0.004777257511010651, 0.0005538422009938016, -0.031582039318031156,
        0.02752286553001629, 0.09750160558707936, -0.12976686756709563, -0.22626469396516913,
        0.3152503517092432, 0.7511339080215775, 0.4946238903983854, 0.11154074335008017,
    ),
    "sym7": (
        0.002681814568257878, -0.0010473848886829163, -0.01263630340325193, 0.03051551316596357,
        0.0678926935013727, -0.049552834937127255, 0.017441255086855827, 0.5361019170917628,
        0.767764317003164, 0.2886296317515146, -0.14004724044296152, -0.10780823770381774,
        0.004010244871533663, 0.010268176708511255,
    ),
    "sym8": (
        -0.0033824159510061256, -0.0005421323317911481, 0.03169508781149298, 0.007607487324917605,
        -0.1432942383508097, -0.061273359067658524, 0.4813596512583722, 0.7771857517005235,
        0.3644418948353314, -0.05194583810770904, -0.027219029917056003, 0.049137179673607506,
        0.003808752013890615, -0.01495225833704823, -0.0003029205147213668, 0.0018899503327594609,
    ),
}


def wavelet_filters(name: str) -> tuple[np.ndarray, np.ndarray]:
    """(low-pass, high-pass) decomposition filters; reconstruction uses the same filters reversed."""
    low = np.array(WAVELETS[name])
    high = low[::-1] * np.where(np.arange(len(low)) % 2 == 0, -1.0, 1.0)
    return low, high


def _analyse(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    f, n = len(taps), x.shape[1]
    padded = np.pad(x, ((0, 0), (f - 1, f - 1)), mode="symmetric")
    m = (n + f - 1) // 2
    out = np.zeros((len(x), m))
    for j, tap in enumerate(taps):
        first = f - j  # channel 1 - j of the unpadded spectrum
        out += tap * padded[:, first : first + 2 * m : 2][:, :m]
    return out


def _synthesise(coefficients: np.ndarray, taps: np.ndarray) -> np.ndarray:
    f, m = len(taps), coefficients.shape[1]
    full = np.zeros((len(coefficients), 2 * m + f - 1))
    for j, tap in enumerate(taps):
        full[:, j : j + 2 * m : 2] += tap * coefficients
    return full[:, f - 2 : 2 * m]


def wavelet_denoise(x: np.ndarray, wavelet: str = "sym7", level: int = 4) -> np.ndarray:
    """Soft threshold of the detail coefficients at sigma * sqrt(2 ln n), sigma from the finest details' MAD."""
    low, high = wavelet_filters(wavelet)
    n, f = x.shape[1], len(low)
    deepest = int(math.floor(math.log2(n / (f - 1)))) if n >= f - 1 else 0
    approx, details = x, []
    for _ in range(max(1, min(int(level), deepest))):
        details.append(_analyse(approx, high))
        approx = _analyse(approx, low)
    sigma = np.median(np.abs(details[0]), axis=1, keepdims=True) / 0.6745
    limit = sigma * math.sqrt(2.0 * math.log(n))
    for d in reversed(details):
        kept = np.sign(d) * np.maximum(np.abs(d) - limit, 0.0)
        approx = approx[:, : d.shape[1]]
        approx = _synthesise(approx, low[::-1]) + _synthesise(kept, high[::-1])
    return approx[:, :n]


# ---------------------------------------------------------------- baselines


class Smoother:
    """Minimises sum(w * (y - z)^2) + lam * sum((D z)^2) for a batch; D takes second differences.

    The least-squares rows themselves are brought to triangular form by rotations, channel by channel, all spectra of the
    batch in each step: the error then follows the condition of the rows, not its square, so a fit that only a few weights
    hold in place stays exact. Two refinement steps on the residual of the normal equations remove what is left. Arrays are
    channels x spectra, so steps are contiguous.
    """

    def __init__(self, n: int, lam: float):
        self.n, self.lam, self.root = n, lam, math.sqrt(lam)

    def solve(self, w: np.ndarray, y: np.ndarray) -> np.ndarray:
        r0, r1, r2 = self._factor(np.sqrt(w))
        z = self._apply(r0, r1, r2, w * y)
        for _ in range(2):
            z = z + self._apply(r0, r1, r2, w * (y - z) - self.lam * self._penalty(z))
        return z

    @staticmethod
    def _penalty(z: np.ndarray) -> np.ndarray:
        """D'D z."""
        out = np.zeros_like(z)
        if len(z) >= 3:
            bend = z[:-2] - 2 * z[1:-1] + z[2:]
            out[:-2] += bend
            out[1:-1] -= 2 * bend
            out[2:] += bend
        return out

    def _factor(self, root_w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The three diagonals of the triangular factor. Between channels two rows are open: (a, b) and (0, c)."""
        n, zero = self.n, np.zeros(root_w.shape[1])
        r0, r1, r2 = (np.zeros_like(root_w) for _ in range(3))
        a, b, c = zero, zero, zero
        for i in range(n):
            # rows with an entry in channel i: the data row (root_w), (a, b), and the penalty row, if there is one left
            top = [np.hypot(root_w[i], a), None, zero]
            cos, sin = self._rotation(a, root_w[i], top[0])
            top[1], left = cos * b, -sin * b  # the rest of the data row
            if i + 2 < n:
                k = self.root
                length = np.hypot(top[0], k)
                cos, sin = top[0] / length, k / length
                rest1, rest2 = cos * -2 * k - sin * top[1], cos * k
                r0[i], r1[i], r2[i] = length, cos * top[1] + sin * -2 * k, sin * k
                a, b = rest1, rest2
            else:
                r0[i], r1[i] = top[0], top[1]
                a, b = zero, zero
            # what is left has entries in channels i + 1 and i + 2: (left, 0), (c, 0), (a, b)
            below = np.hypot(left, c)
            length = np.hypot(a, below)
            cos, sin = self._rotation(a, below, length)
            a, b, c = length, cos * b, -sin * b
        return r0, r1, r2

    @staticmethod
    def _rotation(x: np.ndarray, y: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        safe = np.where(length > 0, length, 1.0)
        return np.where(length > 0, x / safe, 1.0), y / safe

    def _apply(self, r0: np.ndarray, r1: np.ndarray, r2: np.ndarray, rhs: np.ndarray) -> np.ndarray:
        """Solves R'R z = rhs."""
        n, z = self.n, np.empty_like(rhs)
        inverse = np.where(r0 != 0, 1.0 / np.where(r0 != 0, r0, 1.0), 0.0)
        for i in range(n):
            t = rhs[i]
            if i >= 1:
                t = t - r1[i - 1] * z[i - 1]
            if i >= 2:
                t = t - r2[i - 2] * z[i - 2]
            z[i] = t * inverse[i]
        for i in range(n - 1, -1, -1):
            t = z[i]
            if i + 1 < n:
                t = t - r1[i] * z[i + 1]
            if i + 2 < n:
                t = t - r2[i] * z[i + 2]
            z[i] = t * inverse[i]
        return z


def baseline_asls(x: np.ndarray, lam: float = 1e5, p: float = 0.01, n_iter: int = 10) -> np.ndarray:
    """Asymmetric least squares baseline: weight p above the baseline, 1 - p on and below it."""
    if not (lam > 0 and 0 < p < 1):
        return x
    y = np.ascontiguousarray(x.T)
    smoother, w = Smoother(len(y), lam), np.ones_like(y)
    for _ in range(n_iter):
        z = smoother.solve(w, y)
        w = np.where(y > z, p, 1 - p)
    return (y - z).T


#: Distance from the baseline, as a share of the largest value, within which a point is on it.
ON_IT = 1e-10


def baseline_airpls(x: np.ndarray, lam: float = 1e5, max_iter: int = 15, tol: float = 1e-3) -> np.ndarray:
    """Adaptive reweighting: points on or above the baseline weigh 0, points below it exp(t * d / |sum of d below|).

    A point is below if it is so by more than ON_IT of the largest value: a baseline that few points hold goes through
    them, and the sign of what rounding leaves there must not decide. Fewer than two points below leave the next baseline
    undetermined, so the present one is kept.
    """
    y = np.ascontiguousarray(x.T)
    smoother, out = Smoother(len(y), lam), np.empty_like(y)
    todo, w = np.arange(y.shape[1]), np.ones_like(y)
    limit, on_it = tol * np.abs(y).sum(axis=0), ON_IT * np.abs(y).max(axis=0)
    for t in range(1, max_iter + 1):
        residual = y[:, todo] - smoother.solve(w, y[:, todo])
        below = residual < -on_it[todo]
        negative = np.abs(np.where(below, residual, 0.0).sum(axis=0))
        done = (negative < limit[todo]) | (below.sum(axis=0) < 2) | (t == max_iter)
        out[:, todo[done]] = residual[:, done]
        todo, residual, below, negative = todo[~done], residual[:, ~done], below[:, ~done], negative[~done]
        if not todo.size:
            break
        w = np.where(below, np.exp(t * np.where(below, residual, 0.0) / negative), 0.0)
    return out.T


def baseline_arpls(x: np.ndarray, lam: float = 1e5, max_iter: int = 15) -> np.ndarray:
    """Logistic weights from mean and standard deviation of the residuals below the baseline."""
    y = np.ascontiguousarray(x.T)
    smoother, w = Smoother(len(y), lam), np.ones_like(y)
    for _ in range(max_iter):
        d = y - smoother.solve(w, y)
        below = d < 0
        count = np.maximum(below.sum(axis=0), 1)
        m = np.where(below, d, 0.0).sum(axis=0) / count
        s = np.sqrt((np.where(below, d - m, 0.0) ** 2).sum(axis=0) / count)
        s = np.where(s > 0, s, 1e-12)
        w = 1.0 / (1.0 + np.exp(np.clip(2.0 * (d - (2.0 * s - m)) / s, -700.0, 700.0)))
    return d.T


def lower_hull(x: np.ndarray) -> list[np.ndarray]:
    """Vertices (channel indices) of each spectrum's lower convex hull; all spectra advance together."""
    rows, n = x.shape
    stack = np.zeros((rows, n), dtype=np.int64)
    depth = np.zeros(rows, dtype=np.int64)
    for i in range(n):
        active = np.flatnonzero(depth >= 2)
        while active.size:
            a, o = stack[active, depth[active] - 1], stack[active, depth[active] - 2]
            yo, ya, yi = x[active, o], x[active, a], x[active, i]
            above = (a - o) * (yi - yo) - (ya - yo) * (i - o) <= 0
            active = active[above]
            depth[active] -= 1
            active = active[depth[active] >= 2]
        stack[np.arange(rows), depth] = i
        depth += 1
    return [stack[r, : depth[r]] for r in range(rows)]


def baseline_rubberband(x: np.ndarray) -> np.ndarray:
    """Subtract the lower convex hull, interpolated linearly between its vertices."""
    channels = np.arange(x.shape[1])
    out = np.empty(x.shape, dtype=float)
    for r, hull in enumerate(lower_hull(x)):
        out[r] = x[r] - np.interp(channels, hull, x[r, hull])
    return out


# ---------------------------------------------------------------- replay of fitted steps


def msc(x: np.ndarray, reference: np.ndarray, start: float = 0.0, end: float = 1.0) -> np.ndarray:
    first, last = fraction_bounds(x.shape[1], start, end, 2)
    xs, rs = x[:, first:last], reference[first:last]
    r = rs - rs.mean()
    slope = (xs - xs.mean(axis=1, keepdims=True)) @ r / (r @ r)
    intercept = xs.mean(axis=1) - slope * rs.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        return (x - intercept[:, None]) / slope[:, None]


def emsc(x: np.ndarray, reference: np.ndarray, poly_order: int = 4) -> np.ndarray:
    """Fit 1, reference, w .. w^p; subtract intercept and polynomial, divide by the reference's coefficient."""
    w = np.linspace(-1.0, 1.0, x.shape[1])
    design = np.column_stack([np.ones_like(w), reference] + [w**k for k in range(1, poly_order + 1)])
    coef = x @ np.linalg.pinv(design).T
    scale = np.where(coef[:, 1:2] == 0, 1e-12, coef[:, 1:2])
    coef[:, 1] = 0.0
    return (x - coef @ design.T) / scale


def nonneg_weights(x: np.ndarray, parts: np.ndarray, sweeps: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Non-negative w minimizing |x - w @ parts| per row: cyclic coordinate descent on the normal equations."""
    gram, target = parts @ parts.T, x @ parts.T
    w = np.zeros_like(target)
    diag = np.diag(gram)
    for _ in range(sweeps):
        change = 0.0
        for j in range(len(gram)):
            if diag[j] <= 0:
                continue
            new = np.maximum(w[:, j] + (target[:, j] - w @ gram[:, j]) / diag[j], 0.0)
            change = max(change, float(np.abs(new - w[:, j]).max(initial=0.0)))
            w[:, j] = new
        if change <= tol * max(1.0, float(np.abs(w).max(initial=0.0))):
            break
    return w
