"""Preprocessing steps in SQL, to be chained: each takes a table (spectrum_id, channel, x) and gives another.

A step is a function of (name of its input, prefix for its tables, number of channels) and returns (tables, name of its
output, number of channels); tables are ``name AS (...)`` texts. :func:`chained` puts steps together.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from registry.views import POSITIVE, r

Step = Callable[[str, str, int], tuple[list[str], str, int]]
FOLDS = "folds AS (SELECT f FROM range(3) t(f))"


def chained(*blocks: list[Step], source: str = "pos", base: str = POSITIVE, digits: int = 6) -> str:
    """A query with the result of a block's steps, one after the other; the channels of several blocks stand side by side."""
    tables, parts, offset = [FOLDS], [], 0
    for b, steps in enumerate(blocks):
        name, width = source, 64
        for i, step in enumerate(steps):
            more, name, width = step(name, f"s{b}_{i}_", width)
            tables += more
        parts.append(f"SELECT spectrum_id, CAST(channel + {offset} AS BIGINT) AS channel, {r('x', digits)} AS x FROM {name}")
        offset += width
    return "WITH" + base + ", " + ", ".join(tables) + " " + " UNION ALL ".join(parts)


def lists(name: str, prefix: str) -> str:
    """The spectra of a table as lists."""
    return f"{prefix}y AS (SELECT spectrum_id, list(x ORDER BY channel) AS y FROM {name} GROUP BY 1)"


def unlisted(expression: str, source: str, prefix: str, width: int) -> str:
    return f"{prefix}out AS (SELECT spectrum_id, unnest(range({width})) AS channel, unnest({expression}) AS x FROM {source})"


def snv(name, p, width):
    w = "OVER (PARTITION BY spectrum_id)"
    return [f"{p}out AS (SELECT spectrum_id, channel, (x - avg(x) {w}) / stddev_pop(x) {w} AS x FROM {name})"], f"{p}out", width


def avg_pool(name, p, width, size=5):
    kept = width // size
    return [f"{p}out AS (SELECT spectrum_id, channel // {size} AS channel, avg(x) AS x FROM {name} WHERE channel < {kept * size} GROUP BY 1, 2)"], f"{p}out", kept


def decimate(name, p, width, by=5):
    kept = width // by
    return [f"{p}out AS (SELECT spectrum_id, channel // {by} AS channel, x FROM {name} WHERE channel < {kept * by} AND channel % {by} = 0)"], f"{p}out", kept


def rubberband(name, p, width):
    """The lower hull at a channel is the lowest chord over it."""
    return [f"""{p}low AS (SELECT a.spectrum_id, c.channel, min(CASE WHEN a.channel = b.channel THEN a.x
    ELSE a.x + (b.x - a.x) * (c.channel - a.channel) / (b.channel - a.channel) END) AS low
  FROM {name} a JOIN {name} b ON a.spectrum_id = b.spectrum_id AND a.channel <= b.channel
  JOIN range({width}) c(channel) ON c.channel BETWEEN a.channel AND b.channel GROUP BY 1, 2)""",
            f"{p}out AS (SELECT spectrum_id, channel, x - low AS x FROM {name} JOIN {p}low USING (spectrum_id, channel))"], f"{p}out", width


def means(name: str, p: str) -> list[str]:
    """Mean and deviation of each channel over the rows of the other folds, joined to the rows."""
    return [f"{p}ref AS (SELECT f AS fold, channel, avg(x) AS m, stddev_pop(x) AS s FROM {name}, folds WHERE spectrum_id % 3 <> f GROUP BY 1, 2)",
            f"{p}j AS (SELECT spectrum_id, channel, x, m, s FROM {name} JOIN {p}ref USING (channel) WHERE fold = spectrum_id % 3)"]


def msc(name, p, width):
    return [*means(name, p), f"{p}fit AS (SELECT spectrum_id, regr_slope(x, m) AS slope, regr_intercept(x, m) AS icept FROM {p}j GROUP BY 1)",
            f"{p}out AS (SELECT spectrum_id, channel, (x - icept) / slope AS x FROM {p}j JOIN {p}fit USING (spectrum_id))"], f"{p}out", width


def scaling(name, p, width):
    return [*means(name, p), f"{p}out AS (SELECT spectrum_id, channel, (x - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS x FROM {p}j)"], f"{p}out", width


def emsc(order: int) -> Step:
    """Least squares by Gram-Schmidt: 1, w .. w^order, then the reference."""
    def step(name, p, width):
        out = means(name, p)[:1]
        powers = ", ".join(f"(-1e0 + 2e0 * channel / {width - 1}) ** {k} AS b{k}" for k in range(order + 1))
        out.append(f"{p}d0 AS (SELECT fold, channel, m, {powers}, m AS b{order + 1} FROM {p}ref)")
        for k in range(order + 2):
            dots = ", ".join([f"sum(b{k} * b{j}) OVER w / sum(b{j} * b{j}) OVER w AS c{j}" for j in range(k)] or ["0 AS c_"])
            out.append(f"{p}e{k} AS (SELECT *, {dots} FROM {p}d{k} WINDOW w AS (PARTITION BY fold))")
            keep = ", ".join(f"b{j}" for j in range(order + 2) if j != k)
            out.append(f"{p}d{k + 1} AS (SELECT fold, channel, m, {keep}, b{k}" + "".join(f" - c{j} * b{j}" for j in range(k)) + f" AS b{k} FROM {p}e{k})")
        coefs = ", ".join(f"sum(x * b{k}) / sum(b{k} * b{k}) AS k{k}" for k in range(order + 2))
        fit = " + ".join(f"k{k} * b{k}" for k in range(order + 2))
        out.append(f"{p}basis AS (SELECT spectrum_id, d.* FROM {p}d{order + 2} d JOIN (SELECT DISTINCT spectrum_id FROM {name}) s ON d.fold = s.spectrum_id % 3)")
        out.append(f"{p}coef AS (SELECT spectrum_id, {coefs} FROM {p}basis JOIN {name} USING (spectrum_id, channel) GROUP BY 1)")
        out.append(f"""{p}out AS (SELECT spectrum_id, channel, m + (x - ({fit})) / k{order + 1} AS x
  FROM {p}basis JOIN {name} USING (spectrum_id, channel) JOIN {p}coef USING (spectrum_id))""")
        return out, f"{p}out", width
    return step


def savgol(window: int, poly: int, deriv: int) -> Step:
    """The filter from orthogonal polynomials on the window (Gram-Schmidt on powers).

    Column k of ``g`` is the k-th orthogonal polynomial at the window positions; its derivatives come from the same
    combination of the powers' derivatives.
    """
    def step(name, p, width):
        half, ctes = window // 2, []
        ctes.append(f"{p}pos AS (SELECT i - {half} AS t FROM range({window}) g(i))")

        def derived(k: int) -> str:
            factor = 1
            for i in range(deriv):
                factor *= k - i
            return f"{factor} * CAST(t AS DOUBLE) ** {k - deriv}" if k >= deriv else "0e0"

        ctes.append(f"{p}g0 AS (SELECT t" + "".join(f", CAST(t AS DOUBLE) ** {k} AS f{k}, {derived(k)} AS d{k}" for k in range(poly + 1)) + f" FROM {p}pos)")
        for k in range(poly + 1):
            dots = ", ".join([f"sum(f{k} * f{j}) OVER () / sum(f{j} * f{j}) OVER () AS c{j}" for j in range(k)] or ["0 AS c_"])
            ctes.append(f"{p}h{k} AS (SELECT *, {dots} FROM {p}g{k})")
            cols = ["t"] + [f"{a}{j}" for j in range(poly + 1) for a in ("f", "d") if j != k]
            less = {a: f"{a}{k}" + "".join(f" - c{j} * {a}{j}" for j in range(k)) for a in ("f", "d")}
            ctes.append(f"{p}g{k + 1} AS (SELECT {', '.join(cols)}, {less['f']} AS f{k}, {less['d']} AS d{k} FROM {p}h{k})")
        g = f"{p}g{poly + 1}"
        ctes.append(f"{p}norms AS (SELECT {', '.join(f'sum(f{k} * f{k}) AS n{k}' for k in range(poly + 1))} FROM {g})")
        ctes.append(f"{p}op AS (SELECT a.t AS at_, s.t AS sample, " + " + ".join(f"a.d{k} * s.f{k} / n{k}" for k in range(poly + 1)) + f" AS weight FROM {g} a, {g} s, {p}norms)")
        ctes.append(f"{p}centres AS (SELECT channel, least(greatest(channel, {half}), {width - 1 - half}) AS centre FROM range({width}) c(channel))")
        ctes.append(f"""{p}out AS (SELECT spectrum_id, c.channel, sum(weight * v.x) AS x FROM {p}centres c JOIN {p}op o ON o.at_ = c.channel - c.centre
  JOIN {name} v ON v.channel = c.centre + o.sample GROUP BY 1, 2)""")
        return ctes, f"{p}out", width
    return step


# ---------------------------------------------------------------- baselines: penalised least squares, pass by pass


def _differences() -> str:
    return "list_transform(y, lambda v, i: v - z[i])"


def let(name: str, value: str, body: str) -> str:
    """*body* with a name for *value*."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _solved(source: str, p: str, n: int, lam: float, carry: str = "") -> list[str]:
    """Tables from ``source`` (spectrum_id, y, w): ``{p}z`` adds z, which minimises the weighted squares of y - z plus lam times
    those of z's second differences. By rotations along the channels and two refinement steps, as few weights may not be 0."""
    root = f"{lam ** 0.5!r}::DOUBLE"
    share = lambda x, of, empty: f"CASE WHEN {of} > 0 THEN {x} / {of} ELSE {empty} END"
    last = ("{'w': e.w, 'k': e.k, 'a': ln, 'b': " + share("nb * na", "ln", "nb") + ", 'c': " + share("-nb * bl", "ln", "0e0")
            + ", 'p': list_append(acc.p, h.p), 'q': list_append(acc.q, h.q), 'r': list_append(acc.r, h.r)}")
    last = let("ln", "sqrt(na * na + bl * bl)", last)
    last = let("bl", f"sqrt(({share('-e.w * acc.b', 't0', '0e0')}) ** 2 + acc.c * acc.c)", last)
    last = let("na", "h.a", let("nb", "h.b", last))
    inner = ("CASE WHEN e.k > 0 THEN {'p': l, 'q': (t0 * t1 - 2 * e.k * e.k) / l, 'r': e.k * e.k / l, 'a': (-2 * e.k * t0 - e.k * t1) / l, 'b': t0 * e.k / l} "
             "ELSE {'p': t0, 'q': t1, 'r': 0e0, 'a': 0e0, 'b': 0e0} END")
    inner = let("l", "sqrt(t0 * t0 + e.k * e.k)", inner)
    move = let("t0", "sqrt(e.w * e.w + acc.a * acc.a)", let("t1", share("acc.a * acc.b", "t0", "acc.b"), let("h", inner, last)))
    empty = "'a': 0e0, 'b': 0e0, 'c': 0e0, 'p': []::DOUBLE[], 'q': []::DOUBLE[], 'r': []::DOUBLE[]"
    item = f"{{'w': sqrt(w[i]), 'k': CASE WHEN i <= {n - 2} THEN {root} ELSE 0e0 END, {empty}}}"
    out = [f"{p}f AS (SELECT spectrum_id, y, w{carry}, list_reduce(list_transform(range(1, {n + 1}), lambda i: {item}), lambda acc, e: {move}, {{'w': 0e0, 'k': 0e0, {empty}}}) AS m FROM {source})",
           f"{p}x0 AS (SELECT spectrum_id, y, w{carry}, m, list_transform(y, lambda v: 0e0) AS z, list_transform(y, lambda v, i: v * w[i]) AS rhs FROM {p}f)"]
    safe = "CASE WHEN d <> 0 THEN 1 / d ELSE 0e0 END"
    ahead = "{'t': e.t, 'd': e.d, 'q': e.q, 'r': e.r, 'z': list_append(acc.z, (e.t - e.q * coalesce(acc.z[-1], 0) - e.r * coalesce(acc.z[-2], 0)) * e.d)}"
    back = "{'t': e.t, 'd': e.d, 'q': e.q, 'r': e.r, 'z': list_prepend((e.t - e.q * coalesce(acc.z[1], 0) - e.r * coalesce(acc.z[2], 0)) * e.d, acc.z)}"
    zero = "{'t': 0e0, 'd': 0e0, 'q': 0e0, 'r': 0e0, 'z': []::DOUBLE[]}"
    for k in range(3):
        down = f"{{'t': rhs[i], 'd': inv[i], 'q': CASE WHEN i > 1 THEN m.q[i - 1] ELSE 0e0 END, 'r': CASE WHEN i > 2 THEN m.r[i - 2] ELSE 0e0 END, 'z': []::DOUBLE[]}}"
        up = "{'t': half[i], 'd': inv[i], 'q': m.q[i], 'r': m.r[i], 'z': []::DOUBLE[]}"
        out += [
            f"{p}i{k} AS (SELECT *, list_transform(m.p, lambda d: {safe}) AS inv FROM {p}x{k})",
            f"{p}h{k} AS (SELECT *, list_reduce(list_transform(range(1, {n + 1}), lambda i: {down}), lambda acc, e: {ahead}, {zero}).z AS half FROM {p}i{k})",
            f"{p}g{k} AS (SELECT *, list_reduce(list_transform(range({n}, 0, -1), lambda i: {up}), lambda acc, e: {back}, {zero}).z AS more FROM {p}h{k})",
            f"{p}n{k} AS (SELECT spectrum_id, y, w{carry}, m, list_transform(z, lambda v, i: v + more[i]) AS z FROM {p}g{k})",
            f"{p}b{k} AS (SELECT *, list_transform(range(1, {n - 1}), lambda i: z[i] - 2 * z[i + 1] + z[i + 2]) AS bend FROM {p}n{k})",
            f"""{p}x{k + 1} AS (SELECT spectrum_id, y, w{carry}, m, z, list_transform(y, lambda v, i: w[i] * (v - z[i]) - {lam!r}::DOUBLE * (coalesce(bend[i], 0)
  - CASE WHEN i > 1 THEN 2 * coalesce(bend[i - 1], 0) ELSE 0 END + CASE WHEN i > 2 THEN bend[i - 2] ELSE 0 END)) AS rhs FROM {p}b{k})"""]
    return [*out, f"{p}z AS (SELECT spectrum_id, y, w{carry}, z FROM {p}x3)"]


def asls(lam: float = 1e5, weight: float = 0.01, passes: int = 10) -> Step:
    def step(name, p, n):
        out = [lists(name, p), f"{p}p0 AS (SELECT spectrum_id, y, list_transform(y, lambda v: 1e0) AS w FROM {p}y)"]
        for k in range(passes):
            out += _solved(f"{p}p{k}", f"{p}{k}", n, lam)
            out.append(f"{p}p{k + 1} AS (SELECT spectrum_id, y, z, list_transform(y, lambda v, i: CASE WHEN v > z[i] THEN {weight!r}::DOUBLE ELSE {1 - weight!r}::DOUBLE END) AS w FROM {p}{k}z)")
        out.append(unlisted(_differences(), f"{p}p{passes}", p, n))
        return out, f"{p}out", n
    return step


def arpls(lam: float = 1e5, passes: int = 15) -> Step:
    def step(name, p, n):
        out = [lists(name, p), f"{p}p0 AS (SELECT spectrum_id, y, list_transform(y, lambda v: 1e0) AS w FROM {p}y)"]
        for k in range(passes):
            out += _solved(f"{p}p{k}", f"{p}{k}", n, lam)
            out.append(f"{p}{k}d AS (SELECT spectrum_id, y, z, d, list_filter(d, lambda v: v < 0) AS low FROM (SELECT *, {_differences()} AS d FROM {p}{k}z))")
            out.append(f"{p}{k}m AS (SELECT *, coalesce(list_avg(low), 0) AS m FROM {p}{k}d)")
            out.append(f"{p}{k}s AS (SELECT *, CASE WHEN q > 0 THEN q ELSE 1e-12 END AS sd FROM (SELECT *, sqrt(coalesce(list_avg(list_transform(low, lambda v: (v - m) * (v - m))), 0)) AS q FROM {p}{k}m))")
            out.append(f"{p}p{k + 1} AS (SELECT spectrum_id, y, z, list_transform(d, lambda v: 1 / (1 + exp(least(greatest(2 * (v - (2 * sd - m)) / sd, -700e0), 700e0)))) AS w FROM {p}{k}s)")
        out.append(unlisted(_differences(), f"{p}p{passes}", p, n))
        return out, f"{p}out", n
    return step


def airpls(lam: float = 1e5, passes: int = 15, tol: float = 1e-3) -> Step:
    """A spectrum that is done keeps its baseline: its weights stay as they were."""
    def step(name, p, n):
        out = [lists(name, p), f"{p}p0 AS (SELECT spectrum_id, y, list_transform(y, lambda v: 1e0) AS w, NULL::DOUBLE[] AS kept FROM {p}y)"]
        for k in range(passes):
            out += _solved(f"{p}p{k}", f"{p}{k}", n, lam, ", kept")
            out.append(f"{p}{k}d AS (SELECT *, {_differences()} AS d, -1e-10 * list_max(list_transform(y, lambda v: abs(v))) AS edge FROM {p}{k}z)")
            out.append(f"{p}{k}n AS (SELECT *, abs(coalesce(list_sum(list_filter(d, lambda v: v < edge)), 0)) AS neg, len(list_filter(d, lambda v: v < edge)) AS low FROM {p}{k}d)")
            done = "true" if k == passes - 1 else f"neg < {tol!r} * list_sum(list_transform(y, lambda v: abs(v))) OR low < 2"
            out.append(f"""{p}p{k + 1} AS (SELECT spectrum_id, y, coalesce(kept, CASE WHEN {done} THEN d END) AS kept,
  CASE WHEN kept IS NOT NULL OR {done} THEN w ELSE list_transform(d, lambda v: CASE WHEN v < edge THEN exp({k + 1} * v / neg) ELSE 0 END) END AS w FROM {p}{k}n)""")
        out.append(unlisted("kept", f"{p}p{passes}", p, n))
        return out, f"{p}out", n
    return step


# ---------------------------------------------------------------- despiking


def despike(threshold: float, kernel: int = 3, passes: int = 4) -> Step:
    """Channel by channel in *passes* sweeps; a flagged channel becomes the mean of clean neighbours, if there are any."""
    def step(name, p, n):
        low, high = f"greatest(1, e.i - {kernel})", f"least({n - 1}, e.i + {kernel})"
        near = f"list_transform(list_filter(range({low}, {high} + 1), lambda j: NOT s.d[j]), lambda j: s.y[j])"
        now = f"(s.d[e.i] AND len({near}) > 0)"
        moved = (f"{{'i': e.i, 'y': CASE WHEN {now} THEN list_concat(s.y[1:e.i - 1], [list_avg({near})], s.y[e.i + 1:]) ELSE s.y END, "
                 f"'d': CASE WHEN {now} THEN list_concat(s.d[1:e.i - 1], [false], s.d[e.i + 1:]) ELSE s.d END}}")
        out = [lists(name, p),
               f"{p}t AS (SELECT *, list_transform(range(1, {n}), lambda i: y[i + 1] - y[i]) AS t FROM {p}y)",
               f"{p}c AS (SELECT *, list_transform(t, lambda v: v - med) AS c FROM (SELECT *, list_median(t) AS med FROM {p}t))",
               f"{p}m AS (SELECT *, list_median(list_transform(c, lambda v: abs(v))) AS mad FROM {p}c)",
               f"{p}0 AS (SELECT spectrum_id, y, list_append(list_transform(c, lambda v: mad > 0 AND 0.6745 * abs(v) / mad > {threshold!r}), false) AS d FROM {p}m)"]
        for k in range(passes):
            out.append(f"""{p}{k + 1} AS (SELECT spectrum_id, s.y AS y, s.d AS d FROM (SELECT spectrum_id, CASE WHEN NOT list_contains(d, true) THEN {{'i': 0::BIGINT, 'y': y, 'd': d}}
  ELSE list_reduce(list_transform(range(1, {n}), lambda i: {{'i': i, 'y': []::DOUBLE[], 'd': []::BOOLEAN[]}}), lambda s, e: {moved}, {{'i': 0::BIGINT, 'y': y, 'd': d}}) END AS s FROM {p}{k}))""")
        out.append(unlisted("y", f"{p}{passes}", p, n))
        return out, f"{p}out", n
    return step


# ---------------------------------------------------------------- wavelets


def wavelet(taps: tuple[float, ...], level: int = 4) -> Step:
    """Soft threshold of the details at sigma * sqrt(2 ln n), sigma from the finest ones; edges are mirrored."""
    def step(name, p, n):
        f, low = len(taps), list(taps)
        high = [v * (-1.0 if i % 2 == 0 else 1.0) for i, v in enumerate(low[::-1])]
        listed = lambda v: "[" + ", ".join(f"{x!r}::DOUBLE" for x in v) + "]"
        deepest = max(1, min(level, int(math.floor(math.log2(n / (f - 1)))) if n >= f - 1 else 0))

        def analysed(column: str, filter_: list[float], width: int) -> str:
            at = "(1 - j + 2 * k)"
            mirrored = f"CASE WHEN {at} < 0 THEN -1 - {at} WHEN {at} >= {width} THEN {2 * width - 1} - {at} ELSE {at} END"
            return (f"list_transform(range({(width + f - 1) // 2}), lambda k: list_sum(list_transform(range({f}), "
                    f"lambda j: {listed(filter_)}[j + 1] * {column}[{mirrored} + 1])))")

        def synthesised(column: str, filter_: list[float], width: int) -> str:
            inner = f"list_transform(list_filter(range({f}), lambda j: (k + {f - 2} - j) % 2 = 0 AND k + {f - 2} - j >= 0 AND (k + {f - 2} - j) // 2 < {width}), lambda j: {listed(filter_)}[j + 1] * {column}[(k + {f - 2} - j) // 2 + 1])"
            return f"list_transform(range({2 * width - f + 2}), lambda k: coalesce(list_sum({inner}), 0))"

        out, widths, details = [lists(name, p), f"{p}a0 AS (SELECT spectrum_id, y AS a FROM {p}y)"], [n], ""
        for i in range(deepest):
            out.append(f"{p}a{i + 1} AS (SELECT spectrum_id{details}, {analysed('a', high, widths[-1])} AS d{i}, {analysed('a', low, widths[-1])} AS a FROM {p}a{i})")
            widths.append((widths[-1] + f - 1) // 2)
            details += f", d{i}"
        out.append(f"{p}r{deepest} AS (SELECT *, list_median(list_transform(d0, lambda v: abs(v))) / 0.6745e0 * {math.sqrt(2.0 * math.log(n))!r}::DOUBLE AS cut FROM {p}a{deepest})")
        for i in range(deepest - 1, -1, -1):
            width = widths[i + 1]
            soft = f"list_transform(d{i}, lambda v: sign(v) * greatest(abs(v) - cut, 0e0))"
            kept = "".join(f", d{j}" for j in range(i))
            out.append(f"{p}k{i} AS (SELECT spectrum_id{kept}, cut, a, {soft} AS s FROM {p}r{i + 1})")
            out.append(f"{p}j{i} AS (SELECT spectrum_id{kept}, cut, {synthesised('a', low[::-1], width)} AS u, {synthesised('s', high[::-1], width)} AS v FROM {p}k{i})")
            out.append(f"{p}r{i} AS (SELECT spectrum_id{kept}, cut, list_transform(u, lambda x, q: x + v[q]) AS a FROM {p}j{i})")
        out.append(unlisted(f"a[1:{n}]", f"{p}r0", p, n))
        return out, f"{p}out", n
    return step
