"""Methods on blocks of equally long windows.

The same formulas as the Column expressions of ``sequence`` and ``fits``, one numpy operation per step of a
formula for a whole block instead of one interpreted lambda call per value.  ``x`` and ``y`` are matrices with a
row per window, ``limit`` the assumed limit per row, ``t`` the target steps (a row per window); estimates have a row per
window and a column per target (or one for all).  NaN stands for NULL.  Sums run from left to right as in the Column form.
"""
from __future__ import annotations

import sys
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tailcast.functions.fits import ONE_TERM, _boxed, fit_one_term, fit_pade
from tailcast.settings import DENOM_TOL, MAX_VALID, MIN_VALID, RIDGE

# executors need not have this package installed: its functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 128                     # windows of a block: its intermediate grids stay in a core's cache


def _divide(num, den, tol=DENOM_TOL):
    return np.where(np.abs(den) >= tol, num / den, np.nan)


def _total(a):
    return np.cumsum(a, axis=1)[:, -1:]


# ---- sequence transformations --------------------------------------------------
def shanks(y, most):
    """Estimates of the orders 1 to ``most``; values that are not finite are dropped between passes."""
    out = []
    for _ in range(most):
        if y.shape[1] < 3:
            out.append(np.full(len(y), np.nan))
            y = y[:, :0]
            continue
        y = _divide(y[:, 2:] * y[:, :-2] - y[:, 1:-1] * y[:, 1:-1], y[:, 2:] - 2.0 * y[:, 1:-1] + y[:, :-2])
        ok = np.isfinite(y)
        left = ok.sum(axis=1)
        gaps = np.flatnonzero(left < y.shape[1])
        if len(gaps):
            order = np.argsort(~ok[gaps], axis=1, kind="stable")
            y[gaps] = np.take_along_axis(np.where(ok[gaps], y[gaps], np.nan), order, axis=1)
        last = np.take_along_axis(y, np.maximum(left - 1, 0)[:, None], axis=1)[:, 0]
        out.append(np.where(left > 0, last, np.nan))
    return out


def wynn(y, order, steps=None):
    """Epsilon table, or the rho table where ``steps`` are given."""
    need = 2 * order + 1
    cur = y[:, -need:]
    prev = cur * 0.0
    for k in range(1, need):
        n = cur.shape[1] - 1
        num = 1.0 if steps is None else steps[:, -need:][:, k:k + n] - steps[:, -need:][:, :n]
        prev, cur = cur, prev[:, 1:n + 1] + _divide(num, cur[:, 1:] - cur[:, :-1])
    return cur[:, 0]


def brezinski(y, order):
    c = y[:, -(2 * order + 1):]
    for _ in range(order):
        d = c[:, 1:-1] - c[:, :-2]
        c = c[:, 1:-1] - _divide(d * d, c[:, 2:] - 2.0 * c[:, 1:-1] + c[:, :-2])
    return c[:, 0]


def levin(y, x, order, variant):
    need = order + (3 if variant == "v" else 2)
    s, at = y[:, -need:], x[:, -need:]
    d = s[:, 1:] - s[:, :-1]
    num, den = 0.0, 0.0
    for j in range(order + 1):
        if variant == "v":
            weight = _divide(d[:, j] * d[:, j + 1], d[:, j + 1] - d[:, j])
        else:
            weight = d[:, j] if variant == "t" else (at[:, j] + 1.0) * d[:, j]
        beta = 1.0
        for _ in range(order - 1):
            beta = beta * (at[:, 0] + (j + 1.0))
        c = _divide((-1.0) ** j * comb(order, j) * beta, weight)
        num, den = num + c * s[:, j], den + c
    return _divide(num, den)


def anderson(y, order, ridge=RIDGE):
    s = y[:, -(order + 2):]
    f = s[:, 1:] - s[:, :-1]
    d = f[:, 1:] - f[:, :-1]
    norm = ridge
    for j in range(order):
        norm = norm + d[:, j] * d[:, j]
    scale = -f[:, order] / norm
    est = s[:, order + 1]
    for j in range(order):
        est = est + scale * d[:, j] * f[:, j + 1]
    return est


def neville(y, x, degree, t):
    xi = (1.0 / np.maximum(x[:, -(degree + 1):], 1.0))[:, :, None]
    xf = (1.0 / np.maximum(t, 1.0))[:, None, :]
    p = np.repeat(y[:, -(degree + 1):, None], t.shape[1], axis=2)
    for k in range(1, degree + 1):
        n = p.shape[1] - 1
        p = _divide((xf - xi[:, :n]) * p[:, 1:] - (xf - xi[:, k:k + n]) * p[:, :-1], xi[:, k:k + n] - xi[:, :n], 1e-15)
    return p[:, 0]


# ---- fits ----------------------------------------------------------------------
def _line(x, y):
    """(slope, intercept) of the least-squares lines."""
    n = x.shape[1]
    mx, my = _total(x) / n, _total(y) / n
    sxx = _total((x - mx) * (x - mx))
    slope = np.where(sxx > 0, _total((x - mx) * (y - my)) / sxx, np.nan)
    return slope, my - slope * mx


def linear(x, y, limit, t):
    slope, intercept = _line(x, y)
    return intercept + slope * t


def log_linear(x, y, limit, t):
    low = limit[:, None]
    slope, intercept = _line(np.log(np.maximum(x, 1.0)), np.log(np.where(y > low, y - low, np.nan)))
    return low + np.exp(intercept + slope * np.log(np.maximum(t, 1.0)))


def _inverse_power(x, alpha):
    x = np.maximum(x, 1.0)
    return 1.0 / (np.sqrt(x) if alpha == 0.5 else x if alpha == 1.0 else x * x)


def power_fixed(x, y, alpha, t):
    slope, intercept = _line(_inverse_power(x, alpha), y)
    return intercept + slope * _inverse_power(t, alpha)


def log_fit(x, y, limit, t):
    phi = 1.0 / np.log(x + np.e)
    n = x.shape[1]
    mp, my = _total(phi) / n, _total(y) / n
    dev, off = phi - mp, y - my
    _, lim, amp = _boxed(mp, my, _total(dev * dev), _total(dev * off), _total(off * off), float(n), (0.0, 1.0), (0.0, 5.0))
    return lim + amp / np.log(t + np.e)


def geometric(x, y, limit, t):
    d = y[:, -10:][:, 1:] - y[:, -10:][:, :-1]
    neg = d < 0
    n = neg.sum(axis=1)
    first = np.take_along_axis(d, neg.argmax(axis=1)[:, None], axis=1)
    last = np.take_along_axis(d, d.shape[1] - 1 - neg[:, ::-1].argmax(axis=1)[:, None], axis=1)
    r = np.exp((np.log(-last) - np.log(-first)) / (n - 1)[:, None])
    r = np.where((n >= 2)[:, None] & (r > 0) & (r < 1), r, np.nan)
    steps = t - x[:, -1:]
    return np.where(np.isnan(r), np.nan, np.where(steps <= 0, y[:, -1:], y[:, -1:] + d[:, -1:] * r * (1.0 - np.power(r, steps)) / (1.0 - r)))


def one_term(kind, x, y, t):
    par = fit_one_term(kind, x, y)
    par[np.isnan(par).any(axis=1)] = np.nan
    p = par[:, :1]
    term = np.power(np.maximum(t, 1.0), -p) if kind == "power" else np.exp(-p * t) if kind == "exponential" else 1.0 / (1.0 + p * t)
    return par[:, 1:2] + par[:, 2:3] * term


def pade(order, x, y, t):
    p, q = order
    span = x[:, -1:] - x[:, :1]
    par = fit_pade(order, x, y)
    par[np.isnan(par).any(axis=1)] = np.nan
    z = np.where(span >= 1e-10, (t - x[:, :1]) / span, np.nan)
    num, den = par[:, p:p + 1], 0.0
    for j in range(p - 1, -1, -1):
        num = num * z + par[:, j:j + 1]
    for j in range(q, 0, -1):
        den = (den + par[:, p + j:p + j + 1]) * z
    return _divide(num, den + 1.0)


# ---- methods by name: (fewest points, estimate) ----------------------------------
def _order(ladder, k):
    """(fewest points, estimate) of one order of a ladder of sequence transformations."""
    column = lambda fn: lambda x, y, limit, t: fn(x, y)[:, None]
    if ladder == "wynn_eps":
        return 2 * k + 1, column(lambda x, y: wynn(y, k))
    if ladder == "wynn_rho":
        return 2 * k + 1, column(lambda x, y: wynn(y, k, x))
    if ladder == "brezinski":
        return 2 * k + 1, column(lambda x, y: brezinski(y, k))
    if ladder == "anderson":
        return k + 2, column(lambda x, y: anderson(y, k))
    if ladder == "neville":
        return k + 1, lambda x, y, limit, t: neville(y, x, k, t)
    variant = ladder[-1]
    return k + (3 if variant == "v" else 2), column(lambda x, y: levin(y, x, k, variant))


def _methods():
    out = {"linear": (1, linear), "log_linear": (1, log_linear), "geom_avg_diff": (4, geometric), "log_fit": (3, log_fit)}
    for name, alpha in (("richardson_a05", 0.5), ("richardson_a10", 1.0), ("richardson_a20", 2.0)):
        out[name] = (1, lambda x, y, limit, t, a=alpha: power_fixed(x, y, a, t))
    for name, kind in (("richardson_1", "power"), ("single_exp_fit", "exponential"), ("rational_fit", "rational")):
        out[name] = (ONE_TERM[kind][3], lambda x, y, limit, t, k=kind: one_term(k, x, y, t))
    for p, q in [(p, q) for p in (1, 2, 3) for q in (1, 2, 3)] + [(3, 4), (4, 4), (4, 5)]:
        out[f"pade_{p}{q}"] = (p + q + 3, lambda x, y, limit, t, o=(p, q): pade(o, x, y, t))
    orders = {"wynn_eps": ("wynn_eps_", (1, 2, 3)), "wynn_rho": ("wynn_rho_", (1, 2, 3)), "anderson": ("anderson_", (1, 2, 3)), "brezinski": ("brezinski_theta", (1, 2)),
              "neville": ("neville_", (2, 3, 4)), **{f"levin_{v}": (f"levin_{v}", (1, 2)) for v in "tuv"}}
    for ladder, (prefix, ks) in orders.items():
        out |= {f"{prefix}{k}": _order(ladder, k) for k in ks}
    return out


METHODS = _methods()
SHANKS = {f"shanks_{k}": k for k in (1, 2, 3, 4)}      # one table holds every order
NAMES = frozenset(METHODS) | frozenset(SHANKS)


def block(names, x, y, limit, t):
    """Estimates of a block: (window, target, method).  A name is a method or (ladder, order)."""
    out = np.full((len(y), t.shape[1], len(names)), np.nan)
    passes = {n: SHANKS[n] if n in SHANKS else n[1] for n in names if n in SHANKS or n[0] == "shanks"}
    table = shanks(y, max(passes.values(), default=0))
    for i, name in enumerate(names):
        if name in passes:
            out[:, :, i] = table[passes[name] - 1][:, None]
            continue
        fewest, estimate = METHODS[name] if name in METHODS else _order(*name)
        if y.shape[1] >= fewest:
            out[:, :, i] = estimate(x, y, limit, t)
    return out


def spread(found):
    """Interquartile range of the valid ones among the last axis's values; infinite with fewer than two."""
    with np.errstate(invalid="ignore"):
        v = np.sort(np.where((found >= MIN_VALID) & (found <= MAX_VALID), found, np.nan), axis=-1)
    n = np.isfinite(v).sum(axis=-1, keepdims=True)

    def at(p):
        pos = p * (n - 1)
        low = np.maximum(np.floor(pos).astype(int), 0)
        a = np.take_along_axis(v, low, axis=-1)
        b = np.take_along_axis(v, np.clip(low + 1, 0, np.maximum(n - 1, 0)), axis=-1)
        return a + (b - a) * (pos - low)

    return np.where(n >= 2, at(0.75) - at(0.25), np.inf)[..., 0]


# ---- spreads over copies of a window ---------------------------------------------
TRIVIAL = {"constant_assumed": lambda y, limit, oracle: limit[:, None], "constant_oracle": lambda y, limit, oracle: oracle[:, None],
           "window_mean": lambda y, limit, oracle: _total(y) / y.shape[1], "window_min": lambda y, limit, oracle: np.fmin.reduce(y, axis=1)[:, None],
           "last_value": lambda y, limit, oracle: y[:, -1:]}


def iqr(found, repeats, fewest, below):
    """Interquartile range of the valid ones among the last axis's values, each counted ``repeats`` times; ``below`` with
    fewer than ``fewest``.  Interpolated as Spark's percentile does."""
    v = np.sort(np.where((found >= MIN_VALID) & (found <= MAX_VALID), found, np.nan), axis=-1)
    repeats = np.maximum(repeats, 1)[..., None]
    n = np.isfinite(v).sum(axis=-1, keepdims=True) * repeats

    def at(p):
        pos = p * (n - 1)
        low, high = np.floor(pos), np.ceil(pos)
        a, b = (np.take_along_axis(v, np.maximum(i, 0).astype(int) // repeats, axis=-1) for i in (low, high))
        return np.where(a == b, a, (high - pos) * a + (pos - low) * b)

    return np.where(n >= max(fewest, 1), at(0.75) - at(0.25), below)[..., 0]


def spreads(names, fewest, below=None, shifts=None, min_points=0, every=False):
    """Arrow function (xs, copies, limit, oracle, target steps, other keys of the targets) -> ARRAY<DOUBLE>: per distinct target the
    ``iqr`` of each of ``names`` over copies of the window (per target, equal ones alike, with ``every``).  ``copies`` holds the values of all copies, one after the other; with ``shifts`` it
    holds the window once, and the copies begin at the shifts that leave ``min_points``."""
    names, shifts = tuple(names), None if shifts is None else tuple(shifts)
    inside = [n for n in names if n not in TRIVIAL]
    below = np.nan if below is None else float(below)

    def of_copy(x, y, limit, oracle, t):
        out = np.empty((*t.shape, len(names)))
        out[:, :, [i for i, n in enumerate(names) if n not in TRIVIAL]] = block(inside, x, y, limit, t)
        for i, n in enumerate(names):
            if n in TRIVIAL:
                out[:, :, i] = TRIVIAL[n](y, limit, oracle)
        return out

    def of_block(x, y, limit, oracle, t):
        size = x.shape[1]
        if shifts is None:
            copies = y.shape[1] // size
            many = lambda a: np.repeat(a, copies, axis=0)
            found = of_copy(many(x), y.reshape(-1, size), many(limit), many(oracle), many(t))
            return np.moveaxis(found.reshape(len(x), copies, *found.shape[1:]), 1, -1)
        at = {s: of_copy(x[:, s:], y[:, s:], limit, oracle, t) if size - s >= max(min_points, 1) else np.full((*t.shape, len(names)), np.nan) for s in set(shifts)}
        return np.stack([at[s] for s in shifts], axis=-1)

    @F.arrow_udf("array<double>")
    def run(xs: pa.Array, copies: pa.Array, limit: pa.Array, oracle: pa.Array, targets: pa.Array, *keys: pa.Array) -> pa.Array:
        lengths, held, wanted = (np.asarray(a.value_lengths().fill_null(0)) for a in (xs, copies, targets))
        x_flat, y_flat, *t_flat = (np.asarray(a.flatten(), dtype=float) for a in (xs, copies, targets, *keys))
        starts, y_starts, t_starts = (np.cumsum(n) - n for n in (lengths, held, wanted))
        limits, oracles = (np.asarray(a, dtype=float) for a in (limit, oracle))
        most = int(wanted.max(initial=0))
        out = np.full((len(lengths), most, len(names)), np.nan)
        first = np.zeros((len(lengths), most), dtype=bool)
        if most:
            places = np.minimum(t_starts[:, None] + np.arange(most), len(t_flat[0]) - 1)
            there = np.arange(most) < wanted[:, None]
            equal = there[:, :, None] & there[:, None, :]
            for flat in t_flat:
                a, b = flat[places][:, :, None], flat[places][:, None, :]
                equal &= (a == b) | (np.isnan(a) & np.isnan(b))
            counts = equal.sum(axis=2)
            first = there if every else there & (equal.argmax(axis=2) == np.arange(most))
            t = np.where(there, t_flat[0][places], np.nan)
            for size in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == size)
                times = int(held[rows[0]] // size)
                for part in np.array_split(rows, -(-len(rows) * times // ROWS)):
                    x, y = x_flat[starts[part][:, None] + np.arange(size)], y_flat[y_starts[part][:, None] + np.arange(size * times)]
                    with np.errstate(all="ignore"):
                        out[part] = iqr(of_block(x, y, limits[part], oracles[part], t[part]), counts[part][..., None], fewest, below)
        flat = out[first].reshape(-1)
        ends = np.concatenate([[0], np.cumsum(first.sum(axis=1))]) * len(names)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, mask=np.isnan(flat)))
    return run


SHAPE = ("log_log_slope", "curvature_idx", "oscillation_idx", "noise_var", "diff_ratio_cv", "spread")


def _shape(x, y, low, mean, span):
    """The window features that need no fit and the sum of squares around the mean: a column per name of ``SHAPE``."""
    n = y.shape[1]
    out = np.full((len(y), len(SHAPE)), np.nan)
    above = y > low[:, None]
    count = above.sum(axis=1, keepdims=True)
    some = lambda v: _total(np.where(above, v, 0.0))
    lx, ly = np.log(np.maximum(x, 1.0)), np.log(np.where(above, y - low[:, None], 1.0))
    dx = lx - some(lx) / count
    sxx = some(dx * dx)
    out[:, 0] = np.where((count >= 3) & (sxx > 0), some(dx * (ly - some(ly) / count)) / sxx, np.nan)[:, 0]
    out[:, 5] = _total((y - mean[:, None]) ** 2)[:, 0]
    variance = lambda v: _total((v - _total(v) / v.shape[1]) ** 2) / v.shape[1]
    step = y[:, 1:] - y[:, :-1]
    bend = step[:, 1:] - step[:, :-1]
    if n >= 3:
        out[:, 1] = (_total(np.abs(bend)) / bend.shape[1])[:, 0] / (span + 1e-15)
        out[:, 2] = (step[:, :-1] * step[:, 1:] < 0).sum(axis=1) / max(n - 2, 1)
    if n >= 4:
        out[:, 3] = variance(bend)[:, 0]
        ratio = y[:, 1:] / np.fmax(np.abs(y[:, :-1]), 1e-15)
        out[:, 4] = (np.sqrt(variance(ratio)) / (np.abs(_total(ratio) / ratio.shape[1]) + 1e-15))[:, 0]
    return out


def shapes():
    """Arrow function (xs, ys, base level, mean, largest less smallest value) -> ARRAY<DOUBLE> of the values ``SHAPE``."""
    @F.arrow_udf("array<double>")
    def run(xs: pa.Array, ys: pa.Array, low: pa.Array, mean: pa.Array, span: pa.Array) -> pa.Array:
        lengths = np.asarray(ys.value_lengths().fill_null(0))
        x_flat, y_flat = (np.asarray(a.flatten(), dtype=float) for a in (xs, ys))
        starts = np.cumsum(lengths) - lengths
        rest = [np.asarray(a, dtype=float) for a in (low, mean, span)]
        out = np.full((len(lengths), len(SHAPE)), np.nan)
        for size in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == size)
            for part in np.array_split(rows, -(-len(rows) // ROWS)):
                where = starts[part][:, None] + np.arange(size)
                with np.errstate(all="ignore"):
                    out[part] = _shape(x_flat[where], y_flat[where], *[a[part] for a in rest])
        flat = out.reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(SHAPE)), pa.array(flat, mask=np.isnan(flat)))
    return run


def estimates(names, moved=(), shifts=(0,), fewest=3):
    """Arrow function (xs, ys, limit, target steps) -> ARRAY<DOUBLE>: per target the estimates of ``names``, then the
    spreads of ``moved`` over the window starts ``shifts``."""
    names, moved, shifts = tuple(names), tuple(moved), tuple(shifts)
    here = {s for s in shifts if s == 0 and set(moved) <= set(names)}      # the whole window is computed already
    whole = [names.index(m) for m in moved] if here else []

    def of_block(x, y, limit, t):
        out = block(names, x, y, limit, t)
        if not moved:
            return out
        size = y.shape[1]
        at = {s: np.full((*t.shape, len(moved)), np.nan) if size - s < fewest else out[:, :, whole] if s in here else block(moved, x[:, s:], y[:, s:], limit, t)
              for s in set(shifts)}
        return np.concatenate([out, spread(np.stack([at[s] for s in shifts], axis=-1))], axis=2)

    @F.arrow_udf("array<double>")
    def run(xs: pa.Array, ys: pa.Array, limit: pa.Array, targets: pa.Array) -> pa.Array:
        lengths, wanted = (np.asarray(a.value_lengths().fill_null(0)) for a in (ys, targets))
        x_flat, y_flat, t_flat = (np.asarray(a.flatten(), dtype=float) for a in (xs, ys, targets))
        starts, t_starts = np.cumsum(lengths) - lengths, np.cumsum(wanted) - wanted
        limits = np.asarray(limit, dtype=float)
        most = int(wanted.max(initial=0))
        out = np.full((len(lengths), most, len(names) + len(moved)), np.nan)
        if most:
            places = np.minimum(t_starts[:, None] + np.arange(most), len(t_flat) - 1)
            t = np.where(np.arange(most) < wanted[:, None], t_flat[places], np.nan)
            for size in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == size)
                for part in np.array_split(rows, -(-len(rows) // ROWS)):
                    where = starts[part][:, None] + np.arange(size)
                    with np.errstate(all="ignore"):
                        out[part] = of_block(x_flat[where], y_flat[where], limits[part], t[part])
        flat = out.reshape(-1)
        width = most * out.shape[2]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * width), pa.array(flat, mask=np.isnan(flat)))
    return run
