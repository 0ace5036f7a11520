"""Least-squares fits of a window.

Linear models are Column expressions.  Models with nonlinear parameters go
through Arrow batch functions.  With one nonlinear parameter they scan a grid of it
and solve the remaining box-constrained linear problem in closed form, then
narrow the grid around the winner (four passes of 32 values, which settle the
parameter to about 1e-4 of itself).  Sums of terms are fitted by variable projection.
"""
from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from tailcast.functions import varpro
from tailcast.functions.arrays import finite, let, ols
from tailcast.settings import DENOM_TOL, RIDGE

# executors need not have this package installed: its functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRID = 32
PASSES = 4
CHUNK = 512

# fixed values: model name -> (nonlinear range, limit box, amplitude box, fewest points)
ONE_TERM = {
    "power": ((0.05, 4.0), (0.0, 2.0), (-5.0, 5.0), 4),
    "exponential": ((1e-4, 5.0), (0.0, 1.0), (0.0, 2.0), 4),
    "rational": ((1e-5, 10.0), (0.0, 1.0), (0.0, 2.0), 4),
}
# power terms: (number of terms, fewest points); exponents and boxes as "power"
MULTI_TERM = {
    "power2": (2, (0.05, 4.0), (0.0, 2.0), (-5.0, 5.0), 7),
    "power3": (3, (0.05, 4.0), (0.0, 2.0), (-5.0, 5.0), 10),
    "exponential2": (2, (1e-4, 5.0), (0.0, 1.0), (0.0, 2.0), 6),
}


# ---- linear models ----------------------------------------------------------
def line(ys: Column, xs: Column) -> Column:
    return ols(xs, ys)


def log_line(ys: Column, xs: Column, limit: Column) -> Column:
    """Line of ln(y - limit) on ln(max(x, 1)); NULL unless every y > limit."""
    fit = ols(F.transform(xs, lambda v: F.ln(F.greatest(v, F.lit(1.0)))),
              F.transform(ys, lambda v: F.ln(F.when(v > limit, v - limit))))
    return F.when(F.array_min(ys) > limit, fit)


def inverse_power(x: Column, alpha: float) -> Column:
    """x^-alpha for the fixed exponents, from exactly rounded operations."""
    x = F.greatest(x, F.lit(1.0))
    if alpha == 0.5:
        return F.lit(1.0) / F.sqrt(x)
    if alpha == 1.0:
        return F.lit(1.0) / x
    if alpha == 2.0:
        return F.lit(1.0) / (x * x)
    return F.pow(x, F.lit(-alpha))


def power_line(ys: Column, xs: Column, alpha: float) -> Column:
    return ols(F.transform(xs, lambda v: inverse_power(v, alpha)), ys)


def boxed_line(phi: Column, ys: Column, lbox, cbox) -> Column:
    """Least squares of y = L + c phi with L and c in boxes: the interior
    solution if it fits, else the best of the four edges."""
    n = F.size(ys).cast("double")

    def solve(s):
        def sse(lim, c):
            off = s["my"] - lim - c * s["mp"]
            return s["syy"] - F.lit(2.0) * c * s["spy"] + c * c * s["spp"] + n * off * off

        def clip(v, box):
            return F.least(F.greatest(v, F.lit(box[0])), F.lit(box[1]))

        def cand(lim, c):
            return let(F.struct(lim.alias("limit"), c.alias("amp")),
                       lambda k: F.struct(sse(k["limit"], k["amp"]).alias("sse"),
                                          k["limit"].alias("limit"), k["amp"].alias("amp")))

        free_c = F.when(s["spp"] > 0, s["spy"] / s["spp"])
        inside = let(free_c, lambda c: let(s["my"] - c * s["mp"], lambda lim: F.when(
            c.between(*cbox) & lim.between(*lbox), cand(lim, c))))
        raw = s["spp"] + n * s["mp"] * s["mp"]
        edges = [cand(F.lit(lim), clip((s["spy"] + n * s["mp"] * (s["my"] - lim)) / raw, cbox)) for lim in lbox]
        edges += [cand(clip(s["my"] - F.lit(c) * s["mp"], lbox), F.lit(c)) for c in cbox]
        return F.coalesce(inside, F.array_min(F.array(*edges)))

    from tailcast.functions.arrays import mean, total
    moments = let(F.struct(mean(phi).alias("mp"), mean(ys).alias("my")), lambda m: F.struct(
        m["mp"].alias("mp"), m["my"].alias("my"),
        total(F.zip_with(phi, ys, lambda p, y: (p - m["mp"]) * (y - m["my"]))).alias("spy"),
        total(F.transform(phi, lambda p: (p - m["mp"]) * (p - m["mp"]))).alias("spp"),
        total(F.transform(ys, lambda y: (y - m["my"]) * (y - m["my"]))).alias("syy")))
    return F.when(F.size(ys) >= 3, let(moments, solve))


def log_decay(ys: Column, xs: Column) -> Column:
    """L + A / ln(x + e) with L in [0, 1] and A in [0, 5]."""
    return boxed_line(F.transform(xs, lambda v: F.lit(1.0) / F.ln(v + F.lit(float(np.e)))), ys,
                      (0.0, 1.0), (0.0, 5.0))


# ---- Arrow batches ----------------------------------------------------------
def _basis(kind: str, x, p):
    if kind.startswith("power"):
        return np.exp(-p * np.log(np.maximum(x, 1.0)))
    if kind.startswith("exponential"):
        return np.exp(-p * x)
    return 1.0 / (1.0 + p * x)


def _boxed(mp, my, spp, spy, syy, n, lbox, cbox):
    """Vectorised form of ``boxed_line``: (sse, limit, amplitude) arrays."""
    def sse(lim, c):
        return syy - 2.0 * c * spy + c * c * spp + n * (my - lim - c * mp) ** 2

    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.where(spp > 0, spy / spp, np.nan)
    lim = my - c * mp
    ok = (c >= cbox[0]) & (c <= cbox[1]) & (lim >= lbox[0]) & (lim <= lbox[1])
    best = np.where(ok, sse(lim, c), np.inf)
    b_lim, b_c = np.where(ok, lim, 0.0), np.where(ok, c, 0.0)
    raw = np.maximum(spp + n * mp * mp, np.finfo(float).tiny)
    edges = [(np.full_like(raw, l0), np.clip((spy + n * mp * (my - l0)) / raw, *cbox)) for l0 in lbox]
    edges += [(np.clip(my - c0 * mp, *lbox), np.full_like(raw, c0)) for c0 in cbox]
    for lim, c in edges:
        val = sse(lim, c)
        use = ~ok & (val < best)
        best, b_lim, b_c = np.where(use, val, best), np.where(use, lim, b_lim), np.where(use, c, b_c)
    return best, b_lim, b_c


def fit_one_term(kind: str, x: np.ndarray, y: np.ndarray, fixed_limit=None, cbox=None):
    """Fit limit + amp * basis(x; p) on a block of windows: rows of (p, limit,
    amp, sse).  With ``fixed_limit`` (one value per row) only amp is free."""
    (lo, hi), lbox, box, _ = ONE_TERM[kind]
    cbox = box if cbox is None else cbox
    rows, n = y.shape
    my = y.mean(axis=1, keepdims=True)
    syy = ((y - my) ** 2).sum(axis=1, keepdims=True)
    left, right = np.full((rows, 1), lo), np.full((rows, 1), hi)
    frac = np.arange(GRID) / (GRID - 1)
    group = np.unique(x, axis=0, return_inverse=True)[1].reshape(-1)
    for _ in range(PASSES):
        _, first, group = np.unique(group, return_index=True, return_inverse=True)
        if len(first) == rows:
            first = group = slice(None)
        # rows with equal steps and equal bounds so far share the basis and its moments
        grid = left[first] * (right[first] / left[first]) ** frac
        phi = _basis(kind, x[first][:, None, :], grid[:, :, None])
        if fixed_limit is None:
            mp = phi.mean(axis=2)
            phi -= mp[:, :, None]
            spy = np.einsum("rgn,rn->rg", phi[group], y - my)
            phi *= phi
            grid = grid[group]
            sse, lim, amp = _boxed(mp[group], my, phi.sum(axis=2)[group], spy, syy, n, lbox, cbox)
        else:
            res = y - fixed_limit[:, None]
            spy = np.einsum("rgn,rn->rg", phi[group], res)
            phi *= phi
            spp, grid = phi.sum(axis=2)[group], grid[group]
            amp = np.clip(spy / spp, *cbox)
            sse = (res * res).sum(axis=1, keepdims=True) - 2 * amp * spy + amp * amp * spp
            lim = np.broadcast_to(fixed_limit[:, None], amp.shape)
        at = sse.argmin(axis=1)[:, None]
        pick = [np.take_along_axis(a, at, axis=1) for a in (grid, lim, amp, sse)]
        left = np.take_along_axis(grid, np.maximum(at - 1, 0), axis=1)
        right = np.take_along_axis(grid, np.minimum(at + 1, GRID - 1), axis=1)
        group = (np.arange(rows) if isinstance(group, slice) else group) * GRID + at[:, 0]
    return np.concatenate(pick, axis=1)


def _slope(kind: str, x, p):
    """Derivative of the basis by the logarithm of its parameter."""
    if kind.startswith("power"):
        logx = np.log(np.maximum(x, 1.0))
        return -p * logx * np.exp(-p * logx)
    return -p * x * np.exp(-p * x)


def many_term_model(kind: str) -> varpro.Model:
    k, p_range, lbox, cbox, _ = MULTI_TERM[kind]
    return varpro.Model(lambda x, p: _basis(kind, x, p), lambda x, p: _slope(kind, x, p), k, p_range, lbox, cbox)


def fit_many_terms(kind: str, x: np.ndarray, y: np.ndarray):
    """Fit limit + sum of k amplitude * basis terms: rows of (p..., limit, amp...), p ascending."""
    return varpro.fit(many_term_model(kind), x, y)


def fit_pade(order, x: np.ndarray, y: np.ndarray):
    """Coefficients of P_p / Q_q (Q(0) = 1) on steps scaled to [0, 1]: ridge rows
    appended, solved by a batched QR-based pseudo-inverse."""
    p, q = order
    span = x[:, -1:] - x[:, :1]
    xn = (x - x[:, :1]) / span
    cols = [xn ** j for j in range(p + 1)] + [-(xn ** j) * y for j in range(1, q + 1)]
    a = np.stack(cols, axis=2)
    k = p + 1 + q
    a = np.concatenate([a, np.broadcast_to(RIDGE * np.eye(k), (len(y), k, k))], axis=1)
    b = np.concatenate([y, np.zeros((len(y), k))], axis=1)
    qm, rm = np.linalg.qr(a)
    return np.linalg.solve(rm, np.einsum("rnk,rn->rk", qm, b)[..., None])[..., 0]


def _by_length(values: pa.Array):
    """Blocks of equally long windows: (row numbers, matrix)."""
    lengths = np.asarray(values.value_lengths().fill_null(0))
    flat = np.asarray(values.flatten(), dtype=float)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        for part in np.array_split(rows, max(1, -(-len(rows) // CHUNK))):
            yield part, size, (starts[part][:, None] + np.arange(size)), flat


def _rows_or_null(out: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list column, NULL where a row has NaN."""
    width = out.shape[1]
    bad = np.isnan(out).any(axis=1)
    offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * width, mask=np.append(bad, False))
    return pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))


def _batched(width: int, fewest: int, fn):
    """Arrow function (xs, ys) -> ARRAY<DOUBLE> of ``width`` parameters per row,
    NULL where a window has too few points."""
    @F.arrow_udf("array<double>")
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = np.full((len(ys), width), np.nan)
        x_flat = np.asarray(xs.flatten(), dtype=float)
        for rows, size, where, flat in _by_length(ys):
            if size >= fewest and len(rows):
                out[rows] = fn(x_flat[where], flat[where])
        return _rows_or_null(out)
    return run


def one_term_parameters(kind: str):
    return _batched(4, ONE_TERM[kind][3], lambda x, y: fit_one_term(kind, x, y))


def many_term_parameters(kind: str):
    k, *_, fewest = MULTI_TERM[kind]
    return _batched(2 * k + 1, fewest, lambda x, y: fit_many_terms(kind, x, y))


def pade_parameters(order):
    p, q = order
    return _batched(p + 1 + q, p + 1 + q + 2, lambda x, y: fit_pade(order, x, y))


def fixed_limit_parameters(kind: str, cbox):
    """(xs, ys, limit) -> (p, limit, amp, sse) with the limit given."""
    @F.arrow_udf("array<double>")
    def run(xs: pa.Array, ys: pa.Array, limit: pa.Array) -> pa.Array:
        out = np.full((len(ys), 4), np.nan)
        x_flat = np.asarray(xs.flatten(), dtype=float)
        lim = np.asarray(limit, dtype=float)
        for rows, size, where, flat in _by_length(ys):
            if size >= 2 and len(rows):
                out[rows] = fit_one_term(kind, x_flat[where], flat[where], lim[rows], cbox)
        return _rows_or_null(out)
    return run


# ---- evaluation of fitted parameters at a target step ------------------------
def _term(kind: str, p: Column, target: Column) -> Column:
    t = target.cast("double")
    if kind.startswith("power"):
        return F.pow(F.greatest(t, F.lit(1.0)), -p)
    if kind.startswith("exponential"):
        return F.exp(-p * t)
    return F.lit(1.0) / (F.lit(1.0) + p * t)


def at_one_term(kind: str, par: Column, target: Column) -> Column:
    return F.get(par, F.lit(1)) + F.get(par, F.lit(2)) * _term(kind, F.get(par, F.lit(0)), target)


def at_many_terms(kind: str, par: Column, target: Column) -> Column:
    k = MULTI_TERM[kind][0]
    est = F.get(par, F.lit(k))
    for j in range(k):
        est = est + F.get(par, F.lit(k + 1 + j)) * _term(kind, F.get(par, F.lit(j)), target)
    return est


def at_pade(order, par: Column, xs: Column, target: Column) -> Column:
    p, q = order
    x0, x1 = F.get(xs, F.lit(0)), F.get(xs, F.size(xs) - 1)
    xf = F.when(x1 - x0 >= 1e-10, (target.cast("double") - x0) / (x1 - x0))

    def value(z):
        num, den = F.get(par, F.lit(p)), F.lit(0.0)
        for j in range(p - 1, -1, -1):
            num = num * z + F.get(par, F.lit(j))
        for j in range(q, 0, -1):
            den = (den + F.get(par, F.lit(p + j))) * z
        return let(den + 1.0, lambda d: F.when(F.abs(d) >= DENOM_TOL, num / d))
    return let(xf, value)
