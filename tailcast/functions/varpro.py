"""Box-constrained sums of nonlinear terms, many windows at a time.

limit + sum of amplitude_j * basis(x; p_j): for given p the rest is linear least squares in a box, solved
exactly by an active set; what is left is a problem in p alone (variable projection).  Its Jacobian follows
from the projection onto the free columns, and damped Gauss-Newton steps in log p run until no window gains
any more.  Starts are the best tuples of a coarse grid, so a window may fall into either of two valleys."""
from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START_SIDE = 8                 # grid values of a parameter from which starts are drawn
STARTS = 2
MOST_STEPS = 60                # Gauss-Newton steps; a window that still gains then keeps what it has
GAIN = 1e-12                   # a step that lowers the sum of squares by less, relative to it and to y, ends a window
TINY = np.finfo(float).tiny


def _masked_solve(r: np.ndarray, rhs: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Least squares of r z = rhs over the free columns; the others get 0.  The small diagonal decides where columns coincide."""
    k = r.shape[2]
    scale = np.maximum(np.sqrt((r * r).sum(axis=(1, 2))), TINY)[:, None, None]
    rows = np.concatenate([r * free[:, None, :], np.eye(k) * np.where(free, 1e-13, 1.0)[:, None, :] * scale], axis=1)
    q, s = np.linalg.qr(rows)
    return np.linalg.solve(s, np.einsum("wnk,wn->wk", q[:, :rhs.shape[1]], rhs)[..., None])[..., 0] * free


def solve_boxed(a: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray | None = None):
    """Exact box-constrained least squares of a z = y for each window: (z, free, sum of squares).

    Free variables move towards their unconstrained solution until one meets its bound and is fixed there; when
    all fit, the fixed one whose gradient points inwards most is released; none left: optimal."""
    rows, n, k = a.shape
    r_all = np.linalg.qr(np.concatenate([a, y[:, :, None]], axis=2), mode="r")
    r, t = r_all[:, :, :k], r_all[:, :, k]
    z = np.clip(np.zeros((rows, k)) if start is None else start, low, high)
    free = (z > low) & (z < high)
    live = np.ones(rows, bool)
    for _ in range(6 * k):
        i = np.flatnonzero(live)
        if not len(i):
            break
        ri, zi, fi = r[i], z[i], free[i]
        fixed = np.where(fi, 0.0, zi)
        want = _masked_solve(ri, t[i] - np.einsum("wnk,wk->wn", ri, fixed), fi)
        want = np.where(fi, want, zi)
        step = want - zi
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(step > 0, (high - zi) / step, np.where(step < 0, (low - zi) / step, np.inf))
        room = np.where(fi & (step != 0), np.maximum(room, 0.0), np.inf)
        first = room.argmin(axis=1)
        alpha = np.minimum(room.min(axis=1), 1.0)
        blocked = room.min(axis=1) < 1.0
        zi = np.where(blocked[:, None], zi + alpha[:, None] * step, want)
        b = np.flatnonzero(blocked)
        zi[b, first[b]] = np.where(step[b, first[b]] > 0, high[first[b]], low[first[b]])
        fi[b, first[b]] = False
        zi = np.clip(zi, low, high)
        # all fit: release the fixed variable that would gain most
        g = np.einsum("wnk,wn->wk", ri, t[i] - np.einsum("wnk,wk->wn", ri, zi))
        slack = 1e-10 * np.maximum(np.abs(g).max(axis=1), (t[i] ** 2).sum(axis=1) * 1e-6)[:, None]
        pull = np.where(fi, 0.0, np.where(zi <= low, g, np.where(zi >= high, -g, np.abs(g))))
        pull = np.where(blocked[:, None] | (pull <= slack), 0.0, pull)
        out = pull.argmax(axis=1)
        some = pull.max(axis=1) > 0
        s = np.flatnonzero(some)
        fi[s, out[s]] = True
        z[i], free[i] = zi, fi
        live[i] = blocked | some
    rest = t - np.einsum("wnk,wk->wn", r, z)
    return z, free, (rest * rest).sum(axis=1)


class Model:
    """Basis functions of one kind with their boxes."""

    def __init__(self, basis, slope, terms, p_range, limit_box, amp_box):
        self.basis, self.slope, self.terms = basis, slope, terms     # slope: derivative by log p
        self.lo, self.hi = np.log(p_range[0]), np.log(p_range[1])
        self.low = np.array([limit_box[0]] + [amp_box[0]] * terms)
        self.high = np.array([limit_box[1]] + [amp_box[1]] * terms)

    def columns(self, x, u):
        """(windows, points, 1 + terms): ones and one column per term."""
        return np.stack([np.ones_like(x)] + [self.basis(x, np.exp(u[:, j])[:, None]) for j in range(self.terms)], axis=2)

    def at(self, x, y, u, start=None):
        a = self.columns(x, u)
        return a, *solve_boxed(a, y, self.low, self.high, start)


def _descend(model: Model, x, y, u):
    """Damped Gauss-Newton in u = log p from given starts."""
    rows, k = u.shape
    a, z, free, sse = model.at(x, y, u)
    damp = np.full(rows, 1e-3)
    size = np.maximum((y * y).sum(axis=1), TINY)
    live = np.ones(rows, bool)
    for _ in range(MOST_STEPS):
        i = np.flatnonzero(live)
        if not len(i):
            break
        xi, yi, ui, ai, zi, fi = x[i], y[i], u[i], a[i], z[i], free[i]
        rest = yi - np.einsum("wnk,wk->wn", ai, zi)
        p = np.exp(ui)
        jac = np.stack([zi[:, 1 + j, None] * model.slope(xi, p[:, j][:, None]) for j in range(k)], axis=2)
        # columns that may still move are projected out: the linear part answers to every step in u
        q, r = np.linalg.qr(ai * fi[:, None, :])
        keep = np.abs(np.diagonal(r, axis1=1, axis2=2)) > 1e-12 * np.maximum(np.abs(r).max(axis=(1, 2)), TINY)[:, None]
        q = q * keep[:, None, :]
        jac = jac - q @ (q.transpose(0, 2, 1) @ jac)
        gram, grad = jac.transpose(0, 2, 1) @ jac, np.einsum("wnk,wn->wk", jac, rest)
        # a parameter on its border that is pushed outwards stays there
        stuck = ((ui <= model.lo) & (grad < 0)) | ((ui >= model.hi) & (grad > 0))
        gram = np.where(stuck[:, :, None] | stuck[:, None, :], 0.0, gram)
        diag = np.einsum("wkk->wk", gram)
        gram = gram + np.eye(k) * np.where(stuck, 1.0, damp[i][:, None] * diag + 1e-30)[:, None, :]
        step = np.clip(np.linalg.solve(gram, np.where(stuck, 0.0, grad)[..., None])[..., 0], -1.5, 1.5)
        un = np.clip(ui + step, model.lo, model.hi)
        an, zn, fn, sn = model.at(xi, yi, un, zi)
        better = sn < sse[i]
        done = better & (sse[i] - sn <= GAIN * (sse[i] + GAIN * size[i]))
        w = i[better]
        u[w], a[w], z[w], free[w], sse[w] = un[better], an[better], zn[better], fn[better], sn[better]
        damp[i] = np.where(better, np.maximum(damp[i] / 5, 1e-12), damp[i] * 10)
        live[i] = ~done & (damp[i] < 1e9) & (np.abs(un - ui).max(axis=1) > 1e-12)
    return u, z, sse


def fit(model: Model, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of (p ascending, limit, amplitudes in the same order)."""
    k, rows = model.terms, len(y)
    axis = np.linspace(model.lo, model.hi, START_SIDE + 2)[1:-1]
    tuples = np.array(list(combinations(axis, k)))
    first = np.empty((rows, len(tuples)))
    for t, u in enumerate(tuples):
        first[:, t] = model.at(x, y, np.tile(u, (rows, 1)))[3]
    order = np.argsort(first, axis=1, kind="stable")[:, :STARTS]
    best_u, best_z, best = None, None, np.full(rows, np.inf)
    for s in range(order.shape[1]):
        u, z, sse = _descend(model, x, y, tuples[order[:, s]].copy())
        better = sse < best
        best_u = u if best_u is None else np.where(better[:, None], u, best_u)
        best_z = z if best_z is None else np.where(better[:, None], z, best_z)
        best = np.where(better, sse, best)
    rank = np.argsort(best_u, axis=1, kind="stable")
    return np.concatenate([np.exp(np.take_along_axis(best_u, rank, axis=1)), best_z[:, :1], np.take_along_axis(best_z[:, 1:], rank, axis=1)], axis=1)
