"""Sequence transformations as Column expressions over a window.

``ys`` / ``xs`` are the window's values and steps (ARRAY<DOUBLE>).  Orders are
parameters, so the roster orders and the order ladders share one definition.
Triangular tables are folds over arrays: the expression does not grow with the
order.  A difference below the tolerance gives NULL, which propagates.
"""
from __future__ import annotations

from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F

from tailcast.functions.arrays import back, divide, finite, let, positions, tail
from tailcast.settings import DENOM_TOL, RIDGE


def _orders(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def shanks(ys: Column, order: int, tol: float = DENOM_TOL) -> Column:
    """``order`` delta-squared passes, non-finite values dropped between passes,
    last value of the final pass."""
    def one_pass(s, _):
        return F.filter(
            F.transform(positions(s, 2), lambda i: divide(
                F.get(s, i + 2) * F.get(s, i) - F.get(s, i + 1) * F.get(s, i + 1),
                F.get(s, i + 2) - F.lit(2.0) * F.get(s, i + 1) + F.get(s, i), tol)), finite)
    return F.aggregate(_orders(order), ys, one_pass, lambda s: back(s, 1))


def wynn_epsilon(ys: Column, order: int, tol: float = DENOM_TOL) -> Column:
    need = 2 * order + 1
    start = tail(ys, need)

    def level(acc, _):
        prev, cur = acc["prev"], acc["cur"]
        nxt = F.transform(positions(cur, 1), lambda j: F.get(prev, j + 1) + divide(
            F.lit(1.0), F.get(cur, j + 1) - F.get(cur, j), tol))
        return F.struct(cur.alias("prev"), nxt.alias("cur"))

    # the column before the first is identically zero, also at its own shift
    zero = F.transform(start, lambda v: v * 0.0)
    table = F.aggregate(_orders(2 * order), F.struct(zero.alias("prev"), start.alias("cur")),
                        level, lambda acc: F.get(acc["cur"], F.lit(0)))
    return F.when(F.size(ys) >= need, table)


def wynn_rho(ys: Column, xs: Column, order: int, tol: float = DENOM_TOL) -> Column:
    need = 2 * order + 1
    start, x = tail(ys, need), tail(xs, need)

    def level(acc, k):
        prev, cur = acc["prev"], acc["cur"]
        nxt = F.transform(positions(cur, 1), lambda j: F.get(prev, j + 1) + divide(
            F.get(x, j + k) - F.get(x, j), F.get(cur, j + 1) - F.get(cur, j), tol))
        return F.struct(cur.alias("prev"), nxt.alias("cur"))

    zero = F.transform(start, lambda v: v * 0.0)
    table = F.aggregate(_orders(2 * order), F.struct(zero.alias("prev"), start.alias("cur")),
                        level, lambda acc: F.get(acc["cur"], F.lit(0)))
    return F.when(F.size(ys) >= need, table)


def brezinski(ys: Column, order: int, tol: float = DENOM_TOL) -> Column:
    need = 2 * order + 1

    def level(c, _):
        return F.transform(positions(c, 2), lambda j: F.get(c, j + 1) - divide(
            (F.get(c, j + 1) - F.get(c, j)) * (F.get(c, j + 1) - F.get(c, j)),
            F.get(c, j + 2) - F.lit(2.0) * F.get(c, j + 1) + F.get(c, j), tol))

    return F.when(F.size(ys) >= need, F.aggregate(
        _orders(order), tail(ys, need), level, lambda c: F.get(c, F.lit(0))))


def levin(ys: Column, xs: Column, order: int, variant: str, tol: float = DENOM_TOL) -> Column:
    """Weighted ratio over ``order + 1`` terms; the remainder estimate is the
    forward difference (t), the same times (n + 1) (u), or the
    ratio-of-differences form (v, one more point)."""
    if variant not in ("t", "u", "v"):
        raise ValueError(f"unknown variant {variant!r}")
    need = order + (3 if variant == "v" else 2)

    def transform(w):
        s = [F.get(w["y"], F.lit(j)) for j in range(need)]
        x = [F.get(w["x"], F.lit(j)) for j in range(need)]

        def d(j):
            return s[j + 1] - s[j]

        def weight(j):
            if variant == "t":
                return d(j)
            if variant == "u":
                return (x[j] + 1.0) * d(j)
            return let(d(j + 1) - d(j), lambda dd: divide(d(j) * d(j + 1), dd, tol))

        def coefficient(j):
            beta = F.lit(1.0)
            for _ in range(order - 1):
                beta = beta * (x[0] + (j + 1.0))
            return let(weight(j), lambda v: divide(F.lit((-1.0) ** j * comb(order, j)) * beta, v, tol))

        def ratio(c):
            num, den = F.lit(0.0), F.lit(0.0)
            for j in range(order + 1):
                num = num + F.get(c, F.lit(j)) * s[j]
                den = den + F.get(c, F.lit(j))
            return let(den, lambda v: divide(num, v, tol))

        return let(F.array(*[coefficient(j) for j in range(order + 1)]), ratio)

    return F.when(F.size(ys) >= need, let(
        F.struct(tail(ys, need).alias("y"), tail(xs, need).alias("x")), transform))


def anderson(ys: Column, order: int, ridge: float = RIDGE) -> Column:
    """Depth-m mixing of the last residuals.  One residual row with a ridge has
    the closed form gamma = -f d / (d.d + ridge)."""
    need = order + 2

    def mix(s):
        def f(j):
            return F.get(s, F.lit(j + 1)) - F.get(s, F.lit(j))

        d = [f(j + 1) - f(j) for j in range(order)]
        norm = F.lit(ridge)
        for dj in d:
            norm = norm + dj * dj

        def estimate(scale):
            est = F.get(s, F.lit(order + 1))
            for j in range(order):
                est = est + scale * d[j] * f(j + 1)
            return est

        return let((-f(order)) / norm, estimate)

    return F.when(F.size(ys) >= need, let(tail(ys, need), mix))


def neville(ys: Column, xs: Column, degree: int, target: Column) -> Column:
    """Polynomial in 1/x through the last ``degree + 1`` points, at 1/target."""
    need = degree + 1
    xi = F.transform(tail(xs, need), lambda v: F.lit(1.0) / F.greatest(v, F.lit(1.0)))
    xf = F.lit(1.0) / F.greatest(target.cast("double"), F.lit(1.0))

    def level(p, k):
        return F.transform(positions(p, 1), lambda i: divide(
            (xf - F.get(xi, i)) * F.get(p, i + 1) - (xf - F.get(xi, i + k)) * F.get(p, i),
            F.get(xi, i + k) - F.get(xi, i), 1e-15))

    return F.when(F.size(ys) >= need, F.aggregate(
        _orders(degree), tail(ys, need), level, lambda p: F.get(p, F.lit(0))))


# ---- all orders of a family from one table ---------------------------------------------
# The estimate of order k is the last entry of a column of the triangular table, and it depends on the last few points
# only: the table of the highest order holds every lower one.  Each ladder is ARRAY<DOUBLE>, order 1 first.
_EMPTY = "array<double>"


def _with_last(out: Column, column: Column, take: Column | None = None) -> Column:
    last = back(column, 1)
    grown = F.concat(out, F.array(last))
    return grown if take is None else F.when(take, grown).otherwise(out)


def shanks_ladder(ys: Column, most: int, tol: float = DENOM_TOL) -> Column:
    def one_pass(acc, _):
        s = acc["s"]
        nxt = F.filter(F.transform(positions(s, 2), lambda i: divide(
            F.get(s, i + 2) * F.get(s, i) - F.get(s, i + 1) * F.get(s, i + 1),
            F.get(s, i + 2) - F.lit(2.0) * F.get(s, i + 1) + F.get(s, i), tol)), finite)
        return let(nxt, lambda n: F.struct(n.alias("s"), _with_last(acc["out"], n).alias("out")))
    start = F.struct(ys.alias("s"), F.array().cast(_EMPTY).alias("out"))
    return F.aggregate(_orders(most), start, one_pass, lambda acc: acc["out"])


def _two_columns(ys: Column, most: int, entry) -> Column:
    """Ladder of the even columns of a table whose column k comes from the two before; ``entry(prev, cur, j, k)``."""
    start = tail(ys, 2 * most + 1)

    def level(acc, k):
        prev, cur = acc["prev"], acc["cur"]
        nxt = F.transform(positions(cur, 1), lambda j: entry(prev, cur, j, k))
        return let(nxt, lambda n: F.struct(cur.alias("prev"), n.alias("cur"), _with_last(acc["out"], n, k % 2 == 0).alias("out")))

    zero = F.transform(start, lambda v: v * 0.0)
    first = F.struct(zero.alias("prev"), start.alias("cur"), F.array().cast(_EMPTY).alias("out"))
    return F.aggregate(_orders(2 * most), first, level, lambda acc: acc["out"])


def wynn_epsilon_ladder(ys: Column, most: int, tol: float = DENOM_TOL) -> Column:
    return _two_columns(ys, most, lambda prev, cur, j, k: F.get(prev, j + 1) + divide(F.lit(1.0), F.get(cur, j + 1) - F.get(cur, j), tol))


def wynn_rho_ladder(ys: Column, xs: Column, most: int, tol: float = DENOM_TOL) -> Column:
    x = tail(xs, 2 * most + 1)
    return _two_columns(ys, most, lambda prev, cur, j, k: F.get(prev, j + 1) + divide(
        F.get(x, j + k) - F.get(x, j), F.get(cur, j + 1) - F.get(cur, j), tol))


def _one_column(start: Column, most: int, step) -> Column:
    """Ladder of the columns of a table whose column k comes from the one before; ``step(column, k)``."""
    def level(acc, k):
        return let(step(acc["c"], k), lambda n: F.struct(n.alias("c"), _with_last(acc["out"], n).alias("out")))
    first = F.struct(start.alias("c"), F.array().cast(_EMPTY).alias("out"))
    return F.aggregate(_orders(most), first, level, lambda acc: acc["out"])


def brezinski_ladder(ys: Column, most: int, tol: float = DENOM_TOL) -> Column:
    return _one_column(tail(ys, 2 * most + 1), most, lambda c, _: F.transform(positions(c, 2), lambda j: F.get(c, j + 1) - divide(
        (F.get(c, j + 1) - F.get(c, j)) * (F.get(c, j + 1) - F.get(c, j)),
        F.get(c, j + 2) - F.lit(2.0) * F.get(c, j + 1) + F.get(c, j), tol)))


def neville_ladder(ys: Column, xs: Column, most: int, target: Column) -> Column:
    xi = F.transform(tail(xs, most + 1), lambda v: F.lit(1.0) / F.greatest(v, F.lit(1.0)))
    xf = F.lit(1.0) / F.greatest(target.cast("double"), F.lit(1.0))
    return _one_column(tail(ys, most + 1), most, lambda p, k: F.transform(positions(p, 1), lambda i: divide(
        (xf - F.get(xi, i)) * F.get(p, i + 1) - (xf - F.get(xi, i + k)) * F.get(p, i),
        F.get(xi, i + k) - F.get(xi, i), 1e-15)))
