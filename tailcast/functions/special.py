"""Distribution functions as Column expressions: logarithm of the gamma function, regularised incomplete beta
function and the tails of the normal and t distributions.  Iterations run inside higher-order functions, so
p-values need no Python worker."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tailcast.functions.arrays import let

# The published coefficients of the Lanczos approximation with g = 7 and nine terms.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
FRACTION_STEPS = 300           # the fraction needs about the square root of the larger parameter, far fewer up to a million
SERIES_STEPS = 60
TAIL_STEPS = 80
SMALLEST = 1e-300


def log_gamma(x: Column) -> Column:
    """For x >= 1/2."""
    z = x - 1.0
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + float(i))
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def _away_from_zero(v: Column) -> Column:
    return F.when(F.abs(v) < SMALLEST, F.lit(SMALLEST)).otherwise(v)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, evaluated from the front by ratios of
    consecutive convergents; finished rows keep their value."""
    def step(s, m):
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))

        def half(s, term):
            return let(F.struct((F.lit(1.0) / _away_from_zero(F.lit(1.0) + term * s["d"])).alias("d"), _away_from_zero(F.lit(1.0) + term / s["c"]).alias("c"), s["h"].alias("h")),
                       lambda n: F.struct(n["d"].alias("d"), n["c"].alias("c"), (n["h"] * n["d"] * n["c"]).alias("h"), F.abs(n["d"] * n["c"] - 1.0).alias("change")))
        return F.when(s["change"] < 1e-15, s).otherwise(let(half(s, even), lambda h: half(h, odd)))

    d0 = F.lit(1.0) / _away_from_zero(F.lit(1.0) - (a + b) * x / (a + 1.0))
    start = F.struct(d0.alias("d"), F.lit(1.0).alias("c"), d0.alias("h"), F.lit(1.0).alias("change"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), start, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function for a, b >= 1/2 and 0 <= x <= 1, on the side where the fraction converges fast."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(F.lit(1.0) - x))
    low = front * _beta_fraction(a, b, x) / a
    high = F.lit(1.0) - front * _beta_fraction(b, a, F.lit(1.0) - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1.0) / (a + b + 2.0), low).otherwise(high)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) with ``df`` degrees of freedom."""
    df = df.cast("double")
    return incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0: a series near zero, a continued fraction from the tail beyond."""
    series = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES_STEPS)), F.struct(z.alias("term"), z.alias("sum")), lambda s, n: let(
        s["term"] * 2.0 * z * z / (2.0 * n.cast("double") + 1.0), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum"))), lambda s: s["sum"])
    near = F.lit(1.0) - F.lit(2 / math.sqrt(math.pi)) * F.exp(-z * z) * series
    # erfc z = exp(-z^2) / sqrt(pi) * 1 / (z + (1/2) / (z + (2/2) / (z + ...))), summed from its end
    down = F.aggregate(F.sequence(F.lit(TAIL_STEPS), F.lit(1), F.lit(-1)), z, lambda acc, n: z + n.cast("double") / 2 / acc)
    far = F.exp(-z * z) / (F.lit(math.sqrt(math.pi)) * down)
    return F.when(z < 2.5, near).otherwise(far)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|)."""
    return erfc(F.abs(z) / math.sqrt(2.0))
