"""Scores of estimates against the deployable reference predictors.

Every reference predictor is a column of the window (assumed limit, last value,
mean, minimum), so scoring is one projection per row: no window function, no
group, no shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.functions.arrays import finite
from tailcast.settings import CAT_MULT, MAX_VALID, MIN_VALID, REFERENCES, SKILL_EPS

REFERENCE_COLUMN = {"constant_assumed": "L_hat", "last_value": "last_v",
                    "window_mean": "mean_v", "window_min": "min_v"}


def is_valid(v: Column) -> Column:
    return F.coalesce(finite(v) & v.between(MIN_VALID, MAX_VALID), F.lit(False))


def is_strictly_valid(v: Column, window_max: Column) -> Column:
    return F.coalesce(finite(v) & (v >= 0.0) & (v <= F.lit(2.0) * window_max), F.lit(False))


def distance(a: Column, b: Column) -> Column:
    """|a - b| at twelve decimals: smaller differences are rounding noise of the
    fits, and predictors that agree must tie, not win by the last bit."""
    return F.rint(F.abs(a - b) * F.lit(1e12)) / F.lit(1e12)


def error_of(estimate: Column, truth: Column) -> Column:
    return F.when(is_valid(estimate), distance(estimate, truth))


def skill(err: Column, ref: Column) -> Column:
    """err / ref; against an exact reference 1 if the method is exact too, else
    +inf; NULL when either is invalid."""
    return F.when(err.isNotNull() & ref.isNotNull(), F.when(
        ref <= SKILL_EPS, F.when(err <= SKILL_EPS, F.lit(1.0)).otherwise(F.lit(float("inf"))))
        .otherwise(err / F.when(ref > SKILL_EPS, ref)))


def is_catastrophic(err: Column, last_err: Column) -> Column:
    return err.isNull() | F.coalesce((last_err > 1e-12) & (err > F.lit(CAT_MULT) * last_err), F.lit(False))


def improve_ratio(err: Column, last_err: Column) -> Column:
    return F.when(err > 1e-12, last_err / F.when(err > 1e-12, err)).when(err.isNotNull(), F.lit(1.0))


def wins(err: Column, ref: Column) -> Column:
    return F.coalesce(err < ref, F.lit(False)).cast("int")


def zero_denominator(err: Column, last_err: Column) -> Column:
    return F.coalesce(finite(err) & finite(last_err) & (last_err <= SKILL_EPS), F.lit(False))


def improvement(err: Column, current: Column) -> Column:
    return F.when(err.isNotNull() & (current > 1e-10), (current - err) / F.when(current > 1e-10, current))


def score(rows: DataFrame) -> DataFrame:
    """Add validity, error, catastrophe, ratios and wins to forecast rows."""
    truth = F.col("true_val")
    refs = {tag: error_of(F.col(REFERENCE_COLUMN[m]), truth) for m, tag in REFERENCES}
    rows = rows.withColumns({
        "prediction_raw": F.col("estimate_raw"),
        "window_max": F.col("max_v"),
        "curr_val": F.col("last_v"),
        "valid": is_valid(F.col("estimate_raw")).cast("int"),
        "valid_strict": is_strictly_valid(F.col("estimate_raw"), F.col("max_v")).cast("int"),
        "error": error_of(F.col("estimate_raw"), truth),
        "curr_err": distance(F.col("last_v"), truth),
        **{f"_e_{tag}": e for tag, e in refs.items()}})
    err = F.col("error")
    rows = rows.withColumns({
        "estimate": F.when(F.col("valid") == 1, F.col("estimate_raw")),
        "E_last": F.col("_e_last"),
        "ref_error": F.least(*[F.col(f"_e_{tag}") for _, tag in REFERENCES]),
        "catastrophic": is_catastrophic(err, F.col("curr_err")).cast("int"),
        "improve_ratio": improve_ratio(err, F.col("curr_err"))})
    out = {"skill": skill(err, F.col("ref_error"))}
    for _, tag in REFERENCES:
        out[f"skill_vs_{tag}"] = skill(err, F.col(f"_e_{tag}"))
        out[f"win_vs_{tag}"] = wins(err, F.col(f"_e_{tag}"))
    return rows.withColumns(out).drop("estimate_raw", *[f"_e_{tag}" for _, tag in REFERENCES],
                                      "last_v", "mean_v", "min_v", "max_v")


def reference_columns(rows: DataFrame, keys) -> DataFrame:
    """For estimates that arrive long and without window columns: spread the
    reference estimates of each (window, target) over its rows.  A group holds
    one row per method, so the window partition is bounded by the registry."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({
        col: F.max(F.when(F.col("method") == m, F.col("estimate_raw"))).over(w)
        for m, col in REFERENCE_COLUMN.items()})


def best_reference() -> Column:
    """Aggregate: the reference with the smallest valid error, first in the
    reference order on ties, '' when none is valid."""
    order = F.lit(None).cast("int")
    for i, (m, _) in reversed(list(enumerate(REFERENCES))):
        order = F.when(F.col("method") == m, F.lit(i)).otherwise(order)
    return F.coalesce(F.min_by(F.col("method"), F.when(
        order.isNotNull() & F.col("error").isNotNull(), F.struct(F.col("error"), order.alias("o")))), F.lit(""))
