"""Expectations on record and panel tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailcast.settings import DEFAULT_METHOD


def panel_violations(panels: DataFrame) -> DataFrame:
    """Counts of panel rows that break an ordering or a NULL rule."""
    none = F.col("n_valid") == 0
    checks = {
        "quartile_order": F.coalesce(~((F.col("q25_error") <= F.col("med_error")) & (F.col("med_error") <= F.col("q75_error"))
                                       & (F.col("q75_error") <= F.col("p90_error"))), F.lit(False)),
        "valid_above_total": F.col("n_valid") > F.col("n_total"),
        "stats_without_valid": none & F.coalesce("mean_error", "med_error", "q25_error", "q75_error", "p90_error").isNotNull(),
        "rate_out_of_range": ~F.col("valid_rate").between(0, 1) | ~F.col("cat_rate").between(0, 1) | ~F.col("win_rate_vs_last").between(0, 1),
        "missing_stats": ~none & F.col("med_error").isNull(),
    }
    return panels.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.when(c, 1)).alias(n) for n, c in checks.items()])


def record_violations(records: DataFrame) -> DataFrame:
    """Invalid implies catastrophic, and E_last is the error of the last value."""
    last = F.col("method") == "last_value"
    return records.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when((F.col("valid") == 0) & (F.col("catastrophic") == 0), 1)).alias("invalid_not_catastrophic"),
        F.count(F.when(last & ~F.col("error").eqNullSafe(F.col("E_last")), 1)).alias("last_error_differs"),
        F.count(F.when((F.col("valid") == 0) & F.col("error").isNotNull(), 1)).alias("invalid_with_error"),
        F.count(F.when((F.col("error") < 0) | F.isnan("error"), 1)).alias("bad_error"))


def validity_disagreements(records: DataFrame) -> DataFrame:
    return records.filter("valid <> valid_strict").groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def reaction_to_input(base: DataFrame, changed: DataFrame, keys) -> DataFrame:
    """Per method: on how many (window, target) pairs the estimate changes when
    the input does.  Forecasts are arrays until they are exploded, so the planner thinks them small enough to collect
    for a broadcast; the hint keeps the join shuffled."""
    a = base.select(*keys, "method", F.col("estimate_raw").alias("e0"))
    b = changed.select(*keys, "method", F.col("estimate_raw").alias("e1"))
    return a.join(b.hint("merge"), [*keys, "method"]).groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("e0").eqNullSafe(F.col("e1")), 1)).alias("n_changed"))


def inclusion_verdicts(curves: DataFrame, depth: int, min_steps: int, min_gap_ratio: float, latest_min: int | None = None) -> DataFrame:
    """Source criteria per curve: enough steps, enough decay left at the depth,
    the minimum not before the depth."""
    f = curves.groupBy("curve_id").agg(
        F.max("step").alias("n_rounds"), F.min(F.struct("value", "step")).alias("m"), F.max_by("value", "step").alias("end_value"),
        F.min_by("value", "step").alias("first_value"), F.max(F.when(F.col("step") == depth, F.col("value"))).alias("at_depth"))
    ratio = F.try_divide(F.col("at_depth") - F.col("m.value"), F.col("first_value") - F.col("m.value"))
    f = f.select("curve_id", "n_rounds", F.col("m.step").alias("argmin_round"), ratio.alias("gap_ratio"))
    a, b, c = F.col("n_rounds") >= min_steps, F.coalesce(F.col("gap_ratio") >= min_gap_ratio, F.lit(False)), F.col("argmin_round") > depth
    return f.select("*", *[F.when(x, "pass").otherwise("fail").alias(n) for x, n in ((a, "long_enough"), (b, "decay_left"), (c, "minimum_after"))],
                    (a & b & c).cast("int").alias("included"))


def expected_differences(before: DataFrame, after: DataFrame, keys, columns) -> DataFrame:
    """Report mode of the keyed diff: counts only, never an error."""
    from tailcast.operators.pairing import compare_tables
    return compare_tables(before, after, keys, columns)


def variant_agreement(variants: DataFrame, registry: DataFrame, keys, tolerance: float = 1e-12) -> DataFrame:
    """Per ladder variant that equals a registered method: compared, differing
    and missing records, and a verdict."""
    v = variants.select(*keys, "method", F.col("estimate_raw").alias("a"))
    r = registry.select(*keys, "method", F.col("estimate_raw").alias("b"))
    j = v.join(r, [*keys, "method"], "full_outer")
    same = F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False))
    return j.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~same, 1)).alias("n_differ")).withColumn(
        "verdict", F.when(F.col("n_differ") == 0, "agree").otherwise("differ"))
