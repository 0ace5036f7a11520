"""Routing rules and selectors."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.functions.arrays import finite
from tailcast.functions.quantiles import grouped
from tailcast.operators.pairing import records_of_choices
from tailcast.operators.panels import PANEL, error_panel
from tailcast.session import for_every_task, settled
from tailcast.settings import CANDIDATE_RULES, FEATURES, SCREEN_THRESHOLDS

WINDOW_CELL = ("family", "depth", "noise")
GRID_CELL = ("family", "depth", "noise", "target_g")
BASE = "richardson_1"
FEW_SIDES = 20_000                       # rows of routed cells of which a copy may go to every task
ROUTES = (BASE, "rational_fit")          # methods that the cascade names


def cascade() -> Column:
    """Two rules: a flat trajectory or a poor power-law fit goes to the rational
    fit, everything else to the one-term power law.  NULL never fires."""
    slope, r2 = F.col("log_log_slope"), F.col("richardson_r2")
    return (F.when(finite(slope) & (slope > -0.10), "rational_fit")
            .when(finite(r2) & (r2 < 0.50), "rational_fit").otherwise(BASE))


def enhanced_cascade() -> Column:
    """Four rules and a default that depends on the horizon."""
    curv, osc, cv = F.col("curvature_idx"), F.col("oscillation_idx"), F.col("diff_ratio_cv")
    default = F.when(F.col("n_f") <= 300, "rational_fit").otherwise("single_exp_fit")
    return (F.when(cascade() == "rational_fit", "rational_fit")
            .when((curv > 0.50) & (cv < 0.05), "levin_t2")
            .when((osc > 0.30) & (cv > 0.20), "log_linear").otherwise(default))


def fires(value: Column, op: str, threshold) -> Column:
    if op not in ("<", ">"):
        raise ValueError(f"unknown operator {op!r}")
    return value < threshold if op == "<" else value > threshold


def threshold_rule(cells: DataFrame, feature: str, op: str, threshold: float) -> DataFrame:
    """Cells whose feature is finite, with the firing flag."""
    return cells.filter(finite(F.col(feature))).withColumn("fired", fires(F.col(feature), op, threshold).cast("int"))


def rule_table(spark: SparkSession, rules=CANDIDATE_RULES) -> DataFrame:
    for _, op, _, _ in rules:
        fires(F.lit(0.0), op, 0.0)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)],
                                 "rule int, feature string, operator string, threshold double, alternative string")


def rule_flags(cells: DataFrame, rules: DataFrame, keys=WINDOW_CELL) -> DataFrame:
    """Eligible (cell, rule) pairs with their flag: features are unpivoted and
    joined to the few rules that name them."""
    long = cells.unpivot(list(keys), list(FEATURES), "feature", "fvalue").filter(finite(F.col("fvalue")))
    j = long.join(F.broadcast(rules), "feature")
    fired = F.when(F.col("operator") == "<", F.col("fvalue") < F.col("threshold")).otherwise(F.col("fvalue") > F.col("threshold"))
    return j.select(*keys, "rule", "feature", "operator", "threshold", "alternative", fired.cast("int").alias("fired"))


def rule_panels(flags: DataFrame, records: DataFrame, base: str = BASE, keys=WINDOW_CELL, run: str = "curve_id",
                by=("rule", "feature", "operator", "threshold", "alternative")) -> DataFrame:
    """The rule panel of every rule at once.

    ``flags``: eligible cells per rule with ``fired`` and ``alternative``.
    Records of the base and of the routed method meet their cells once; panels
    are grouped by (rule, side, fired); paired records and cell medians give the
    share of lower errors and the median relative change on the fired cells."""
    by = list(by)
    cells = flags.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells_total"), F.sum("fired").alias("n_cells_fired"),
                                   F.avg(F.col("fired").cast("double")).alias("fire_rate"))
    recs = records.select(*keys, run, "method", "error", "valid", "catastrophic", "E_last")
    sides = flags.select(*keys, *by, "fired", F.explode(F.array(
        F.struct(F.lit("r1").alias("side"), F.lit(base).alias("method")),
        F.struct(F.lit("alt").alias("side"), F.col("alternative").alias("method")))).alias("s")).select(
        *keys, *by, "fired", "s.*")
    few = for_every_task(sides, FEW_SIDES)          # else both are shuffled: the records are never copied to the tasks
    rows = settled(recs.join(sides.hint("merge") if few is None else few, [*keys, "method"]), "rule-rows")
    panels = error_panel(rows, [*by, "side", "fired"])
    wide = panels.groupBy(*by).agg(*[
        F.max(F.when((F.col("side") == side) & (F.col("fired") == flag), F.col(c))).alias(f"{prefix}{side}_{c}")
        for prefix, flag in (("", 1), ("nf_", 0)) for side in ("r1", "alt") for c in PANEL])
    fired = rows.filter("fired = 1")

    def of(side, col):
        return F.max(F.when(F.col("side") == side, F.col(col)))

    pairs = (fired.groupBy(*by, *keys, run).agg(
        of("r1", "error").alias("e1"), of("alt", "error").alias("e2"), of("r1", "valid").alias("v1"), of("alt", "valid").alias("v2"),
        F.count_distinct("side").alias("_n")).filter("_n = 2"))
    lower_rec = pairs.groupBy(*by).agg(F.avg(F.coalesce(
        (F.col("v1") == 1) & (F.col("v2") == 1) & (F.col("e2") < F.col("e1")), F.lit(False)).cast("double")).alias("lower_error_frac_records"))
    meds = settled(grouped(fired.withColumns({
        "_e1": F.when((F.col("side") == "r1") & (F.col("valid") == 1), F.col("error")),
        "_e2": F.when((F.col("side") == "alt") & (F.col("valid") == 1), F.col("error"))}),
        [*by, *keys], [], {"m1": ("_e1", 0.5), "m2": ("_e2", 0.5)}), "rule-medians")
    rel = F.try_divide(F.col("m2") - F.col("m1"), F.col("m1"))
    lower_cell = grouped(meds.withColumn("_rel", rel), by, [
        F.avg(F.coalesce(F.col("m2") < F.col("m1"), F.lit(False)).cast("double")).alias("lower_error_frac_cells")], {"median_rel_change": ("_rel", 0.5)})
    return cells.join(wide, by, "left").join(lower_rec, by, "left").join(lower_cell, by, "left")


def candidate_grid(cells: DataFrame, feats: DataFrame, candidates, digits: int | None = None) -> DataFrame:
    """One row per cell: horizon, features, every candidate's cell-median error
    and the hindsight pick (lowest error, ties by name, the first candidate when
    none has a valid record)."""
    sub = cells.filter(F.col("method").isin(*candidates))
    wide = sub.groupBy(*GRID_CELL).agg(
        F.max("n_f").alias("n_f"), F.max("capped").alias("capped"), F.max("is_holdout").alias("is_holdout"),
        *[F.max(F.when(F.col("method") == m, F.col("med_error"))).alias(f"med_error__{m}") for m in candidates],
        F.coalesce(F.min_by("method", F.when(F.col("med_error").isNotNull(), F.struct(
            F.col("med_error") if digits is None else F.round("med_error", digits), F.col("method")))),
            F.lit(candidates[0])).alias("oracle_method"))
    return wide.join(feats, list(WINDOW_CELL), "left")


def selector_choices(grid: DataFrame) -> DataFrame:
    """Seven selectors as rows: four fixed methods, two cascades, the hindsight oracle."""
    picks = {"fixed_last": F.lit("last_value"), "fixed_richardson": F.lit(BASE), "fixed_rational": F.lit("rational_fit"),
             "fixed_single_exp": F.lit("single_exp_fit"), "phase2_cascade": cascade(), "enhanced_cascade": enhanced_cascade(),
             "oracle": F.col("oracle_method")}
    s = F.explode(F.array(*[F.struct(F.lit(k).alias("selector"), v.alias("method")) for k, v in picks.items()])).alias("s")
    return grid.select(*GRID_CELL, "is_holdout", "capped", "n_f", s).select(
        *GRID_CELL, "is_holdout", "capped", "n_f", "s.selector", "s.method")


def selector_records(choices: DataFrame, records: DataFrame) -> DataFrame:
    """Records of the chosen methods: the choices are one row per cell and
    selector, the records keep their place."""
    return records_of_choices(choices.select(*GRID_CELL, "selector", "method"), records.drop("selector"), [*GRID_CELL, "method"])


def selector_panels(choices: DataFrame, records: DataFrame, keys=("selector", "target_g")) -> DataFrame:
    recs = selector_records(choices.filter("capped = 0"), records)
    cell = F.struct(*GRID_CELL)
    out = error_panel(recs, list(keys), [F.count_distinct(cell).alias("n_cells")])
    return out


def validity_spread(panels: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Targets where the validity of the selectors differs by more than the tolerance."""
    s = panels.groupBy("target_g").agg((F.max("valid_rate") - F.min("valid_rate")).alias("spread"))
    return s.withColumn("warned", (F.col("spread") > tolerance).cast("int"))


def capped_choices(choices: DataFrame, cells: DataFrame) -> DataFrame:
    c = choices.filter("capped = 1")
    return c.join(cells.select(*GRID_CELL, "method", F.col("med_error").alias("chosen_med_error")), [*GRID_CELL, "method"], "left")


def screened_cascade(records: DataFrame, feats: DataFrame, run: str = "curve_id", thresholds=SCREEN_THRESHOLDS) -> DataFrame:
    """Cascade with a stability screen: above the threshold the window goes to
    the last value.  All thresholds in one pass: per window the two candidate
    records and the last value are gathered once, then crossed with the few
    thresholds."""
    keys = ["family", "depth", "noise", "target_g", run]

    def of(m, col):
        return F.max(F.when(F.col("method") == m, F.col(col)))

    routed = F.col("chosen") == "rational_fit"
    g = (records.join(feats.withColumn("chosen", cascade()).select(*WINDOW_CELL, "chosen"), list(WINDOW_CELL))
         .groupBy(*keys, "chosen").agg(*[of(m, c).alias(f"{c}_{tag}") for m, tag in (
             (BASE, "p"), ("rational_fit", "r"), ("last_value", "l")) for c in ("error", "valid", "catastrophic", "perturb_iqr")]))
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).cast("double").alias("t"))
                                 for i, t in enumerate(thresholds)])).alias("s")
    g = g.select("*", levels)
    iqr = F.when(routed, F.col("perturb_iqr_r")).otherwise(F.col("perturb_iqr_p"))
    to_last = F.coalesce(F.col("s.t").isNotNull() & finite(iqr) & (iqr > F.col("s.t")), F.lit(False))

    def pick(c):
        return F.when(to_last, F.col(f"{c}_l")).when(routed, F.col(f"{c}_r")).otherwise(F.col(f"{c}_p"))

    rows = g.select("target_g", F.col("s.i").alias("screen"), F.col("s.t").alias("iqr_threshold"),
                    pick("error").alias("error"), F.coalesce(pick("valid"), F.lit(0)).alias("valid"),
                    F.coalesce(pick("catastrophic"), F.lit(1)).alias("catastrophic"), F.col("error_l").alias("E_last"))
    return error_panel(rows, ["target_g", "screen", "iqr_threshold"])
