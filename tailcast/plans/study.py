"""Record-producing plans: curves -> windows -> forecasts -> scored records."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.operators import curves as C
from tailcast.operators import diagnostics as D
from tailcast.operators import panels as P
from tailcast.operators import ranking as R
from tailcast.operators import rules as RU
from tailcast.operators.features import cell_features as mean_features
from tailcast.operators.features import features
from tailcast.operators.forecast import packed, unpacked, with_gap_targets, with_step_targets
from tailcast.operators.methods import method_table
from tailcast.operators.scoring import best_reference, improvement, score
from tailcast.session import stage
from tailcast.settings import FAMILY_OF, FEATURES, METHODS, REFERENCE_METHODS, SMALL_POOL
from tailcast.sources import tables

STEP_DEPTHS = (30, 60, 90, 120, 150)
STEP_TARGETS = (200, 300, 400)
GAP_DEPTHS = (30, 60, 90)
GAP_FRACTIONS = (0.7, 0.5, 0.1)
NOISE = (0.0, 0.005)
HEADLINE_G = 0.5
RANK_DIGITS = 9

SLICE_METHODS = ("linear", "log_linear", "constant_assumed", "constant_oracle",
                 "window_mean", "window_min", "last_value")
MULTI_TERM_METHODS = ("richardson_2", "richardson_3", "double_exp_fit")       # iterative fits: tables of their own
STUDY_METHODS = tuple(m for m, _, _ in METHODS if m not in MULTI_TERM_METHODS)


def curves(spark: SparkSession, sf_dir: str, kind: str = "se") -> DataFrame:
    """Derived curves as a table: every study reads them more than once.  Rows
    are sorted by step inside each file, so prefix reads (step <= depth) and
    target reads skip row groups by their statistics."""
    return stage(spark, f"curves-{kind}", sf_dir, lambda: tables.supplier_curves(
        spark, sf_dir, kind, days(spark, sf_dir)).sortWithinPartitions("step", "curve_id"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only pass over the transaction table: quantities per supplier and day."""
    return stage(spark, "days", sf_dir, lambda: tables.supplier_days(spark, sf_dir))


def step_windows(spark, curve_table: DataFrame, depths=STEP_DEPTHS, targets=STEP_TARGETS,
                 window_len=C.WINDOW_LEN, noise=(0.0,), mode="winmin", true_limit=None) -> DataFrame:
    """Windows with the true values at fixed steps attached.  Prefixes and
    targets are both grouped by curve, so they meet without another shuffle of
    the windows."""
    packed = C.prefixes(curve_table, max(depths)).join(C.step_targets(curve_table, targets), "curve_id")
    return with_step_targets(C.cut_windows(packed, depths, window_len, noise, mode, true_limit))


def gap_windows(spark, curve_table: DataFrame, horizons: DataFrame, depths=GAP_DEPTHS,
                window_len=C.WINDOW_LEN, noise=NOISE, mode="winmin", true_limit=None) -> DataFrame:
    packed = C.prefixes(curve_table, max(depths)).join(C.nest_horizons(horizons), "curve_id")
    return with_gap_targets(C.cut_windows(packed, depths, window_len, noise, mode, true_limit))


def records_of(spark, windows: DataFrame, methods) -> DataFrame:
    return scored(spark, packed(windows, methods), methods)


def scored(spark, rows: DataFrame, methods, more=()) -> DataFrame:
    """Records from packed estimates.  Stages hold the packed form, an eighth of the records' size; scores are a
    projection of it, of which a query computes the columns it reads."""
    dim = F.broadcast(method_table(spark).drop("registry_index"))
    return score(unpacked(rows, methods, more)).join(dim, "method", "left")


# ---- staged tables -----------------------------------------------------------
def horizons(spark, sf_dir) -> DataFrame:
    return stage(spark, "horizons", sf_dir, lambda: C.gap_horizons(
        curves(spark, sf_dir), list(GAP_DEPTHS), GAP_FRACTIONS, 0.0))


def gap_packed(spark, sf_dir, methods=STUDY_METHODS) -> DataFrame:
    return stage(spark, "gap-records", f"{sf_dir}|{methods}", lambda: packed(
        gap_windows(spark, curves(spark, sf_dir), horizons(spark, sf_dir), true_limit=F.lit(0.0)), methods))


def gap_records(spark, sf_dir, methods=STUDY_METHODS) -> DataFrame:
    """The main benchmark: gap horizons x noise on the standard-error curves,
    whose limit is 0."""
    return scored(spark, gap_packed(spark, sf_dir, methods), methods)


def step_packed(spark, sf_dir, methods=STUDY_METHODS) -> DataFrame:
    """The recorded-curve study: fixed target steps on the running-mean curves,
    whose limit is not known to anyone."""
    def build():
        c = curves(spark, sf_dir, "mean")
        low = C.curve_minima(c).select("curve_id", "argmin_round", "rise_from_min")
        return packed(step_windows(spark, c), methods).join(low.hint("merge"), "curve_id").withColumn(
            "post_min_target", (F.col("n_f") > F.col("argmin_round")).cast("int"))
    return stage(spark, "step-records", f"{sf_dir}|{methods}", build)


def step_records(spark, sf_dir, methods=STUDY_METHODS) -> DataFrame:
    return scored(spark, step_packed(spark, sf_dir, methods), methods)


# ---- features, diagnostics and tables shared by several queries -----------------
DIAG_METHODS = tuple(m for m in STUDY_METHODS if FAMILY_OF[m] != "ensemble")   # composites weigh shifted windows themselves
DIAG_POOL = SMALL_POOL
DIAG_DEPTHS = GAP_DEPTHS


def gap_features(spark, sf_dir) -> DataFrame:
    def build():
        w = gap_windows(spark, curves(spark, sf_dir), horizons(spark, sf_dir), true_limit=F.lit(0.0))
        return features(w).drop("xs", "ys", "targets")
    return stage(spark, "gap-features", sf_dir, build)


def step_features(spark, sf_dir) -> DataFrame:
    return stage(spark, "step-features", sf_dir, lambda: features(
        step_windows(spark, curves(spark, sf_dir, "mean"))).drop("xs", "ys", "targets"))


def cell_features(spark, sf_dir) -> DataFrame:
    return stage(spark, "cell-features", sf_dir, lambda: mean_features(gap_features(spark, sf_dir)))


def cells(spark, sf_dir) -> DataFrame:
    """Cells of the benchmark: the second materialised boundary, a small table."""
    return stage(spark, "cells", sf_dir, lambda: P.packed_cell_table(
        gap_packed(spark, sf_dir), STUDY_METHODS, method_table(spark), lambda: gap_records(spark, sf_dir)))


def diag_windows(spark, sf_dir) -> DataFrame:
    return gap_windows(spark, curves(spark, sf_dir), horizons(spark, sf_dir), DIAG_DEPTHS, true_limit=F.lit(0.0))


def diag_packed(spark, sf_dir) -> DataFrame:
    """Estimates of the diagnostic methods with both stability spreads, one row per (window, target)."""
    return stage(spark, "diag-records", sf_dir, lambda: D.packed_with_spreads(diag_windows(spark, sf_dir), DIAG_METHODS))


def diag_records(spark, sf_dir, beside: DataFrame | None = None) -> DataFrame:
    """Benchmark records of the diagnostic methods with both stability spreads; ``beside`` has further columns of the windows,
    which meet them before there is a row per method."""
    rows = diag_packed(spark, sf_dir)
    return scored(spark, rows if beside is None else rows.join(beside, ["curve_id", "depth", "noise"]), DIAG_METHODS, D.SPREADS)


def pooled(spark, sf_dir) -> DataFrame:
    """Pooled tables of both sets, ranked (overall and among the accelerators)."""
    def build():
        c = cells(spark, sf_dir)
        t = P.pooled_table(c, ("is_holdout", "method", "target_g"))
        r = R.assign_ranks(t, groups=("is_holdout", "target_g"), digits=RANK_DIGITS)
        return R.rank_accelerators(r, ("is_holdout", "target_g"), digits=RANK_DIGITS).withColumn(
            "regime_set", F.when(F.col("is_holdout") == 1, "holdout").otherwise("core"))
    return stage(spark, "pooled", sf_dir, build)


def recorded_summary(spark, sf_dir) -> DataFrame:
    """One row per recorded cell: the cascade's choice and its scores."""
    def build():
        f = step_features(spark, sf_dir).select("curve_id", "depth", *FEATURES).withColumn("selected_method", RU.cascade())
        # the summary reads the two routed methods and the references: their estimates meet the routes, one row per window and target
        named = tuple(m for m in STUDY_METHODS if m in RU.ROUTES or m in REFERENCE_METHODS)
        rows = step_packed(spark, sf_dir).withColumn("ests", F.array(*[F.get("ests", F.lit(STUDY_METHODS.index(m))) for m in named]))
        rows = scored(spark, rows.join(f.select("curve_id", "depth", "selected_method"), ["curve_id", "depth"]), named)
        keys = ["curve_id", "family", "depth", "n_f"]

        def of(m, col):
            return F.max(F.when(F.col("method") == m, F.col(col)))
        chosen = F.col("method") == F.col("selected_method")

        def picked(col):
            return F.max(F.when(chosen, F.col(col)))
        s = rows.groupBy(*keys, "selected_method", "argmin_round", "rise_from_min", "post_min_target").agg(
            F.max("true_val").alias("true_val"), F.max("curr_err").alias("current_err"), F.max("ref_error").alias("ref_error"),
            best_reference().alias("ref_best_method"), of("richardson_1", "error").alias("richardson_err"),
            of("rational_fit", "error").alias("rational_err"), picked("estimate").alias("cascade_pred"),
            picked("error").alias("cascade_err"), picked("skill").alias("cascade_skill"),
            *[picked(f"{k}_vs_{t}").alias(f"cascade_{k}_vs_{t}") for t in P.TAGS for k in ("skill", "win")])
        s = s.withColumn("improvement", improvement(F.col("cascade_err"), F.col("current_err")))
        w = step_windows(spark, curves(spark, sf_dir, "mean"))
        iqr = D.perturb_iqr(w, ("richardson_1", "rational_fit"), fewest=3).select(
            "curve_id", "depth", "n_f", F.col("method").alias("selected_method"), "perturb_iqr")
        return s.join(iqr.hint("merge"), ["curve_id", "depth", "n_f", "selected_method"], "left")
    return stage(spark, "recorded-summary", sf_dir, build)
