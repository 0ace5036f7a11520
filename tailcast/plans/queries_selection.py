"""Selection by trial, classification, ladders and sweeps as queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tailcast.functions.quantiles import grouped
from tailcast.operators import classify as M
from tailcast.operators import curves as C
from tailcast.operators import ladders as LD
from tailcast.operators import panels as P
from tailcast.operators import pairing as H
from tailcast.operators import quality as Q
from tailcast.operators import ranking as R
from tailcast.operators import selection as L
from tailcast.operators import stats as K
from tailcast.operators import sweeps as W
from tailcast.operators.features import features
from tailcast.operators.forecast import packed
from tailcast.operators.methods import classical_methods
from tailcast.operators.scoring import score
from tailcast.plans import study as ST
from tailcast.plans.catalog import query
from tailcast.plans.queries_analysis import _lead
from tailcast.session import settled, stage
from tailcast.sources import tables
from tailcast.streaming import live

CELL = list(L.CELL)


# ---- L: selection by trial ---------------------------------------------------
def _pools(spark, sf):
    return stage(spark, "pools", sf, lambda: L.candidate_pools(spark, _lead(spark, sf), ST.STUDY_METHODS, classical_methods()))


def _uncapped(spark, sf):
    return L.uncapped_cells(ST.cells(spark, sf))


def _rows(spark, sf):
    return stage(spark, "trial-rows", sf, lambda: L.trial_records(ST.gap_records(spark, sf), _uncapped(spark, sf), _pools(spark, sf)))


def _selection(spark, sf):
    def keep(name, df):
        return stage(spark, f"trial-{name}", sf, lambda: df)
    return stage(spark, "selection-cells", sf, lambda: L.selection_cells(
        L.check_flags(ST.gap_records(spark, sf)), _uncapped(spark, sf), _pools(spark, sf), digits=ST.RANK_DIGITS, keep=keep))


@query("l1_uncapped_cells")
def _(spark, sf):
    return _uncapped(spark, sf)


@query("l2_trial_records")
def _(spark, sf):
    return _rows(spark, sf).groupBy("pool", "method").agg(F.count(F.lit(1)).alias("n"), F.count("err").alias("n_valid"), F.sum("cat").alias("n_cat"))


@query("l3_one_pilot")
def _(spark, sf):
    return L.choose_one_pilot(_rows(spark, sf), ST.RANK_DIGITS)


@query("l4_many_pilots")
def _(spark, sf):
    runs = L.cell_runs(L.run_facts(ST.gap_records(spark, sf), _uncapped(spark, sf)))
    return L.choose_many_pilots(_rows(spark, sf), runs, digits=ST.RANK_DIGITS)


@query("l5_selection_cells")
def _(spark, sf):
    return _selection(spark, sf)


def _pooled_selection(spark, sf):
    return L.pooled_selection(_selection(spark, sf), C.noise_class(F.col("noise")))


@query("l6_pooled_selection")
def _(spark, sf):
    return _pooled_selection(spark, sf)


@query("l7_agreement_check")
def _(spark, sf):
    return L.require_agreement(L.agreement_check(_pooled_selection(spark, sf), ST.pooled(spark, sf)))


@query("l8_family_selection")
def _(spark, sf):
    return L.family_selection(_selection(spark, sf), "lead", ST.HEADLINE_G)


@query("l9_methods_chosen")
def _(spark, sf):
    return L.methods_chosen(_selection(spark, sf), "lead", ST.HEADLINE_G)


@query("l10_leave_one_depth_out")
def _(spark, sf):
    return L.recorded_folds(ST.step_records(spark, sf), _pools(spark, sf), "depth", ["curve_id"], digits=ST.RANK_DIGITS)


@query("l10_leave_one_family_out")
def _(spark, sf):
    return L.recorded_folds(ST.step_records(spark, sf), _pools(spark, sf), "family", [], digits=ST.RANK_DIGITS)


@query("l10_fold_summary")
def _(spark, sf):
    f = L.recorded_folds(ST.step_records(spark, sf), _pools(spark, sf), "depth", ["curve_id"], digits=ST.RANK_DIGITS)
    return L.fold_summary(f.withColumns({c: F.round(c, 9) for c in ("chosen_score", "default_score")}))


# ---- M: classification -------------------------------------------------------
@query("m1_classifier_table")
def _(spark, sf):
    return M.classifier_table(ST.gap_features(spark, sf))


@query("m2_folds")
def _(spark, sf):
    t = M.classifier_table(ST.gap_features(spark, sf))
    out = None
    for p in M.PROTOCOLS:
        part = M.folds(t, p).select(F.lit(p).alias("protocol"), "family", "depth", "noise", F.col("fold").cast("int").alias("fold"))
        out = part if out is None else out.unionByName(part)
    return out


@query("m3_family_classifier")
def _(spark, sf):
    t = M.classifier_table(ST.gap_features(spark, sf))
    out = None
    for p in M.PROTOCOLS:
        part = M.predictions(t, p)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return M.confusion(out)


# ---- D22, E, F20, F35, N2: ladders ---------------------------------------------
REGISTERED_LADDERS = {ladder: tuple(k for name, k in LD.REGISTERED if name == ladder) for ladder in LD.LADDERS}


def _ladder_windows(spark, sf):
    return ST.gap_windows(spark, ST.curves(spark, sf), ST.horizons(spark, sf), true_limit=F.lit(0.0))


LADDER_RECORD = ["curve_id", "family", "is_holdout", "depth", "noise", "target_g", "method", "error", "valid", "catastrophic", "E_last", "capped"]


def _ladder_records(spark, sf):
    """Every order of every transformation family, scored: evaluated once, read by all ladder tables."""
    return stage(spark, "ladder-records", sf, lambda: P.exclude_capped(score(LD.ladder_estimates(_ladder_windows(spark, sf)))).select(*LADDER_RECORD, "ladder", "order"))


def _fit_ladder_records(spark, sf):
    return stage(spark, "fit-ladder-records", sf, lambda: P.exclude_capped(score(LD.fit_ladder(_ladder_windows(spark, sf)))).select(*LADDER_RECORD, "ladder", "p", "q", "exponent"))


@query("d22_order_ladders")
def _(spark, sf):
    """Every order of every transformation family, scored and aggregated."""
    return P.error_panel(_ladder_records(spark, sf), ["ladder", "order", "target_g"])


@query("d22_fit_ladders")
def _(spark, sf):
    return P.error_panel(_fit_ladder_records(spark, sf), ["ladder", "p", "q", "exponent", "target_g"])


def _ladder_cells(spark, sf):
    return stage(spark, "ladder-cells", sf, lambda: P.error_panel(
        _ladder_records(spark, sf), ["ladder", "order", "method", *CELL]).withColumn("win_rate_vs_last", P.rate4("win_rate_vs_last")))


@query("f20_ladder_variants")
def _(spark, sf):
    """Every order of every ladder, pooled and per noise level, with the number of cells."""
    both = _ladder_records(spark, sf).select("*", F.explode(F.array(F.col("noise").cast("string"), F.lit("pooled"))).alias("noise_level"))
    return P.error_panel(both, ["method", "noise_level"], [F.count_distinct(F.struct(*CELL)).alias("n_cells")])


@query("f31_ladder_variants_under_noise")
def _(spark, sf):
    """Per ladder: orders clearly below the last value's error, orders that mostly win, and the lowest."""
    keys = ["target_g", "noise"]
    per = grouped(_ladder_cells(spark, sf), ["ladder", "order", *keys], [P.mean_rate(F.col("win_rate_vs_last")).alias("w")], {"e": ("med_error", 0.5)})
    records = _ladder_records(spark, sf)
    last = grouped(grouped(records, CELL, [], {"m": ("E_last", 0.5)}), keys, [], {"e_last": ("m", 0.5)})
    return per.join(last, keys).groupBy("ladder", *keys).agg(
        F.count(F.lit(1)).alias("n_orders"), F.count(F.when(F.col("e") < F.lit(0.9) * F.col("e_last"), 1)).alias("n_below"), F.count(F.when(F.col("w") > 0.6, 1)).alias("n_win"),
        F.min_by("order", F.when(F.col("e").isNotNull(), F.struct(F.round("e", 9), F.col("order")))).alias("lowest"), F.min("e").alias("lowest_error"))


@query("f35_best_ladder_order")
def _(spark, sf):
    per = grouped(_ladder_cells(spark, sf).filter("is_holdout = 0"), ["ladder", "order", "target_g"], [], {"e": ("med_error", 0.5)})
    return per.groupBy("ladder", "target_g").agg(
        F.min_by("order", F.when(F.col("e").isNotNull(), F.struct(F.round("e", 9), F.col("order")))).alias("best"),
        F.min("e").alias("best_error"), F.count(F.lit(1)).alias("n_orders"))


@query("s6_live_event_forecasts", 4)
def _(spark, sf):
    """What the stream of forecasts ends with: the last points of every event curve, and forecasts from them."""
    points = tables.event_curves(spark, sf).select("curve_id", "step", "value")
    return live.live_forecasts(live.tails(points), (10, 50), ("linear", "window_mean", "window_min", "last_value"))


@query("n2_variant_agreement")
def _(spark, sf):
    """Ladder orders that are registered methods agree with the registry."""
    names = F.lit(None).cast("string")
    for (lad, k), m in LD.REGISTERED.items():
        names = F.when((F.col("ladder") == lad) & (F.col("order") == k), m).otherwise(names)
    keys = ["curve_id", "depth", "noise", "target_g"]
    v = LD.ladder_estimates(_ladder_windows(spark, sf), REGISTERED_LADDERS).withColumn("method", names).filter("method IS NOT NULL")
    reg = ST.gap_records(spark, sf).withColumn("estimate_raw", F.col("prediction_raw")).join(
        F.broadcast(v.select("method").distinct()), "method", "left_semi")
    return Q.variant_agreement(v, reg, keys)


# ---- W: sweeps, F18, F19, F25, H16 ----------------------------------------------
MODES = ("zero", "half", "oracle", "double", "winmin")
LENGTHS = (20, 40, 60, 80, 100)
# fixed values: methods whose result may depend on the assumed limit; sums of terms have a query of their own
CONSUMERS = ("richardson_1", "single_exp_fit", "rational_fit", "log_fit", "log_linear", "stability_weighted", "median_ensemble", "constant_assumed")
SWEPT = CONSUMERS + ("last_value", "window_mean", "window_min")


def _mode_base(spark, sf):
    return ST.gap_windows(spark, ST.curves(spark, sf), ST.horizons(spark, sf), true_limit=F.lit(0.01))


def _mode_windows(spark, sf):
    return W.across_modes(_mode_base(spark, sf), MODES)


def _mode_records(spark, sf):
    return stage(spark, "mode-records", sf, lambda: ST.records_of(spark, _mode_windows(spark, sf), SWEPT))


def _mode_decisions(spark, sf):
    return stage(spark, "mode-decisions", sf, lambda: W.decisions(features(_mode_windows(spark, sf)), "assumed_mode"))


@query("w1_cascade_by_mode")
def _(spark, sf):
    return W.cascade_sweep(_mode_records(spark, sf), _mode_decisions(spark, sf), "assumed_mode")


@query("f18_cascade_by_mode_and_family")
def _(spark, sf):
    return W.cascade_sweep(_mode_records(spark, sf), _mode_decisions(spark, sf), "assumed_mode", ("family",))


def _consumers(spark, sf):
    return W.consumer_table(_mode_records(spark, sf).filter(F.col("method").isin(*CONSUMERS)))


@query("w2_consumers_by_mode")
def _(spark, sf):
    return _consumers(spark, sf).select("assumed_mode", "method", "target_g", "noise_level", "regime_set", "n", "valid_rate", "cat_rate",
                                        "med_error", "med_skill", "win_rate_vs_last")


@query("w2_multi_term_consumers")
def _(spark, sf):
    """The sums of terms under every assumed limit: the other three of the eleven.  Their fits read the window alone, so a window
    is fitted once and its estimates meet every mode, whose limits they are scored against."""
    fitted = settled(packed(_mode_base(spark, sf), ST.MULTI_TERM_METHODS), "term-estimates")
    recs = ST.scored(spark, W.across_modes(fitted, MODES), ST.MULTI_TERM_METHODS)
    return W.consumer_table(recs).select("assumed_mode", "method", "target_g", "noise_level", "regime_set", "n", "valid_rate", "cat_rate",
                                         "med_error", "med_skill", "win_rate_vs_last")


@query("f19_consumer_aggregate")
def _(spark, sf):
    return _consumers(spark, sf).filter("noise_level = 'all'").select(
        "assumed_mode", "method", "target_g", "regime_set", *[f"win_rate_vs_{t}" for t in P.TAGS])


@query("f25_mode_spread")
def _(spark, sf):
    c = _consumers(spark, sf).filter("noise_level = 'all'")
    return P.mode_spread(c, ["method", "regime_set", "target_g"])


def _length_windows(spark, sf):
    return W.across_lengths(ST.gap_windows(spark, ST.curves(spark, sf), ST.horizons(spark, sf), window_len=max(LENGTHS), true_limit=F.lit(0.0)), LENGTHS)


@query("w3_cascade_by_window_length")
def _(spark, sf):
    w = _length_windows(spark, sf)
    recs = stage(spark, "length-records", sf, lambda: ST.records_of(spark, w, ("richardson_1", "rational_fit", "last_value", "window_mean", "window_min")))
    routed = stage(spark, "length-decisions", sf, lambda: W.decisions(features(w), "window_len"))
    return W.cascade_sweep(recs, routed, "window_len")


@query("h16_leading_summary")
def _(spark, sf):
    p = ST.pooled(spark, sf)
    spread = P.mode_spread(_consumers(spark, sf).filter("noise_level = 'all' AND regime_set = 'core' AND target_g = 0.5"), ["method"])
    return H.leading_summary(_lead(spark, sf).select("method", F.col("position").cast("int").alias("position")), p.filter("is_holdout = 0"),
                             p.filter("is_holdout = 1"), spread, ST.step_records(spark, sf), ST.HEADLINE_G)
