"""Panels, ranks, joins, rules, ensembles and statistics as queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tailcast.operators import curves as C
from tailcast.operators import ensembles as EN
from tailcast.operators import pairing as H
from tailcast.operators import panels as P
from tailcast.operators import quality as Q
from tailcast.operators import ranking as R
from tailcast.operators import rules as RU
from tailcast.operators import stats as K
from tailcast.operators.methods import classical_methods, roster_by_family
from tailcast.plans import study as ST
from tailcast.plans.catalog import query
from tailcast.session import for_every_task

CELL = list(P.GAP_CELL)
PANEL_KEYS = ["method", "target_g"]


@query("flagship_method_ranking")
def _(spark, sf):
    """Forecast at fixed steps, score, aggregate to cells, pool, rank."""
    w = ST.step_windows(spark, ST.curves(spark, sf, "se"), true_limit=F.lit(0.0))
    recs = ST.records_of(spark, w, ST.SLICE_METHODS)
    cells = P.cell_table(recs, ("family", "is_holdout", "depth", "noise", "n_f"))
    pooled = P.pooled_table(cells, ("method", "n_f"))
    ranked = R.assign_ranks(pooled, groups=("n_f",), digits=ST.RANK_DIGITS)
    return ranked.select(F.col("n_f").alias("target"), "method", "method_type", "n_cells", "valid_rate", "cat_rate", "med_error",
                         "med_skill", F.col("rank").cast("int").alias("rank"), "rank_eligible")


# ---- F: aggregates -----------------------------------------------------------
@query("f1_error_panel")
def _(spark, sf):
    return P.error_panel(ST.gap_records(spark, sf), PANEL_KEYS)


@query("f3_cell_aggregate")
def _(spark, sf):
    return ST.cells(spark, sf).select("method", *CELL, "n_total", "n_valid", "valid_rate", "cat_rate", "med_error", "mean_error",
                                      "med_skill", "n_f", "achieved_g", "L_hat", "capped", "win_rate_vs_last")


@query("f4_skill_aggregates")
def _(spark, sf):
    return P.skill_aggregates(ST.gap_records(spark, sf), PANEL_KEYS)


@query("f5_pooled_table")
def _(spark, sf):
    return ST.pooled(spark, sf).select("regime_set", "method", "target_g", "valid_rate", "cat_rate", "med_error", "med_skill",
                                       "n_families", "n_cells", "n_capped_excluded", *P.SKILL_MEDIANS, *P.WIN_RATES)


@query("f6_capped_block")
def _(spark, sf):
    return P.capped_block(ST.cells(spark, sf), ["family", "is_holdout", "target_g", "method"], ["med_error", "med_skill", "valid_rate"])


def _families(spark, sf):
    return sorted(r.family for r in ST.cells(spark, sf).select("family").distinct().collect())


@query("f7_heat_map")
def _(spark, sf):
    fams = _families(spark, sf)
    t = P.heat_map(ST.cells(spark, sf).filter("target_g = 0.5"), fams)
    return t.withColumnsRenamed({f: "err_" + f.lower().replace(" ", "_") for f in fams})


@query("f7_heat_map_valid")
def _(spark, sf):
    fams = _families(spark, sf)
    t = P.heat_map(ST.cells(spark, sf).filter("target_g = 0.5"), fams, "valid_rate", "mean")
    return t.withColumnsRenamed({f: "valid_" + f.lower().replace(" ", "_") for f in fams})


@query("f8_family_table")
def _(spark, sf):
    return P.family_table(ST.cells(spark, sf))


@query("f9_validity_by_depth")
def _(spark, sf):
    return P.validity_by_depth(ST.gap_records(spark, sf))


@query("f10_validity_over_noise")
def _(spark, sf):
    return P.validity_over_noise(P.validity_by_depth(ST.gap_records(spark, sf)), ST.GAP_DEPTHS)


@query("f11_effective_sample")
def _(spark, sf):
    return P.effective_sample(ST.cells(spark, sf))


def _excluded(spark, sf):
    return EN.derive_excluded(ST.cells(spark, sf))


@query("f12_invalid_rates")
def _(spark, sf):
    return P.invalid_rates(ST.gap_records(spark, sf), _excluded(spark, sf).filter("dangerous = 1"))


@query("f13_tercile_statistics")
def _(spark, sf):
    """Per bin of the curve's last value: panel of every method, plus a pooled
    row of the classical methods."""
    ends = C.curve_minima(ST.curves(spark, sf, "se")).select("curve_id", C.tercile(F.col("value_at_round") * 2.0).alias("bin"))
    few = for_every_task(ends)
    recs = P.exclude_capped(ST.gap_records(spark, sf)).join(ends if few is None else few, "curve_id").filter("bin IS NOT NULL")
    one = P.error_panel(recs, ["bin", "method", "target_g"])
    cls = P.error_panel(recs.filter(F.col("method").isin(*classical_methods())), ["bin", "target_g"])
    return one.unionByName(cls.withColumn("method", F.lit("classical (pooled)")))


@query("f16_recorded_strata")
def _(spark, sf):
    s = ST.recorded_summary(spark, sf)
    t = P.strata(s)
    lab = F.when(F.col("post_min_target") == 1, "post_min").otherwise("pre_min")
    rows = s.select("perturb_iqr", (F.col("cascade_skill") >= 1).alias("fail"), F.explode(F.array(F.lit("all"), lab)).alias("stratum"))
    auc = K.auc_fail_vs_success(rows.filter("fail IS NOT NULL"), ["stratum"], "perturb_iqr", "fail")
    return t.join(auc.select("stratum", F.col("auc").alias("perturb_auc")), "stratum", "left")


@query("f17_denominator_counts")
def _(spark, sf):
    return K.denominator_counts(_targets(spark, sf))


@query("f20_ladder_panels")
def _(spark, sf):
    """Variants pooled and per noise level, with the number of cells."""
    recs = P.exclude_capped(ST.gap_records(spark, sf)).filter(F.col("method").isin(*classical_methods()))
    both = recs.select("*", F.explode(F.array(F.col("noise").cast("string"), F.lit("pooled"))).alias("noise_level"))
    return P.error_panel(both, ["method", "noise_level"], [F.count_distinct(F.struct(*CELL)).alias("n_cells")])


@query("f21_value_counts")
def _(spark, sf):
    return P.value_counts(ST.recorded_summary(spark, sf), "ref_best_method")


@query("f21_crosstab")
def _(spark, sf):
    s = ST.recorded_summary(spark, sf).withColumn("fail", F.coalesce(F.col("cascade_skill") >= 1, F.lit(False)).cast("int"))
    return s.cube("post_min_target", "fail").agg(F.count(F.lit(1)).alias("n"))


@query("f22_skill_summary")
def _(spark, sf):
    return P.skill_summary(ST.cells(spark, sf))


@query("f23_final_loss_by_depth")
def _(spark, sf):
    return P.final_loss(ST.step_records(spark, sf), ("last_value", "rational_fit", "single_exp_fit"), 400)


@query("f24_fixed_method_blocks")
def _(spark, sf):
    return P.fixed_method_blocks(ST.step_records(spark, sf), ("last_value", "rational_fit", "single_exp_fit"))


@query("f26_noop_statistics")
def _(spark, sf):
    return P.noop_statistics(ST.cells(spark, sf), classical_methods(), C.noise_class(F.col("noise")))


@query("f27_reduction_by_depth")
def _(spark, sf):
    """Reduction of the mean error against the last value, per depth and overall."""
    s = ST.recorded_summary(spark, sf).filter("cascade_err IS NOT NULL")
    return s.rollup("depth").agg(F.avg("cascade_err").alias("mean_cascade"), F.avg("current_err").alias("mean_current")).withColumn(
        "reduction", F.lit(1.0) - F.try_divide(F.col("mean_cascade"), F.col("mean_current")))


@query("f28_baseline_summary")
def _(spark, sf):
    return P.baseline_summary(ST.pooled(spark, sf))


@query("f29_capped_inventory")
def _(spark, sf):
    return P.capped_inventory(ST.cells(spark, sf))


@query("f30_wins_everywhere")
def _(spark, sf):
    return P.win_everywhere(ST.step_records(spark, sf), "rational_fit")


@query("f31_ladders_under_noise")
def _(spark, sf):
    c = P.exclude_capped(ST.cells(spark, sf))
    keys = ["target_g", "noise"]
    per = c.filter(F.col("method").isin(*classical_methods(), "last_value")).groupBy(*keys, "method").agg(
        F.percentile("med_error", F.lit(0.5)).alias("e"), P.mean_rate(F.col("win_rate_vs_last")).alias("w"))
    ref = per.filter("method = 'last_value'").select(*keys, F.col("e").alias("e_last"))
    return per.filter("method <> 'last_value'").join(F.broadcast(ref), keys).groupBy(*keys).agg(
        F.count(F.when(F.col("e") < 0.9 * F.col("e_last"), 1)).alias("n_below"), F.count(F.when(F.col("w") > 0.6, 1)).alias("n_win"),
        F.min_by("method", F.struct(F.round("e", 9), F.col("method"))).alias("lowest"), F.min("e").alias("lowest_error"))


@query("f32_recorded_means")
def _(spark, sf):
    s = ST.recorded_summary(spark, sf)
    return s.groupBy("depth", "n_f").agg(
        F.avg("cascade_err").alias("mean_cascade"), F.avg("richardson_err").alias("mean_richardson"), F.avg("rational_err").alias("mean_rational"),
        F.avg("current_err").alias("mean_current"), F.avg((F.col("cascade_skill") < 1).cast("double")).alias("share_beating"))


@query("f33_phase_diagram")
def _(spark, sf):
    return K.phase_diagram(_targets(spark, sf))


@query("f34_roster_by_family")
def _(spark, sf):
    used = [r.method for r in ST.gap_records(spark, sf).select("method").distinct().collect()]
    return roster_by_family(spark, used)


@query("f35_best_order")
def _(spark, sf):
    p = ST.pooled(spark, sf).filter("is_holdout = 0 AND is_trivial = 0")
    return p.groupBy("method_family", "target_g").agg(
        F.min_by("method", F.when(F.col("med_error").isNotNull(), F.struct(F.round("med_error", 9), F.col("method")))).alias("best"),
        F.min("med_error").alias("best_error"), F.count(F.lit(1)).alias("n_orders"))


@query("f36_worst_cells")
def _(spark, sf):
    s = ST.recorded_summary(spark, sf)
    return s.groupBy("family", "depth", "selected_method").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("cascade_skill") >= 1, 1)).alias("n_fail"),
        F.max_by("curve_id", F.struct(F.round("cascade_skill", 6), F.col("curve_id"))).alias("worst_curve"), F.max("cascade_skill").alias("worst_skill"))


# ---- G: ranks ----------------------------------------------------------------
@query("g1_assign_ranks")
def _(spark, sf):
    return ST.pooled(spark, sf).select("regime_set", "target_g", "method", "med_error", "valid_rate", "rank_eligible", F.col("rank").cast("int").alias("rank"))


@query("g2_unranked_block")
def _(spark, sf):
    return R.unranked_block(ST.pooled(spark, sf)).select("regime_set", "target_g", "method", "valid_rate", "cat_rate", "med_error", "n_cells")


@query("g3_rank_accelerators")
def _(spark, sf):
    return ST.pooled(spark, sf).filter("accel_rank IS NOT NULL").select("regime_set", "target_g", "method", F.col("accel_rank").cast("int").alias("accel_rank"))


@query("g4_best_per_family")
def _(spark, sf):
    return R.best_per_family(ST.cells(spark, sf), digits=ST.RANK_DIGITS)


def _sets(spark, sf):
    p = ST.pooled(spark, sf)
    return p.filter("is_holdout = 0"), p.filter("is_holdout = 1")


def _lead(spark, sf):
    core, hold = _sets(spark, sf)
    return R.leading_methods(core, hold, ST.HEADLINE_G, ST.RANK_DIGITS)


@query("g5_leading_methods")
def _(spark, sf):
    return _lead(spark, sf).select("method", *[F.col(c).cast("int").alias(c) for c in ("core_rank", "hold_rank", "position")])


@query("g6_top_ten")
def _(spark, sf):
    core, _ = _sets(spark, sf)
    return R.top_methods(core.filter(F.col("target_g") == ST.HEADLINE_G), 10, ST.RANK_DIGITS).select("method", "med_error", "valid_rate")


@query("g7_previous_value", 8)
def _(spark, sf):
    from tailcast.operators.features import previous_values
    return previous_values(ST.curves(spark, sf, "mean")).select("curve_id", "step", "diff", "ratio", "second_diff", "sign_change")


@query("g8_running_minimum", 8)
def _(spark, sf):
    return C.lower_envelope(ST.curves(spark, sf, "mean")).select("curve_id", "step", "envelope")


@query("g9_average_rank")
def _(spark, sf):
    r = ST.gap_records(spark, sf).filter("method = 'rational_fit' AND error IS NOT NULL").withColumn("e3", F.round("error", 3))
    return R.average_rank(r, ["target_g"], "e3", "avg_rank").select("target_g", "e3", "avg_rank", F.col("_c").alias("ties"))


@query("g10_family_best")
def _(spark, sf):
    return R.family_best(ST.cells(spark, sf), ST.pooled(spark, sf), digits=ST.RANK_DIGITS)


@query("g10_family_best_footer")
def _(spark, sf):
    return R.family_best_footer(R.family_best(ST.cells(spark, sf), ST.pooled(spark, sf), digits=ST.RANK_DIGITS))


@query("g11_ordered_output")
def _(spark, sf):
    """Cells in the fixed output order: set, target, family, depth, noise class."""
    from pyspark.sql import Window
    k = C.noise_class(F.col("noise"))
    cells = ST.cells(spark, sf).select(*CELL).distinct().withColumn("class_order", C.noise_class_order(k))
    w = Window.partitionBy("is_holdout", "target_g").orderBy("family", "depth", "class_order")
    return cells.withColumn("position", F.row_number().over(w)).orderBy("is_holdout", F.desc("target_g"), "family", "depth", "class_order")


# ---- H, S: joins and sets ---------------------------------------------------------
def _grid(spark, sf):
    cands = [m for m in ST.DIAG_POOL if m != "last_value"] + ["last_value"]
    return RU.candidate_grid(ST.cells(spark, sf), ST.cell_features(spark, sf), cands, ST.RANK_DIGITS)


def _choices(spark, sf):
    return RU.selector_choices(_grid(spark, sf))


@query("h1_chosen_records")
def _(spark, sf):
    j = H.chosen_records(_choices(spark, sf).filter("selector = 'phase2_cascade'").select(*RU.GRID_CELL, "method"),
                         ST.gap_records(spark, sf).drop("is_holdout", "capped"), RU.GRID_CELL)
    return H.require_complete(j).select(*RU.GRID_CELL, "curve_id", "method", "valid", "error")


@query("h2_record_pairing")
def _(spark, sf):
    return H.paired_comparison(ST.gap_records(spark, sf), "richardson_1", "rational_fit", ["family", "target_g"])


@query("h3_cell_median_pairing")
def _(spark, sf):
    return H.cell_medians(ST.gap_records(spark, sf), "richardson_1", "rational_fit")


@query("h4_features_to_cells")
def _(spark, sf):
    return _targets(spark, sf).join(ST.cell_features(spark, sf), ["family", "depth", "noise"], "left").select(
        "family", "depth", "noise", "target_g", "R_R_med", "log_log_slope", "richardson_r2")


@query("h5_evaluation_grid")
def _(spark, sf):
    return _grid(spark, sf).select(*RU.GRID_CELL, "n_f", "capped", "med_error__rational_fit", "med_error__levin_t2", "oracle_method", "curvature_idx")


@query("h6_flags_to_records")
def _(spark, sf):
    flags = RU.threshold_rule(ST.cell_features(spark, sf), "richardson_r2", "<", 0.9).select("family", "depth", "noise", "fired")
    return ST.gap_records(spark, sf).join(flags, ["family", "depth", "noise"]).groupBy("method", "fired").agg(
        F.count(F.lit(1)).alias("n"), F.sum("valid").alias("n_valid"))


@query("h7_outside_excluded")
def _(spark, sf):
    x = _excluded(spark, sf).filter("dangerous = 1").select("method")
    return ST.gap_records(spark, sf).join(F.broadcast(x), "method", "left_anti").groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("h8_cells_of_class")
def _(spark, sf):
    keep = ST.cells(spark, sf).filter("capped = 0 AND noise > 0").select(*CELL).distinct()
    return ST.gap_records(spark, sf).join(keep, CELL, "left_semi").groupBy("family", "depth", "target_g").agg(
        F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_error"))


@query("h9_range_join")
def _(spark, sf):
    """First later step at or below half of the value at the depth."""
    c = ST.curves(spark, sf)
    a = c.filter(F.col("step").isin(30, 60)).select("curve_id", F.col("step").alias("depth"), F.col("value").alias("v0"))
    b = c.select("curve_id", "step", "value")
    return a.join(b, "curve_id").filter((F.col("step") > F.col("depth")) & (F.col("value") <= 0.5 * F.col("v0"))).groupBy("curve_id", "depth").agg(
        F.min("step").alias("first_step"), F.count(F.lit(1)).alias("n_steps"))


@query("h10_rules_times_cells")
def _(spark, sf):
    return RU.rule_flags(ST.cell_features(spark, sf), RU.rule_table(spark)).groupBy("rule", "alternative").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("fired").alias("n_fired"))


@query("h11_table_comparison")
def _(spark, sf):
    """Clean against noisy records of the same windows."""
    r = ST.gap_records(spark, sf)
    keys = ["curve_id", "depth", "target_g", "method"]
    return H.compare_tables(r.filter("noise = 0"), r.filter("noise > 0"), keys, ["n_f", "valid", "catastrophic"])


@query("h12_head_to_head")
def _(spark, sf):
    return H.head_to_head(ST.cells(spark, sf), "rational_fit")


@query("h13_trial_counts")
def _(spark, sf):
    """Ordered pairs of distinct runs per cell, counted without building them."""
    n = ST.gap_records(spark, sf).groupBy(*CELL).agg(F.count_distinct("curve_id").alias("n_runs"))
    return n.withColumn("n_pairs", F.col("n_runs") * (F.col("n_runs") - 1))


@query("h14_side_by_side")
def _(spark, sf):
    core, hold = _sets(spark, sf)
    return R.side_by_side(core, hold).withColumns({c: F.col(c).cast("int") for c in ("core_accel_rank", "hold_accel_rank")})


@query("h15_rank_shift")
def _(spark, sf):
    core, hold = _sets(spark, sf)
    return R.rank_shift(core, hold).withColumns({c: F.col(c).cast("int") for c in ("core_rank", "hold_rank", "shift")})


@query("s1_row_union")
def _(spark, sf):
    core, hold = _sets(spark, sf)
    return core.unionByName(hold).groupBy("regime_set", "target_g").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s2_ordered_union")
def _(spark, sf):
    core, hold = _sets(spark, sf)
    a = core.filter((F.col("target_g") == ST.HEADLINE_G) & (F.col("accel_rank") <= 5)).select("method", F.col("accel_rank").alias("position"))
    b = hold.filter((F.col("target_g") == ST.HEADLINE_G) & (F.col("accel_rank") <= 5)).select("method", F.col("accel_rank").alias("position"))
    return R.ordered_union(a, b).withColumn("position", F.col("position").cast("int"))


@query("s3_set_difference")
def _(spark, sf):
    """Methods that enter or leave the excluded set when the floor moves to 0.95."""
    c = ST.cells(spark, sf)
    a = EN.derive_excluded(c).filter("dangerous = 1").select("method")
    b = EN.derive_excluded(c, 0.95).filter("dangerous = 1").select("method")
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


@query("s4_intersection")
def _(spark, sf):
    core, hold = _sets(spark, sf)
    return core.filter("accel_rank IS NOT NULL").select("target_g", "method").intersect(hold.filter("accel_rank IS NOT NULL").select("target_g", "method"))


@query("s5_distinct_keys")
def _(spark, sf):
    return ST.gap_records(spark, sf).select(*CELL, "capped").dropDuplicates(CELL[:4] + ["target_g", "capped"])


# ---- I: rules ------------------------------------------------------------------
@query("i1_cascade")
def _(spark, sf):
    return ST.gap_features(spark, sf).select("curve_id", "depth", "noise", RU.cascade().alias("selected_method"))


@query("i2_enhanced_cascade")
def _(spark, sf):
    return _choices(spark, sf).filter("selector = 'enhanced_cascade'").select(*RU.GRID_CELL, F.col("method").alias("selected_method"))


@query("i3_threshold_rule")
def _(spark, sf):
    return RU.threshold_rule(ST.cell_features(spark, sf), "log_log_slope", ">", -0.52).select("family", "depth", "noise", "fired")


def _rule_panels(spark, sf, target):
    cells = ST.cells(spark, sf).filter((F.col("capped") == 0) & (F.col("target_g") == target) & (F.col("method") == RU.BASE)).select(
        "family", "depth", "noise").distinct()
    feats = ST.cell_features(spark, sf).join(cells, ["family", "depth", "noise"], "left_semi")
    flags = RU.rule_flags(feats, RU.rule_table(spark, RU.CANDIDATE_RULES))
    return RU.rule_panels(flags, ST.gap_records(spark, sf).filter(F.col("target_g") == target))


@query("f2_rule_panel")
def _(spark, sf):
    cells = ST.cell_features(spark, sf)
    flags = RU.threshold_rule(cells, "log_log_slope", ">", -0.52).select(
        "family", "depth", "noise", F.lit(0).alias("rule"), F.lit("log_log_slope").alias("feature"), F.lit(">").alias("operator"),
        F.lit(-0.52).alias("threshold"), F.lit("rational_fit").alias("alternative"), "fired")
    return RU.rule_panels(flags, ST.gap_records(spark, sf).filter(F.col("target_g") == ST.HEADLINE_G))


@query("i4_candidate_rules")
def _(spark, sf):
    return _rule_panels(spark, sf, ST.HEADLINE_G)


def _selector_panels(spark, sf, keys=("selector", "target_g")):
    return RU.selector_panels(_choices(spark, sf), ST.gap_records(spark, sf).drop("capped", "is_holdout", "n_f"), keys)


@query("i5_selectors")
def _(spark, sf):
    return _selector_panels(spark, sf)


@query("i5_selectors_by_family")
def _(spark, sf):
    return _selector_panels(spark, sf, ("selector", "family", "target_g"))


@query("i6_hindsight_pick")
def _(spark, sf):
    return _grid(spark, sf).select(*RU.GRID_CELL, "oracle_method")


@query("i7_validity_spread")
def _(spark, sf):
    return RU.validity_spread(_selector_panels(spark, sf))


@query("i8_capped_choices")
def _(spark, sf):
    return RU.capped_choices(_choices(spark, sf), ST.cells(spark, sf)).select(*RU.GRID_CELL, "selector", F.col("method").alias("chosen_method"), "chosen_med_error")


@query("i9_screened_cascade")
def _(spark, sf):
    return RU.screened_cascade(ST.diag_records(spark, sf), ST.cell_features(spark, sf))


# ---- J: ensembles ---------------------------------------------------------------
def _selector_errors(spark, sf):
    from tailcast.session import stage
    return stage(spark, "selector-errors", sf, lambda: EN.packed_selector_errors(
        ST.diag_packed(spark, sf), ST.DIAG_METHODS, ST.cell_features(spark, sf), tuple(m for m in ST.DIAG_METHODS if m not in EN.TRIVIALS),
        _excluded(spark, sf), lambda: ST.diag_records(spark, sf), ST.DIAG_POOL))


WINDOW = ["curve_id", "depth", "noise", "target_g"]


@query("j1_hindsight_oracles")
def _(spark, sf):
    return _selector_errors(spark, sf).select(*WINDOW, "oracle_pool", "oracle_small")


@query("j2_equal_ensembles")
def _(spark, sf):
    return _selector_errors(spark, sf).select(*WINDOW, "equal_pool", "equal_small", "equal_ensemble_safe")


@query("j3_diagnostic_ensembles")
def _(spark, sf):
    return _selector_errors(spark, sf).select(*WINDOW, "diag_pool", "diag_small", "diag_ensemble_safe")


@query("j4_capped_weights")
def _(spark, sf):
    return _selector_errors(spark, sf).select(*WINDOW, "capped_diag_pool", "capped_diag_safe")


@query("j5_threshold_ensembles")
def _(spark, sf):
    return _selector_errors(spark, sf).select(*WINDOW, "threshold_ens_010", "threshold_ens_050", "threshold_ens_safe")


@query("j6_selector_errors")
def _(spark, sf):
    return _selector_errors(spark, sf).select(*WINDOW, *EN.SELECTORS)


def _long(spark, sf):
    return EN.selector_long(P.exclude_capped(_selector_errors(spark, sf)))


@query("f14_selector_summary")
def _(spark, sf):
    return EN.selector_summary(_long(spark, sf), ["is_holdout", "target_g"])


@query("f15_selector_slices")
def _(spark, sf):
    """By noise and by family from one long table."""
    rows = _long(spark, sf).select("*", F.explode(F.array(
        F.concat(F.lit("noise="), F.col("noise").cast("string")), F.concat(F.lit("family="), F.col("family")))).alias("slice"))
    return EN.selector_summary(rows, ["slice", "target_g"]).select(
        "selector", "slice", "target_g", "n_total", "n_valid", "cat_rate", "med_error", "med_skill", "win_rate_vs_last")


@query("j7_ablation")
def _(spark, sf):
    return EN.ablation(_selector_errors(spark, sf))


@query("j8_oracle_gap")
def _(spark, sf):
    return EN.oracle_gap(_selector_errors(spark, sf))


@query("j9_method_reliability")
def _(spark, sf):
    pool = tuple(m for m in ST.DIAG_METHODS if m not in EN.TRIVIALS)
    return EN.method_reliability(ST.diag_records(spark, sf), _excluded(spark, sf), pool, ST.HEADLINE_G).select(
        "method", "mean_piqr", "med_piqr", "mean_err", "med_skill", "win_rate_vs_last", "is_dangerous")


@query("j10_selector_comparison")
def _(spark, sf):
    return EN.selector_comparison(ST.diag_records(spark, sf), ST.HEADLINE_G, ST.DIAG_POOL).select(
        "selector", *P.PANEL, "med_skill")


@query("j11_excluded_set")
def _(spark, sf):
    return _excluded(spark, sf)


@query("j12_verify_excluded")
def _(spark, sf):
    """Stored artifact against a fresh derivation."""
    from tailcast.sources import sinks
    fresh = _excluded(spark, sf)
    path = sinks.write_excluded(fresh, sinks.scratch(spark, "excluded-check", sf))
    return H.compare_tables(sinks.load_excluded(spark, path), fresh.filter("eligible = 1"), ["method"], ["valid_rate", "n_cells", "dangerous"])


# ---- K: statistics ---------------------------------------------------------------
def _targets(spark, sf):
    return K.richardson_targets(ST.gap_records(spark, sf))


@query("k1_shift_iqr", 5)
def _(spark, sf):
    return ST.diag_records(spark, sf).select("curve_id", "depth", "noise", "target_g", "method", "shift_iqr")


@query("k2_perturb_iqr", 5)
def _(spark, sf):
    return ST.diag_records(spark, sf).select("curve_id", "depth", "noise", "target_g", "method", "perturb_iqr")


def _ranked_diag(spark, sf):
    """Diagnostics and errors at nine decimals: ranks must not depend on noise in the last bits."""
    return ST.diag_records(spark, sf).withColumns({c: F.round(c, 9) for c in ("error", "perturb_iqr", "shift_iqr")})


@query("k3_diagnostic_correlation", 4)
def _(spark, sf):
    return K.diagnostic_correlations(_ranked_diag(spark, sf))


@query("k4_feature_correlation", 4)
def _(spark, sf):
    t = _targets(spark, sf).withColumns({c: F.round(c, 9) for c in ("R_R_med", "log_med_error_R")})
    f = ST.cell_features(spark, sf).withColumns({c: F.round(c, 12) for c in ("log_log_slope", "curvature_idx", "oscillation_idx", "noise_var", "richardson_r2", "diff_ratio_cv")})
    return K.feature_correlations(t, f, 5)


@query("k5_richardson_targets")
def _(spark, sf):
    return _targets(spark, sf)


@query("k6_auc")
def _(spark, sf):
    s = ST.recorded_summary(spark, sf).select("family", F.round("perturb_iqr", 9).alias("perturb_iqr"), (F.col("cascade_skill") >= 1).alias("fail")).filter("fail IS NOT NULL")
    return K.auc_fail_vs_success(s, ["family"], "perturb_iqr", "fail")


@query("k7_rejection_rules")
def _(spark, sf):
    return K.rejection_rules(ST.diag_records(spark, sf))


@query("k8_depth_reliability", 4)
def _(spark, sf):
    r = _ranked_diag(spark, sf).filter(F.col("target_g") == ST.HEADLINE_G)
    return K.depth_reliability(r)


@query("k9_ranking_agreement")
def _(spark, sf):
    return K.ranking_agreement(*_sets(spark, sf))


def _bootstrap_cells(spark, sf):
    """Additive statistics of the default per uncapped core cell."""
    c = P.exclude_capped(ST.cells(spark, sf)).filter("is_holdout = 0")
    keys = ["family", "depth", "noise", "target_g"]

    def of(m, col):
        return F.max(F.when(F.col("method") == m, F.col(col)))
    d = c.groupBy(*keys).agg(of("rational_fit", "win_rate_vs_last").alias("w"), of("rational_fit", "med_error").alias("e"), of("last_value", "med_error").alias("l"))
    return d.select("target_g", "family", F.col("w").alias("win"), F.lit(1).alias("n"), (F.col("e") < F.col("l")).cast("int").alias("lower"),
                    F.round(F.col("e") - F.col("l"), 9).alias("diff"))


@query("k10_cluster_bootstrap", 5)
def _(spark, sf):
    cells = _bootstrap_cells(spark, sf)
    return K.cluster_bootstrap(cells, cells.select("family").distinct(), 5000)


@query("k11_p_values")
def _(spark, sf):
    return K.spearman_p(K.diagnostic_correlations(_ranked_diag(spark, sf))).withColumn("p_value", F.round("p_value", 6))


# ---- N: quality ------------------------------------------------------------------
@query("n1_keyed_diff")
def _(spark, sf):
    r = ST.gap_records(spark, sf).withColumn("e3", F.round("error", 3))
    keys = ["curve_id", "depth", "target_g", "method"]
    return H.keyed_diff(r.filter("noise = 0"), r.filter("noise > 0"), keys, ["e3", "valid"]).select(
        "column", "n_both", "only_left", "only_right", "n_differ", "first_key")


@query("n3_expected_difference")
def _(spark, sf):
    r = ST.gap_records(spark, sf).withColumn("e3", F.round("error", 3))
    return Q.expected_differences(r.filter("noise = 0"), r.filter("noise > 0"), ["curve_id", "depth", "target_g", "method"], ["e3", "valid", "win_vs_last"])


@query("n4_panel_consistency")
def _(spark, sf):
    return Q.panel_violations(ST.cells(spark, sf))


@query("n5_record_invariants")
def _(spark, sf):
    return Q.record_violations(ST.gap_records(spark, sf))


@query("n6_inclusion_criteria")
def _(spark, sf):
    return Q.inclusion_verdicts(ST.curves(spark, sf, "mean"), 90, 500, 0.05)


@query("n7_validity_disagreement")
def _(spark, sf):
    return Q.validity_disagreements(ST.step_records(spark, sf))


@query("n8_input_dependence")
def _(spark, sf):
    """How often each method's estimate moves when the window is perturbed."""
    from tailcast.operators.forecast import forecast
    w = ST.diag_windows(spark, sf)
    keys = ["curve_id", "depth", "noise", "target_g"]
    return Q.reaction_to_input(forecast(w, ST.DIAG_METHODS), forecast(C.perturbed(w, 1, 0.01), ST.DIAG_METHODS), keys)
