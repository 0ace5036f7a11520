"""Sources, curve preparation, features, forecasts and scores as queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tailcast.functions.arrays import finite
from tailcast.functions.quantiles import grouped
from tailcast.operators import curves as C
from tailcast.operators import features as FE
from tailcast.operators import quality as Q
from tailcast.operators import scoring as S
from tailcast.operators.forecast import forecast
from tailcast.operators.methods import method_table, roster_by_family
from tailcast.plans import study as ST
from tailcast.plans.catalog import query
from tailcast.session import settled
from tailcast.settings import FEATURES
from tailcast.sources import prep, sinks, tables

WIN = ["curve_id", "depth"]


# ---- A: sources and sinks ----------------------------------------------------
@query("a1_wide_curves")
def _(spark, sf):
    """Monthly quantity per return flag, written as a wide curve file and read back."""
    li = tables.table(spark, sf, "lineitem")
    wide = (li.groupBy(((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")).cast("int").alias("round"))
            .pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")))
    path = sinks.scratch(spark, "wide", sf)
    wide.write.mode("overwrite").option("header", True).csv(path)
    return tables.read_wide_curves(spark, path)


@query("a2_pruned_record_scan")
def _(spark, sf):
    """Records written by one job and scanned by another through the checked schema, three columns of them."""
    path = sinks.scratch(spark, "records", sf)
    ST.gap_records(spark, sf).select(*tables.RECORD_SCHEMA.fieldNames()).write.mode("overwrite").parquet(path)
    return tables.read_records(spark, path, ["method", "valid", "catastrophic"]).groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.sum("valid").alias("n_valid"), F.sum("catastrophic").alias("n_cat"))


@query("a3_exact_float_round_trip")
def _(spark, sf):
    return sinks.csv_round_trip(spark, ST.horizons(spark, sf), ["curve_id", "depth", "target_g"], ["gap_obs", "true_val"], sf)


@query("a4_ordered_result_sink")
def _(spark, sf):
    out = sinks.write_result(ST.pooled(spark, sf), sinks.scratch(spark, "result", sf),
                             ["target_g", "regime_set", "method", "med_error", "rank"], ["regime_set", "method"], ["target_g"])
    return spark.read.parquet(out).select("target_g", "regime_set", "method", "med_error", F.col("rank").cast("int").alias("rank"))


@query("a5_excluded_artifact")
def _(spark, sf):
    from tailcast.operators.ensembles import derive_excluded
    path = sinks.write_excluded(derive_excluded(ST.cells(spark, sf)), sinks.scratch(spark, "excluded", sf))
    return sinks.load_excluded(spark, path)


@query("a6_filtered_extract")
def _(spark, sf):
    path = sinks.write_extract(ST.gap_records(spark, sf), ST.cells(spark, sf), ST.HEADLINE_G, sinks.scratch(spark, "extract", sf))
    return sinks.read_extract(spark, path).groupBy("family", "method").agg(
        F.count(F.lit(1)).alias("n"), F.sum("valid").alias("n_valid"), F.max("error").alias("max_error"))


@query("a7_partitioned_blocks")
def _(spark, sf):
    path = sinks.write_blocks(ST.gap_records(spark, sf), sinks.scratch(spark, "blocks", sf))
    return sinks.read_blocks(spark, path).groupBy("depth", "noise").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("curve_id").alias("n_curves"))


@query("a8_provenance")
def _(spark, sf):
    return sinks.provenance(ST.gap_records(spark, sf), ["curve_id", "depth", "n_f", "method"], ["family", "depth", "noise", "target_g"])


@query("a9_facts")
def _(spark, sf):
    return sinks.record_facts(ST.gap_records(spark, sf))


@query("a10_tabular_prep")
def _(spark, sf):
    part = tables.table(spark, sf, "part").select(
        "p_partkey", "p_brand", "p_type", F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("price"))
    return prep.tabular(part, ["p_brand", "p_type"], ["price"])


@query("a11_stratified_split")
def _(spark, sf):
    c = tables.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return prep.stratified_split(c, "c_mktsegment", F.col("c_custkey"), 0.8).groupBy("c_mktsegment", "is_train").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("key_sum"))


@query("a12_validation_loss_curve")
def _(spark, sf):
    """Validation loss per boosting round of a tree ensemble, as a curve."""
    o = tables.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority",
                                                 F.month("o_orderdate").alias("month"))
    return prep.boosting_curve(o.withColumn("y", (F.col("o_orderstatus") == "F").cast("double")), "o_orderkey",
                               ["o_totalprice", "month"], ["o_orderpriority"], "y", rounds=12)


# ---- B: curve preparation ------------------------------------------------------
def _plain_windows(spark, sf, **kw):
    return ST.step_windows(spark, ST.curves(spark, sf, "mean"), **kw)


@query("b1_window_slice", 9)
def _(spark, sf):
    return _plain_windows(spark, sf).select(*WIN, F.size("xs").alias("n_points"), F.get("xs", F.lit(0)).cast("int").alias("first_step"),
                                            "min_v", "max_v", "last_v")


@query("b2_depth_target_grid")
def _(spark, sf):
    return _plain_windows(spark, sf).select(*WIN, F.explode("targets").alias("t")).groupBy("depth", F.col("t.n_f").alias("n_f")).agg(
        F.count(F.lit(1)).alias("n_curves"))


@query("b3_current_value", 9)
def _(spark, sf):
    return _plain_windows(spark, sf).select(*WIN, F.col("last_v").alias("curr_val"))


@query("b4_true_value", 9)
def _(spark, sf):
    return _plain_windows(spark, sf).select(*WIN, F.explode("targets").alias("t")).select(*WIN, "t.n_f", "t.true_val")


@query("b5_assumed_limit")
def _(spark, sf):
    w = ST.step_windows(spark, ST.curves(spark, sf, "se"), true_limit=F.lit(0.01))
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), C.assumed_limit(m, F.col("min_v"), F.col("L_true")).alias("L_assumed"))
                                for m in ("zero", "half", "oracle", "double", "winmin")])).alias("m")
    return w.select(*WIN, modes).select(*WIN, "m.mode", "m.L_assumed")


@query("b6_gap_horizon")
def _(spark, sf):
    return ST.horizons(spark, sf).select("curve_id", "family", "depth", "target_g", "n_f", "achieved_g", "capped", "gap_obs", "gap_f",
                                         F.col("degenerate").cast("int").alias("degenerate"))


@query("b7_horizon_table")
def _(spark, sf):
    t = C.horizon_table(ST.horizons(spark, sf), ST.GAP_FRACTIONS)
    return t.withColumnsRenamed({"0.7": "g_07", "0.5": "g_05", "0.1": "g_01"})


@query("b8_curve_minimum")
def _(spark, sf):
    return C.curve_minima(ST.curves(spark, sf, "mean")).drop("is_holdout", "run")


@query("b9_post_minimum_flag")
def _(spark, sf):
    return ST.step_records(spark, sf).filter("method = 'last_value'").groupBy("family", "depth", "n_f", "post_min_target").agg(
        F.count(F.lit(1)).alias("n"))


@query("b10_lower_envelope", 7)
def _(spark, sf):
    return C.lower_envelope(ST.curves(spark, sf, "se")).select("curve_id", "step", "envelope", "profile")


@query("b11_interpolation", 8)
def _(spark, sf):
    return C.interpolate(ST.curves(spark, sf, "mean"), [0.5, 1.0, 10.5, 77.25, 300.0, 410.75, 99999.0])


@query("b12_paired_perturbation", 8)
def _(spark, sf):
    p = C.perturbed(ST.diag_windows(spark, sf))
    return p.select("curve_id", "depth", "noise", "trial", "last_v", "min_v", "max_v")


@query("b13_window_shifts", 9)
def _(spark, sf):
    return C.shifted(_plain_windows(spark, sf)).select(*WIN, "shift", F.size("xs").alias("n_points"),
                                                       F.get("xs", F.lit(0)).cast("int").alias("first_step"), "max_v")


@query("b14_noise_class")
def _(spark, sf):
    k = C.noise_class(F.col("noise"), F.col("family") == "ASIA")
    return ST.cells(spark, sf).select("family", "depth", "noise", k.alias("noise_class")).distinct().withColumn(
        "class_order", C.noise_class_order(F.col("noise_class")))


@query("b15_family_sets")
def _(spark, sf):
    fam = tables.supplier_families(spark, sf).groupBy("family").agg(F.max("is_holdout").alias("is_holdout"), F.count(F.lit(1)).alias("n_curves"))
    return C.resolve_families(fam, core=["ASIA", "EUROPE"], holdout=["MIDDLE EAST"])


@query("b16_exclude_capped")
def _(spark, sf):
    from tailcast.operators.panels import exclude_capped
    return exclude_capped(ST.gap_records(spark, sf)).groupBy("family", "depth", "target_g").agg(F.count(F.lit(1)).alias("n"))


@query("b17_limit_tercile")
def _(spark, sf):
    ends = C.curve_minima(ST.curves(spark, sf, "se")).select(F.col("value_at_round").alias("limit"))
    return ends.groupBy(C.tercile(F.col("limit")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("limit").alias("lo"), F.max("limit").alias("hi"))


@query("b18_method_dimension")
def _(spark, sf):
    used = ST.gap_records(spark, sf).groupBy("method").agg(F.count(F.lit(1)).alias("n_records"))
    return method_table(spark).join(used, "method")


@query("b19_validity_rules")
def _(spark, sf):
    return ST.step_records(spark, sf).groupBy("method", "valid", "valid_strict").agg(F.count(F.lit(1)).alias("n"))


@query("b20_headline_target")
def _(spark, sf):
    """The configured target if it occurs, else the largest."""
    t = ST.gap_records(spark, sf).select("target_g").distinct()
    return t.agg(F.coalesce(F.max(F.when(F.col("target_g") == 0.1, F.col("target_g"))), F.max("target_g")).alias("headline_g"))


# ---- C: features ---------------------------------------------------------------
for _i, _f in enumerate(FEATURES, 1):
    def _feature(spark, sf, name=_f):
        return ST.gap_features(spark, sf).select("curve_id", "depth", "noise", name)
    query(f"c{_i}_{_f}", 6 if _f != "noise_var" else 10)(_feature)


@query("c7_cell_features")
def _(spark, sf):
    return ST.cell_features(spark, sf)


def _centroids(spark, sf):
    return ST.cell_features(spark, sf).filter("noise = 0").groupBy("family").agg(*[F.avg(f).alias(f) for f in FEATURES])


@query("c8_nearest_family")
def _(spark, sf):
    return FE.nearest_family(ST.cell_features(spark, sf), _centroids(spark, sf))


@query("c9_nearest_family_standardised")
def _(spark, sf):
    c, z = ST.cell_features(spark, sf), ST.cell_features(spark, sf)
    return FE.nearest_family(FE.standardise(c, z), FE.standardise(_centroids(spark, sf), z))


# ---- D: forecasts ---------------------------------------------------------------
GROUPS = {
    "d1_trivial": ("constant_assumed", "constant_oracle", "window_mean", "window_min", "last_value"),
    "d2_linear": ("linear",), "d3_log_linear": ("log_linear",), "d4_geometric_differences": ("geom_avg_diff",),
    "d5_fixed_power": ("richardson_a05", "richardson_a10", "richardson_a20"), "d6_power_fit": ("richardson_1",),
    "d8_exponential_rational": ("single_exp_fit", "rational_fit"), "d9_log_fit": ("log_fit",),
    "d11_shanks": ("shanks_1", "shanks_2", "shanks_3", "shanks_4"), "d12_wynn_epsilon": ("wynn_eps_1", "wynn_eps_2", "wynn_eps_3"),
    "d13_wynn_rho": ("wynn_rho_1", "wynn_rho_2", "wynn_rho_3"),
    "d15_levin": ("levin_t1", "levin_t2", "levin_u1", "levin_u2", "levin_v1", "levin_v2"),
    "d16_brezinski": ("brezinski_theta1", "brezinski_theta2"), "d17_neville": ("neville_2", "neville_3", "neville_4"),
    "d18_anderson": ("anderson_1", "anderson_2", "anderson_3"),
}
for _name, _methods in GROUPS.items():
    def _estimates(spark, sf, methods=_methods):
        w = ST.gap_windows(spark, ST.curves(spark, sf), ST.horizons(spark, sf), true_limit=F.lit(0.0))
        e = F.col("estimate_raw")
        return forecast(w, methods).select("curve_id", "depth", "noise", "target_g", "method", F.when(finite(e), e).alias("estimate"))
    query(_name)(_estimates)


def _recorded(spark, sf, methods):
    e = F.col("estimate_raw")
    return forecast(_plain_windows(spark, sf), methods).select("curve_id", "depth", "n_f", "method", F.when(finite(e), e).alias("estimate"))


@query("d7_multi_term_power")
def _(spark, sf):
    return _recorded(spark, sf, ("richardson_2", "richardson_3"))


@query("d10_double_exponential")
def _(spark, sf):
    return _recorded(spark, sf, ("double_exp_fit",))


@query("d14_pade")
def _(spark, sf):
    from tailcast.settings import FAMILY_OF
    return _recorded(spark, sf, tuple(m for m in FAMILY_OF if FAMILY_OF[m] == "pade"))


for _n, _m in (("d19_median_ensemble", "median_ensemble"), ("d20_stability_weighted", "stability_weighted"),
               ("d21_best_shanks_wynn", "best_shanks_wynn")):
    def _composite(spark, sf, m=_m):
        return _recorded(spark, sf, (m,))
    query(_n)(_composite)


# ---- E: scores -------------------------------------------------------------------
REC = ["curve_id", "depth", "noise", "target_g", "method"]
for _n, _cols in (("e1_error", ["error"]), ("e2_catastrophic", ["catastrophic"]), ("e3_improve_ratio", ["improve_ratio"]),
                  ("e4_last_error", ["E_last"]), ("e5_reference_error", ["ref_error"]), ("e6_skill", ["skill"]),
                  ("e7_fixed_reference_skill", [f"{k}_vs_{t}" for t in ("assumed", "last", "wmean", "wmin") for k in ("skill", "win")])):
    def _scores(spark, sf, cols=_cols):
        return ST.gap_records(spark, sf).select(*REC, *cols)
    query(_n, 3 if _n in ("e3_improve_ratio", "e6_skill", "e7_fixed_reference_skill") else 6)(_scores)


@query("e8_zero_denominator")
def _(spark, sf):
    return ST.gap_records(spark, sf).groupBy("method").agg(
        F.sum(S.zero_denominator(F.col("error"), F.col("E_last")).cast("int")).alias("n_zero"), F.count(F.lit(1)).alias("n"))


@query("e9_best_trivial")
def _(spark, sf):
    return ST.step_records(spark, sf).groupBy("curve_id", "depth", "n_f").agg(S.best_reference().alias("ref_best_method"))


@query("e10_improvement", 4)
def _(spark, sf):
    r = ST.step_records(spark, sf)
    return r.select("curve_id", "depth", "n_f", "method", S.improvement(F.col("error"), F.col("curr_err")).alias("improvement"))


@query("e11_recorded_summary")
def _(spark, sf):
    return ST.recorded_summary(spark, sf).drop("rise_from_min")


@query("e12_full_roster")
def _(spark, sf):
    """Every registered window method on every recorded cell, scored."""
    from tailcast.operators.methods import REGISTRY
    recs = ST.records_of(spark, _plain_windows(spark, sf), tuple(m for m in REGISTRY if m != "constant_oracle"))
    recs = settled(recs.select("method", "method_family", "depth", "valid", "valid_strict", "catastrophic", "win_vs_last", "error"), "roster")
    return grouped(recs, ["method", "method_family", "depth"], [
        F.count(F.lit(1)).alias("n"), F.sum("valid").alias("n_valid"), F.sum("valid_strict").alias("n_strict"),
        F.sum("catastrophic").alias("n_cat"), F.sum("win_vs_last").alias("n_win")], {"med_error": ("error", 0.5)})


@query("e13_depth_sweep")
def _(spark, sf):
    pool = ST.DIAG_POOL + ("window_mean", "window_min")
    r = ST.gap_records(spark, sf).filter(F.col("method").isin(*pool)).select(*REC, "error", "valid", "skill")
    f = ST.gap_features(spark, sf).select("curve_id", "depth", "noise", "log_log_slope", "richardson_r2")
    return r.join(f, ["curve_id", "depth", "noise"])


@query("e14_scores_with_diagnostics")
def _(spark, sf):
    return ST.diag_records(spark, sf).select(*REC, "error", "perturb_iqr", "shift_iqr")


@query("e15_block_scores")
def _(spark, sf):
    """Records with the excluded flag and the cascade's features attached."""
    from tailcast.operators.ensembles import derive_excluded
    x = F.broadcast(derive_excluded(ST.cells(spark, sf)).select("method", "dangerous"))
    f = ST.gap_features(spark, sf).select("curve_id", "depth", "noise", F.col("log_log_slope").alias("casc_slope"), F.col("richardson_r2").alias("casc_r2"))
    r = ST.diag_records(spark, sf, f).select(*REC, "error", "catastrophic", "casc_slope", "casc_r2").join(x, "method", "left")
    return r.select("curve_id", "depth", "noise", "method", "target_g", "error", "catastrophic", F.coalesce("dangerous", F.lit(0)).alias("dangerous"), "casc_slope", "casc_r2")


@query("e16_cascade_windows")
def _(spark, sf):
    from tailcast.operators.rules import cascade
    r = ST.gap_records(spark, sf).filter(F.col("method").isin("richardson_1", "rational_fit"))
    f = ST.gap_features(spark, sf).select("curve_id", "depth", "noise", cascade().alias("chosen"))

    def of(m, c):
        return F.max(F.when(F.col("method") == m, F.col(c)))
    w = r.groupBy("curve_id", "depth", "noise", "target_g").agg(
        *[of(m, c).alias(f"{p}_{c}") for p, m in (("r1", "richardson_1"), ("alt", "rational_fit")) for c in ("error", "valid", "catastrophic")])
    return w.join(f, ["curve_id", "depth", "noise"]).withColumn("cascade_fired", (F.col("chosen") == "rational_fit").cast("int"))


@query("e17_final_step_routing")
def _(spark, sf):
    """Target = last step of the curve, cascade routing and nearest family."""
    from tailcast.operators.rules import cascade
    c = ST.curves(spark, sf, "mean")
    last = c.groupBy("curve_id").agg(F.array(F.struct(F.max("step").alias("n_f"), F.max_by("value", "step").alias("true_val"))).alias("targets"))
    w = C.cut_windows(C.prefixes(c, max(ST.STEP_DEPTHS)).join(last, "curve_id"), ST.STEP_DEPTHS)
    f = ST.step_features(spark, sf).select(*WIN, *FEATURES)
    near = FE.nearest_family(f, ST.step_features(spark, sf).groupBy("family").agg(*[F.avg(x).alias(x) for x in FEATURES])).select(*WIN, "nearest")
    r = ST.records_of(spark, w, ("richardson_1", "rational_fit"))
    return (r.join(f.select(*WIN, cascade().alias("selected_method")), WIN).filter(F.col("method") == F.col("selected_method"))
            .join(near, WIN).select(*WIN, "n_f", "true_val", "selected_method", "estimate", "error", "curr_err", "nearest"))
