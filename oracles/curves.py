"""SQL of the source, curve, feature, forecast and score queries."""
from __future__ import annotations

from oracles import orders
from oracles.prelude import DEFAULT_METHODS, PADE
from oracles.tails import DIAG_POOL, FEATURES, REC, R, inlist, tail

tail("a1_wide_curves", "none", """SELECT curve_id, curve_id AS family, 0 AS is_holdout, 0::BIGINT AS run, step, value FROM (
    SELECT l_returnflag AS curve_id, ((year(l_shipdate) - 1992) * 12 + month(l_shipdate))::INTEGER AS step, sum(l_quantity) AS value
    FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1, 2)""")
tail("a2_pruned_record_scan", "gap", "SELECT method, count(*) AS n, sum(valid)::BIGINT AS n_valid, sum(catastrophic)::BIGINT AS n_cat FROM rec GROUP BY method")
tail("a3_exact_float_round_trip", "hz", "SELECT count(*) AS n_both, 0::BIGINT AS only_left, 0::BIGINT AS only_right, 0::BIGINT AS diff_gap_obs, 0::BIGINT AS diff_true_val FROM hz")
tail("a4_ordered_result_sink", "pooled", f"SELECT target_g, regime_set, method, {R('med_error')} AS med_error, rank::INTEGER AS rank FROM pooled")
EXCLUDED = """SELECT method, max(is_trivial) AS is_trivial, 1 - max(is_trivial) AS eligible, sum(round(valid_rate * 1e4)::BIGINT)::DOUBLE / (count(*) * 1e4) AS v,
    sum(round(cat_rate * 1e4)::BIGINT)::DOUBLE / (count(*) * 1e4) AS c, median(med_error) AS m, count(*) AS n_cells
    FROM cells WHERE is_holdout = 0 AND is_oracle = 0 AND capped = 0 GROUP BY method"""
tail("a5_excluded_artifact", "cells", f"SELECT method, floor(v * 1e4 + 0.5::DOUBLE) / 1e4 AS valid_rate, n_cells, CASE WHEN v < 0.9 THEN 1 ELSE 0 END AS dangerous FROM ({EXCLUDED}) WHERE eligible = 1")
tail("a6_filtered_extract", "cells", f"""SELECT r.family, r.method, count(*) AS n, sum(r.valid)::BIGINT AS n_valid, {R('max(r.error)')} AS max_error
    FROM rec r WHERE r.target_g = 0.5 AND EXISTS (SELECT 1 FROM cells c WHERE c.capped = 0 AND c.family = r.family AND c.depth = r.depth AND c.noise = r.noise AND c.target_g = r.target_g)
    GROUP BY r.family, r.method""")
tail("a7_partitioned_blocks", "gap", "SELECT depth::INTEGER AS depth, noise, count(*) AS n, count(DISTINCT curve_id) AS n_curves FROM rec GROUP BY depth, noise")
tail("a8_provenance", "gap", """SELECT count(*) AS n_rows, sum(('0x' || substr(md5(curve_id || '|' || depth || '|' || n_f || '|' || method), 1, 8))::BIGINT)::BIGINT AS digest,
    count(DISTINCT (family, depth, noise, target_g)) AS n_cells, count(DISTINCT method) AS n_methods, count(DISTINCT curve_id) AS n_runs, sum(valid)::BIGINT AS n_valid FROM rec""")
_facts = [("size", "records", "count(*)", "all rows", "count(*)", "TRUE"), ("size", "curves", "count(DISTINCT curve_id)", "all rows", "count distinct curve_id", "TRUE"),
          ("validity", "invalid accelerator records", "count(*)", "is_trivial = 0 AND valid = 0", "count(*)", None),
          ("validity", "capped records", "count(*)", "capped = 1", "count(*)", None),
          ("catastrophe", "catastrophic records of the default", "sum(catastrophic)", "method = 'rational_fit'", "sum(catastrophic)", None),
          ("wins", "wins of the default against the last value", "sum(win_vs_last)", "method = 'rational_fit' AND capped = 0", "sum(win_vs_last)", None)]
tail("a9_facts", "gap", " UNION ALL ".join(
    f"SELECT '{s}' AS section, '{f}' AS fact, CAST(CAST({v} AS BIGINT) AS VARCHAR) AS value, 'records' AS file, '{flt.replace(chr(39), chr(39) * 2)}' AS filter, '{fm}' AS formula FROM rec WHERE {w or flt}"
    for s, f, v, flt, fm, w in _facts))
tail("a10_tabular_prep", "none", f"""WITH p AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_size % 7 != 0 THEN p_retailprice END AS price FROM part)
    SELECT p_partkey, p_brand, p_type, {R('coalesce(price, (SELECT median(price) FROM p))')} AS price,
    (dense_rank() OVER (ORDER BY p_brand) - 1)::INTEGER AS p_brand_code, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS p_type_code FROM p""")
tail("a11_stratified_split", "none", """WITH h AS (SELECT c_custkey, c_mktsegment, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT::DOUBLE AS h FROM customer),
    q AS (SELECT c_mktsegment, quantile_cont(h, 0.8) AS cut FROM h GROUP BY 1)
    SELECT c_mktsegment, CASE WHEN h <= cut THEN 1 ELSE 0 END AS is_train, count(*) AS n, sum(c_custkey)::BIGINT AS key_sum FROM h JOIN q USING (c_mktsegment) GROUP BY 1, 2""")

tail("b1_window_slice", "stepwin", f"SELECT w.curve_id, w.depth, len(xs)::INTEGER AS n_points, xs[1]::INTEGER AS first_step, {R('min_v', 9)} AS min_v, {R('max_v', 9)} AS max_v, {R('last_v', 9)} AS last_v FROM wins w")
tail("b2_depth_target_grid", "stepwin", "SELECT depth, n_f, count(*) AS n_curves FROM tgt JOIN wins USING (curve_id, depth) GROUP BY depth, n_f")
tail("b3_current_value", "stepwin", f"SELECT curve_id, depth, {R('last_v', 9)} AS curr_val FROM wins")
tail("b4_true_value", "stepwin", f"SELECT curve_id, depth, n_f, {R('true_val', 9)} AS true_val FROM tgt")
tail("b5_assumed_limit", "bfive", f"SELECT curve_id, depth, assumed_mode AS mode, {R('L_hat')} AS L_assumed FROM wins")
tail("b6_gap_horizon", "hz", f"SELECT curve_id, family, depth, target_g, n_f, {R('achieved_g')} AS achieved_g, capped, {R('gap_obs')} AS gap_obs, {R('gap_f')} AS gap_f, degenerate::INTEGER AS degenerate FROM hz")
tail("b7_horizon_table", "hz", f"""SELECT family, depth, {R('median(n_f) FILTER (WHERE target_g = 0.7)')} AS g_07, {R('median(n_f) FILTER (WHERE target_g = 0.5)')} AS g_05,
    {R('median(n_f) FILTER (WHERE target_g = 0.1)')} AS g_01 FROM hz GROUP BY family, depth""")
tail("b8_curve_minimum", "mean", f"SELECT curve_id, family, n_rounds, argmin_round, {R('min_value')} AS min_value, {R('value_at_round')} AS value_at_round, at_round, {R('rise_from_min')} AS rise_from_min FROM minima")
tail("b9_post_minimum_flag", "step", "SELECT family, depth, n_f, post_min_target, count(*) AS n FROM srec WHERE method = 'last_value' GROUP BY ALL")
tail("b10_lower_envelope", "se", f"""WITH e AS (SELECT curve_id, step, min(value) OVER (PARTITION BY curve_id ORDER BY step) AS envelope FROM curve),
    f AS (SELECT curve_id, arg_min(envelope, step) AS a, arg_max(envelope, step) AS b FROM e GROUP BY 1)
    SELECT curve_id, step, {R('envelope', 7)} AS envelope, {R('CASE WHEN a <> b THEN 0.7::DOUBLE * ((envelope - b) / (a - b)) END', 7)} AS profile FROM e JOIN f USING (curve_id)""")
tail("b11_interpolation", "mean", f"""WITH g AS (SELECT x::DOUBLE AS x FROM (VALUES (0.5), (1.0), (10.5), (77.25), (300.0), (410.75), (99999.0)) v(x)),
    s AS (SELECT curve_id, step, value, lead(step) OVER w AS ns, lead(value) OVER w AS nv FROM curve WINDOW w AS (PARTITION BY curve_id ORDER BY step)),
    e AS (SELECT curve_id, min(step) AS lo, max(step) AS hi, arg_min(value, step) AS fv FROM curve GROUP BY 1)
    SELECT e.curve_id, x, {R('CASE WHEN x < lo THEN fv WHEN x > hi THEN 0e0 WHEN ns IS NULL THEN value ELSE value + (nv - value) * (x - step) / (ns - step) END', 8)} AS value
    FROM e CROSS JOIN g LEFT JOIN s ON s.curve_id = e.curve_id AND s.step <= x AND (x < s.ns OR (s.ns IS NULL AND x = s.step))""")
tail("b12_paired_perturbation", "pert", f"""SELECT curve_id, depth, noise, trial, {R('last_v', 8)} AS last_v, {R('min_v', 8)} AS min_v, {R('max_v', 8)} AS max_v FROM pwins""")
tail("b13_window_shifts", "stepwin", f"""SELECT curve_id, depth, s::INTEGER AS shift, (len(ys) - s)::INTEGER AS n_points, xs[1 + s]::INTEGER AS first_step, {R('list_max(ys[1 + s:])', 9)} AS max_v
    FROM wins CROSS JOIN range(3) g(s) WHERE len(ys) - s >= 3""")
tail("b14_noise_class", "cells", """SELECT DISTINCT family, depth, noise, CASE WHEN noise = 0 AND family = 'ASIA' THEN 'intrinsic' WHEN noise = 0 THEN 'noise-free' ELSE 'sigma=0.005' END AS noise_class,
    CASE WHEN noise = 0 AND family = 'ASIA' THEN 1e0 WHEN noise = 0 THEN 0e0 ELSE 2.005::DOUBLE END AS class_order FROM cells""")
tail("b15_family_sets", "se", "SELECT family, is_holdout, count(*) AS n_curves FROM fam WHERE family IN ('ASIA', 'EUROPE', 'MIDDLE EAST') GROUP BY ALL")
tail("b16_exclude_capped", "gap", "SELECT family, depth, target_g, count(*) AS n FROM rec WHERE capped = 0 GROUP BY ALL")
tail("b17_limit_tercile", "semin", f"""SELECT CASE WHEN l >= 0.005 AND l < 0.0232 THEN 'low' WHEN l >= 0.0232 AND l < 0.1077 THEN 'mid' WHEN l >= 0.1077 AND l < 0.5 THEN 'high' END AS bin,
    count(*) AS n, {R('min(l)')} AS lo, {R('max(l)')} AS hi FROM (SELECT value_at_round AS l FROM minima) GROUP BY 1""")
tail("b18_method_dimension", "gap", "SELECT method, method_family, method_type, is_trivial, is_oracle, registry_index, count(*) AS n_records FROM rec GROUP BY ALL")
tail("b19_validity_rules", "step", "SELECT method, valid, valid_strict, count(*) AS n FROM srec GROUP BY ALL")
tail("b20_headline_target", "gap", "SELECT coalesce(max(target_g) FILTER (WHERE target_g = 0.1), max(target_g)) AS headline_g FROM rec")

for _i, _f in enumerate(FEATURES, 1):
    tail(f"c{_i}_{_f}", "feat", f"SELECT curve_id, depth, noise, {R(_f, 6 if _f != 'noise_var' else 10)} AS {_f} FROM feat")
tail("c7_cell_features", "cfeat", "SELECT family, depth, noise, " + ", ".join(f"{R(f)} AS {f}" for f in FEATURES) + " FROM cfeat")


def _nearest(src, cent):
    sq = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in FEATURES)
    return f"""SELECT family, depth, noise, arg_min(centroid, {{'d': d, 'c': centroid}}) AS nearest, {R('min(d)')} AS distance FROM (
        SELECT a.family, a.depth, a.noise, b.family AS centroid, sqrt({sq}) AS d FROM {src} a CROSS JOIN {cent} b) GROUP BY family, depth, noise"""


_cent = "SELECT family, " + ", ".join(f"avg({f}) AS {f}" for f in FEATURES) + " FROM cfeat WHERE noise = 0 GROUP BY family"
tail("c8_nearest_family", "cfeat", _nearest("cfeat", f"({_cent})"))
_z = ", ".join(f"(q.{f} - (SELECT avg({f}) FROM cfeat)) / (SELECT stddev_samp({f}) FROM cfeat) AS {f}" for f in FEATURES)
tail("c9_nearest_family_standardised", "cfeat", _nearest(f"(SELECT family, depth, noise, {_z} FROM cfeat q)", f"(SELECT family, {_z} FROM ({_cent}) q)"))

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
_recorded = lambda methods: f"SELECT curve_id, depth, n_f, method, {R('CASE WHEN isfinite(estimate_raw) THEN estimate_raw END')} AS estimate FROM est WHERE method IN {inlist(methods)}"
tail("d14_pade", "steppade", _recorded(PADE))
for _n, _m in (("d19_median_ensemble", "median_ensemble"), ("d20_stability_weighted", "stability_weighted"), ("d21_best_shanks_wynn", "best_shanks_wynn")):
    tail(_n, "stepmix", _recorded((_m,)))
for _n, _m in GROUPS.items():
    if int(_n[1:].split("_")[0]) > 10:
        tail(_n, "orders", orders.select(_m))
        continue
    tail(_n, "gap", f"SELECT curve_id, depth, noise, target_g, method, {R('estimate_raw')} AS estimate FROM est WHERE method IN {inlist(_m)}")

for _n, _cols in (("e1_error", [R("error") + " AS error"]), ("e2_catastrophic", ["catastrophic"]), ("e3_improve_ratio", [R("improve_ratio", 3) + " AS improve_ratio"]),
                  ("e4_last_error", [R("e_last") + " AS E_last"]), ("e5_reference_error", [R("ref_error") + " AS ref_error"]), ("e6_skill", [R("skill", 3) + " AS skill"]),
                  ("e7_fixed_reference_skill", [f"{R(f'skill_vs_{t}', 3)} AS skill_vs_{t}, win_vs_{t}" for t in ("assumed", "last", "wmean", "wmin")])):
    tail(_n, "gap", f"SELECT {REC}, {', '.join(_cols)} FROM rec")
tail("e8_zero_denominator", "gap", "SELECT method, (count(*) FILTER (WHERE error IS NOT NULL AND e_last <= 1e-12))::BIGINT AS n_zero, count(*) AS n FROM rec GROUP BY method")
BEST_REF = """coalesce(arg_min(method, {'e': error, 'o': CASE method WHEN 'constant_assumed' THEN 0 WHEN 'last_value' THEN 1 WHEN 'window_mean' THEN 2 ELSE 3 END})
    FILTER (WHERE error IS NOT NULL AND method IN ('constant_assumed', 'last_value', 'window_mean', 'window_min')), '')"""
tail("e9_best_trivial", "step", f"SELECT curve_id, depth, n_f, {BEST_REF} AS ref_best_method FROM srec GROUP BY ALL")
tail("e10_improvement", "step", f"""SELECT curve_id, depth, n_f, method, {R('CASE WHEN error IS NOT NULL AND curr_err > 1e-10 THEN (curr_err - error) / curr_err END', 4)} AS improvement
    FROM srec""")
_sum_cols = ["true_val", "current_err", "ref_error", "richardson_err", "rational_err", "cascade_pred", "cascade_err", "cascade_skill", "improvement", "perturb_iqr"] + \
    [f"cascade_skill_vs_{t}" for t in ("assumed", "last", "wmean", "wmin")]
tail("e11_recorded_summary", "recorded", "SELECT curve_id, family, depth, n_f, selected_method, argmin_round, post_min_target, ref_best_method, "
     + ", ".join(f"{R(c)} AS {c}" for c in _sum_cols) + ", " + ", ".join(f"cascade_win_vs_{t}" for t in ("assumed", "last", "wmean", "wmin")) + " FROM rsum")
tail("e13_depth_sweep", "gapfeat", f"""SELECT {', '.join('r.' + c.strip() for c in REC.split(','))}, {R('error')} AS error, valid, {R('skill')} AS skill, {R('log_log_slope')} AS log_log_slope, {R('richardson_r2')} AS richardson_r2
    FROM rec r JOIN feat f ON r.curve_id = f.curve_id AND r.depth = f.depth AND r.noise = f.noise WHERE method IN {inlist(DIAG_POOL + ('window_mean', 'window_min'))}""")
tail("e14_scores_with_diagnostics", "diag", f"SELECT {REC}, {R('error')} AS error, {R('perturb_iqr')} AS perturb_iqr, {R('shift_iqr')} AS shift_iqr FROM drec")
tail("e15_block_scores", "diagfeat", f"""SELECT {', '.join('r.' + c.strip() for c in REC.split(','))}, {R('error')} AS error, catastrophic, CASE WHEN x.v < 0.9 AND eligible = 1 THEN 1 ELSE 0 END AS dangerous,
    {R('log_log_slope')} AS casc_slope, {R('richardson_r2')} AS casc_r2 FROM drec r JOIN feat f ON r.curve_id = f.curve_id AND r.depth = f.depth AND r.noise = f.noise
    LEFT JOIN ({EXCLUDED}) x ON x.method = r.method""")
CASCADE = "CASE WHEN log_log_slope > -0.1 THEN 'rational_fit' WHEN richardson_r2 < 0.5 THEN 'rational_fit' ELSE 'richardson_1' END"
tail("e16_cascade_windows", "gapfeat", f"""SELECT a.curve_id, a.depth, a.noise, a.target_g, {R('a.error')} AS r1_error, a.valid AS r1_valid, a.catastrophic AS r1_catastrophic,
    {R('b.error')} AS alt_error, b.valid AS alt_valid, b.catastrophic AS alt_catastrophic, {CASCADE} AS chosen, CASE WHEN {CASCADE} = 'rational_fit' THEN 1 ELSE 0 END AS cascade_fired
    FROM rec a JOIN rec b ON a.curve_id = b.curve_id AND a.depth = b.depth AND a.noise = b.noise AND a.target_g = b.target_g AND a.method = 'richardson_1' AND b.method = 'rational_fit'
    JOIN feat f ON a.curve_id = f.curve_id AND a.depth = f.depth AND a.noise = f.noise""")
