"""SQL of the panel, rank, join, rule, ensemble and statistics queries."""
from __future__ import annotations

from oracles.curves import CASCADE, EXCLUDED
from oracles.prelude import DEFAULT_METHODS, _skill
from oracles.tails import DIAG, DIAG_POOL, FEATURES, PANEL, REC, R, inlist, mean_rate, panel_columns, panel_out, rate4, tail
from tailcast.operators.ensembles import ABLATIONS, GAP_SELECTORS, SELECTORS
from tailcast.operators.methods import classical_methods
from tailcast.settings import CANDIDATE_RULES, REGISTRY_INDEX, REJECT_THRESHOLDS, SCREEN_THRESHOLDS

CELL = "family, is_holdout, depth, noise, target_g"
GRID = "family, depth, noise, target_g"
TAGS = ("assumed", "last", "wmean", "wmin")
CLASSICAL = inlist(classical_methods())


def panel(keys: str, src: str, extra: str = "") -> str:
    """Rounded panel grouped by keys."""
    names = ", ".join(k.split(" AS ")[-1].strip() for k in keys.split(","))
    return f"SELECT {names}, {panel_out()}{extra and ', ' + extra.split('||')[1]} FROM (SELECT {keys}, {panel_columns()}{extra and ', ' + extra.split('||')[0]} FROM {src} GROUP BY {names})"


def r_as(cols) -> str:
    return ", ".join(f"{R(c)} AS {c}" for c in cols)


# flagship: fixed steps on the standard-error curves
tail("flagship_method_ranking", "flag", f"""SELECT target, method, method_type, n_cells, {r_as(['valid_rate', 'cat_rate', 'med_error', 'med_skill'])}, rank_eligible,
    CASE WHEN rank_eligible = 1 THEN (row_number() OVER (PARTITION BY target, rank_eligible ORDER BY round(med_error, 9), method))::INTEGER END AS rank FROM (
    SELECT *, CASE WHEN is_oracle = 0 AND med_error IS NOT NULL AND valid_rate >= 0.9 THEN 1 ELSE 0 END AS rank_eligible FROM (
      SELECT n_f AS target, method, max(method_type) AS method_type, max(is_oracle) AS is_oracle, count(*) AS n_cells, {rate4(mean_rate('valid_rate'))} AS valid_rate,
        {rate4(mean_rate('cat_rate'))} AS cat_rate, median(med_error) AS med_error, median(med_skill) AS med_skill FROM (
        SELECT method, family, depth, n_f, max(method_type) AS method_type, max(is_oracle) AS is_oracle, {rate4('avg(valid::DOUBLE)')} AS valid_rate,
          {rate4('avg(catastrophic::DOUBLE)')} AS cat_rate, median(error) AS med_error, median(skill) AS med_skill FROM rec GROUP BY method, family, depth, n_f)
      GROUP BY n_f, method))""")

tail("f1_error_panel", "gap", panel("method, target_g", "rec"))
tail("f3_cell_aggregate", "cells", f"SELECT method, {CELL}, n_total, n_valid, {r_as(['valid_rate', 'cat_rate', 'med_error', 'mean_error', 'n_f', 'achieved_g', 'L_hat', 'win_rate_vs_last'])}, {R('med_skill')} AS med_skill, capped FROM cells")
tail("f4_skill_aggregates", "gap", "SELECT method, target_g, " + ", ".join(f"round(median(skill_vs_{t}), 4) AS med_skill_vs_{t}, {rate4(f'avg(win_vs_{t}::DOUBLE)')} AS win_rate_vs_{t}" for t in TAGS) + " FROM rec GROUP BY method, target_g")
tail("f5_pooled_table", "pooled", f"SELECT regime_set, method, target_g, {r_as(['valid_rate', 'cat_rate', 'med_error', 'med_skill', *[f'med_skill_vs_{t}' for t in TAGS], *[f'win_rate_vs_{t}' for t in TAGS]])}, n_families, n_cells, n_capped_excluded FROM pooled")
tail("f6_capped_block", "cells", f"""SELECT family, is_holdout, target_g, method, {R('median(n_f)')} AS n_f, {R('median(achieved_g)')} AS achieved_g, {R('median(med_error)')} AS med_med_error,
    {R('median(med_skill)')} AS med_med_skill, {R('median(valid_rate)')} AS med_valid_rate, count(*) AS n FROM cells WHERE capped = 1 GROUP BY ALL""")
_fams = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
tail("f7_heat_map", "cells", "SELECT method, " + ", ".join(f"{R(f'''median(med_error) FILTER (WHERE family = '{f}')''')} AS err_{f.lower().replace(' ', '_')}" for f in _fams) + " FROM cells WHERE target_g = 0.5 GROUP BY method")
tail("f7_heat_map_valid", "cells", "SELECT method, " + ", ".join(f"{R(f'''avg(valid_rate) FILTER (WHERE family = '{f}')''')} AS valid_{f.lower().replace(' ', '_')}" for f in _fams) + " FROM cells WHERE target_g = 0.5 GROUP BY method")
FAMILY = f"SELECT {{keys}}, median(med_error) AS med_error, {mean_rate('win_rate_vs_last')} AS win, {mean_rate('valid_rate')} AS valid, {mean_rate('cat_rate')} AS cat_rate, count(*) AS n FROM cells WHERE capped = 0 GROUP BY {{keys}}"
tail("f8_family_table", "cells", f"SELECT family, target_g, method, {r_as(['med_error', 'win', 'valid', 'cat_rate'])}, n FROM ({FAMILY.format(keys='family, target_g, method')})")
VALID = f"SELECT method, depth, noise, {rate4('avg(valid::DOUBLE)')} AS valid_rate, count(*) AS n FROM rec GROUP BY method, depth, noise"
tail("f9_validity_by_depth", "gap", VALID)
tail("f10_validity_over_noise", "gap", f"""SELECT method, {', '.join(f'{R(f"r{d}")} AS rate_{d}' for d in (30, 60, 90))}, {R('m')} AS min_rate, CASE WHEN r30 < 0.9 OR r60 < 0.9 OR r90 < 0.9 THEN 1 ELSE 0 END AS below_floor FROM (
    SELECT method, {', '.join(f'sum(valid_rate * n) FILTER (WHERE depth = {d}) / sum(n) FILTER (WHERE depth = {d}) AS r{d}' for d in (30, 60, 90))}, min(valid_rate) AS m FROM ({VALID}) GROUP BY method)""")
tail("f11_effective_sample", "cells", """SELECT is_holdout, target_g, count(DISTINCT family) FILTER (WHERE capped = 0) AS families_used, count(*) FILTER (WHERE capped = 0) AS cells_used,
    count(DISTINCT family) - count(DISTINCT family) FILTER (WHERE capped = 0) AS families_capped FROM (SELECT DISTINCT is_holdout, target_g, family, depth, noise, capped FROM cells) GROUP BY ALL""")
tail("f12_invalid_rates", "cells", f"""SELECT noise, depth, sum(1 - valid)::BIGINT AS n_invalid, count(*) AS n, {R('avg((1 - valid)::DOUBLE)')} AS invalid_rate FROM rec
    WHERE is_trivial = 0 AND method NOT IN (SELECT method FROM ({EXCLUDED}) WHERE eligible = 1 AND v < 0.9) GROUP BY GROUPING SETS ((noise), (depth), ())""")
_bin = "SELECT curve_id, CASE WHEN l >= 0.005 AND l < 0.0232 THEN 'low' WHEN l >= 0.0232 AND l < 0.1077 THEN 'mid' WHEN l >= 0.1077 AND l < 0.5 THEN 'high' END AS bin FROM (SELECT curve_id, 2e0 * max_by(value, step) AS l FROM curve GROUP BY 1)"
tail("f13_tercile_statistics", "gap", f"""WITH b AS ({_bin}), q AS (SELECT rec.*, bin FROM rec JOIN b USING (curve_id) WHERE capped = 0 AND bin IS NOT NULL)
    {panel('bin, method, target_g', 'q')} UNION ALL BY NAME SELECT *, 'classical (pooled)' AS method FROM ({panel('bin, target_g', f'(SELECT * FROM q WHERE method IN {CLASSICAL})')})""")
TARGETS = f"""SELECT {CELL}, max(capped) AS capped, count(*) FILTER (WHERE valid = 1) AS n_valid_R, count(*) AS n_total,
    count(*) FILTER (WHERE error IS NOT NULL AND e_last <= 1e-12) AS n_zero_denominator, max(CASE WHEN error IS NOT NULL AND e_last <= 1e-12 THEN 1 ELSE 0 END) AS zero_denominator_cell,
    median(CASE WHEN valid = 1 THEN {_skill('error', 'e_last')} END) AS R_R_med, median(CASE WHEN valid = 1 THEN error END) AS med_error_R,
    CASE WHEN median(error) = 0 THEN '-inf'::DOUBLE ELSE ln(median(error)) END AS log_med_error_R FROM rec WHERE method = 'richardson_1' GROUP BY {CELL}"""
tail("f17_denominator_counts", "gap", f"""SELECT target_g, sum(n_zero_denominator)::BIGINT AS n_records_zero_denominator, sum(zero_denominator_cell)::BIGINT AS n_cells_affected,
    sum(n_total)::BIGINT AS n_records_total, count(*) AS n_cells_total FROM ({TARGETS}) WHERE capped = 0 GROUP BY target_g""")
tail("f20_ladder_panels", "gap", f"""WITH q AS (SELECT rec.*, lv AS noise_level FROM rec CROSS JOIN (VALUES ('pooled'), ('0.0'), ('0.005')) t(lv)
    WHERE capped = 0 AND method IN {CLASSICAL} AND (lv = 'pooled' OR noise = lv::DOUBLE))
    {panel('method, noise_level', 'q', 'count(DISTINCT (family, is_holdout, depth, noise, target_g)) AS n_cells||n_cells')}""")
tail("f22_skill_summary", "cells", f"""WITH q AS (SELECT method_family, target_g, is_holdout, method, is_trivial, CASE WHEN med_skill < 1 THEN 1 ELSE 0 END AS b FROM cells WHERE capped = 0 AND is_oracle = 0)
    SELECT method_family, target_g, is_holdout, count(DISTINCT method) AS n_methods, sum(b)::BIGINT AS n_below, count(*) AS n_cells, {R('avg(b::DOUBLE)')} AS share_below FROM q GROUP BY ALL
    UNION ALL SELECT 'all accelerators', target_g, is_holdout, count(DISTINCT method), sum(b)::BIGINT, count(*), {R('avg(b::DOUBLE)')} FROM q WHERE is_trivial = 0 GROUP BY ALL""")
tail("f23_final_loss_by_depth", "step", f"""SELECT depth, method, {R('median(CASE WHEN valid = 1 THEN 1e2 * error / true_val END)')} AS med_pct, {R('max(CASE WHEN valid = 1 THEN 1e2 * error / true_val END)')} AS max_pct,
    sum(valid)::BIGINT AS n_valid, count(*) AS n FROM srec WHERE argmin_round >= 400 AND n_f = 400 AND method IN ('last_value', 'rational_fit', 'single_exp_fit') GROUP BY depth, method""")
tail("f24_fixed_method_blocks", "step", f"""SELECT coalesce(family, 'ALL') AS family, method, CASE WHEN post_min_target IS NULL THEN 'all' WHEN post_min_target = 1 THEN 'post' ELSE 'pre' END AS stratum,
    count(*) AS n, sum(valid)::BIGINT AS n_valid, sum(win_vs_last)::BIGINT AS n_win, sum(catastrophic)::BIGINT AS n_cat, {R('median(CASE WHEN valid = 1 THEN skill_vs_last END)')} AS med_ratio,
    {R('median(CASE WHEN valid = 1 THEN improve_ratio END)')} AS med_improve FROM srec WHERE method IN ('last_value', 'rational_fit', 'single_exp_fit')
    GROUP BY GROUPING SETS ((family, post_min_target, method), (family, method), (post_min_target, method), (method))""")
tail("f26_noop_statistics", "cells", f"""WITH q AS (SELECT target_g, is_holdout, method, nc, median(med_improve) AS mi, {mean_rate('win_rate_vs_last')} AS win, count(*) AS n FROM (
      SELECT *, unnest(['all', CASE WHEN noise = 0 THEN 'noise-free' ELSE 'sigma=0.005' END]) AS nc FROM cells WHERE capped = 0 AND method IN {CLASSICAL}) GROUP BY ALL)
    SELECT target_g, is_holdout, nc AS noise_class, count(*) AS n_variants, max(n) AS n_cells, count(*) FILTER (WHERE mi BETWEEN 0.9 AND 1.1) AS n_mi_band, count(*) FILTER (WHERE win BETWEEN 0.4 AND 0.6) AS n_win_band,
    {R('min(mi)')} AS min_mi, {R('median(mi)')} AS med_mi, {R('max(mi)')} AS max_mi, {R('min(win)')} AS min_win, {R('median(win)')} AS med_win, {R('max(win)')} AS max_win FROM q GROUP BY ALL""")
tail("f28_baseline_summary", "pooled", f"""SELECT regime_set, target_g, arg_min(method, accel_rank) FILTER (WHERE is_trivial = 0) AS best_method, (sum(rank_eligible) FILTER (WHERE is_trivial = 0))::BIGINT AS n_eligible,
    {', '.join(f'{R(f"median({c}) FILTER (WHERE is_trivial = 0)")} AS median_{c}' for c in ('med_error', 'med_skill', 'win_rate_vs_assumed', 'win_rate_vs_last'))},
    count(*) FILTER (WHERE is_trivial = 0 AND win_rate_vs_assumed > 0.5) AS n_win_assumed, count(*) FILTER (WHERE is_trivial = 0 AND win_rate_vs_last > 0.5) AS n_win_last,
    count(*) FILTER (WHERE is_trivial = 0 AND med_skill < 1) AS n_strict, {', '.join(f'''{R(f"max(med_error) FILTER (WHERE method = '{m}')")} AS {a}_error''' for m, a in (('constant_oracle', 'oracle'), ('constant_assumed', 'assumed'), ('last_value', 'last')))}
    FROM pooled GROUP BY regime_set, target_g""")
tail("f29_capped_inventory", "cells", f"""SELECT family, is_holdout, target_g, {r_as([])}{R('min(n_f)')} AS min_n_f, {R('max(n_f)')} AS max_n_f, {R('min(achieved_g)')} AS min_achieved, {R('max(achieved_g)')} AS max_achieved,
    count(*) AS n_cells, count(DISTINCT depth) AS n_depths FROM (SELECT DISTINCT family, is_holdout, depth, noise, target_g, n_f, achieved_g FROM cells WHERE capped = 1) GROUP BY ALL""")
tail("f30_wins_everywhere", "step", """WITH q AS (SELECT split, method, sum(win_vs_last)::BIGINT AS n_win, count(*) AS n FROM (
      SELECT *, unnest(['all', CASE WHEN post_min_target = 1 THEN 'post' ELSE 'pre' END]) AS split FROM srec WHERE is_trivial = 0) GROUP BY ALL)
    SELECT q.*, d.n_win AS default_wins, (q.n_win = q.n)::INTEGER AS wins_every, (q.n_win > d.n_win)::INTEGER AS more_than_default FROM q JOIN q d ON d.split = q.split AND d.method = 'rational_fit'""")
tail("f31_ladders_under_noise", "cells", f"""WITH q AS (SELECT target_g, noise, method, median(med_error) AS e, {mean_rate('win_rate_vs_last')} AS w FROM cells WHERE capped = 0 AND (method IN {CLASSICAL} OR method = 'last_value') GROUP BY ALL)
    SELECT a.target_g, a.noise, count(*) FILTER (WHERE a.e < 0.9::DOUBLE * b.e) AS n_below, count(*) FILTER (WHERE a.w > 0.6) AS n_win, arg_min(a.method, {{'e': round(a.e, 9), 'm': a.method}}) AS lowest, {R('min(a.e)')} AS lowest_error
    FROM q a JOIN q b ON a.target_g = b.target_g AND a.noise = b.noise AND b.method = 'last_value' WHERE a.method <> 'last_value' GROUP BY ALL""")
tail("f33_phase_diagram", "gap", f"SELECT target_g, depth, noise, {R('median(R_R_med)')} AS R_R_med, count(*) AS n_cells FROM ({TARGETS}) WHERE capped = 0 GROUP BY ALL")
tail("f34_roster_by_family", "gap", """SELECT method_family, count(*) AS n_methods, CASE WHEN count(DISTINCT method_type) = 1 THEN min(method_type) ELSE 'mixed' END AS method_type,
    string_agg(method, ',' ORDER BY registry_index) AS members FROM (SELECT DISTINCT method, method_family, method_type, registry_index FROM rec) GROUP BY method_family""")
tail("f35_best_order", "pooled", f"""SELECT method_family, target_g, arg_min(method, {{'e': round(med_error, 9), 'm': method}}) FILTER (WHERE med_error IS NOT NULL) AS best, {R('min(med_error)')} AS best_error, count(*) AS n_orders
    FROM pooled WHERE is_holdout = 0 AND is_trivial = 0 GROUP BY ALL""")
# recorded summary
tail("f16_recorded_strata", "recorded", f"""WITH q AS (SELECT *, CASE WHEN cascade_skill >= 1 THEN 1 ELSE 0 END AS f, unnest(['all', CASE WHEN post_min_target = 1 THEN 'post_min' ELSE 'pre_min' END]) AS stratum FROM rsum),
    k AS (SELECT stratum, f, perturb_iqr, cascade_skill, rank() OVER (PARTITION BY stratum ORDER BY perturb_iqr) + (count(*) OVER (PARTITION BY stratum, perturb_iqr) - 1) / 2e0 AS rk FROM q WHERE perturb_iqr IS NOT NULL AND cascade_skill IS NOT NULL),
    a AS (SELECT stratum, CASE WHEN sum(f) > 0 AND sum(1 - f) > 0 THEN (sum(CASE WHEN f = 1 THEN rk END) - sum(f) * (sum(f) + 1) / 2e0) / (sum(f) * sum(1 - f)) END AS perturb_auc FROM k GROUP BY stratum)
    SELECT stratum, count(*) AS n_cells, sum(f)::BIGINT AS n_fail, {rate4('avg(f::DOUBLE)')} AS fail_rate, count(*) FILTER (WHERE improvement < 0) AS n_neg_improvement, {R('median(cascade_err)')} AS med_cascade_err,
    {R('median(cascade_skill)')} AS med_cascade_skill, {R('median(improvement)')} AS med_improvement, {R('median(perturb_iqr) FILTER (WHERE f = 1)')} AS med_perturb_iqr_fail, {R('median(perturb_iqr) FILTER (WHERE f = 0)')} AS med_perturb_iqr_succ,
    {', '.join(f"{rate4(f'avg(cascade_win_vs_{t}::DOUBLE)')} AS win_rate_vs_{t}" for t in TAGS)}, {R('any_value(perturb_auc)')} AS perturb_auc FROM q LEFT JOIN a USING (stratum) GROUP BY stratum""")
tail("f21_value_counts", "recorded", f"""WITH c AS (SELECT ref_best_method, count(*) AS n FROM rsum GROUP BY 1) SELECT ref_best_method, n, {R('n::DOUBLE / (SELECT count(*) FROM rsum)')} AS share,
    (ref_best_method = (SELECT arg_max(ref_best_method, {{'n': n, 'm': ref_best_method}}) FROM c))::INTEGER AS is_top FROM c""")
tail("f21_crosstab", "recorded", "SELECT post_min_target, fail, count(*) AS n FROM (SELECT post_min_target, CASE WHEN cascade_skill >= 1 THEN 1 ELSE 0 END AS fail FROM rsum) GROUP BY CUBE (post_min_target, fail)")
tail("f27_reduction_by_depth", "recorded", f"""SELECT depth, {R('a')} AS mean_cascade, {R('b')} AS mean_current, {R('1e0 - a / b')} AS reduction FROM (
    SELECT depth, avg(cascade_err) AS a, avg(current_err) AS b FROM rsum WHERE cascade_err IS NOT NULL GROUP BY ROLLUP (depth))""")
tail("f32_recorded_means", "recorded", f"""SELECT depth, n_f, {R('avg(cascade_err)')} AS mean_cascade, {R('avg(richardson_err)')} AS mean_richardson, {R('avg(rational_err)')} AS mean_rational, {R('avg(current_err)')} AS mean_current,
    {R('avg(CASE WHEN cascade_skill < 1 THEN 1e0 WHEN cascade_skill IS NOT NULL THEN 0e0 END)')} AS share_beating FROM rsum GROUP BY depth, n_f""")
tail("f36_worst_cells", "recorded", f"""SELECT family, depth, selected_method, count(*) AS n, count(*) FILTER (WHERE cascade_skill >= 1) AS n_fail, arg_max(curve_id, {{'s': round(cascade_skill, 6), 'c': curve_id}}) AS worst_curve,
    {R('max(cascade_skill)')} AS worst_skill FROM rsum GROUP BY ALL""")

# G
tail("g1_assign_ranks", "pooled", f"SELECT regime_set, target_g, method, {R('med_error')} AS med_error, {R('valid_rate')} AS valid_rate, rank_eligible, rank::INTEGER AS rank FROM pooled")
tail("g2_unranked_block", "pooled", f"SELECT regime_set, target_g, method, {r_as(['valid_rate', 'cat_rate', 'med_error'])}, n_cells FROM pooled WHERE rank_eligible = 0 AND valid_rate < 0.9 AND is_oracle = 0")
tail("g3_rank_accelerators", "pooled", "SELECT regime_set, target_g, method, accel_rank::INTEGER AS accel_rank FROM pooled WHERE accel_rank IS NOT NULL")
tail("g4_best_per_family", "cells", f"""WITH p AS (SELECT family, is_holdout, target_g, method, {mean_rate('valid_rate')} AS v, median(med_error) AS e, median(med_skill) AS s FROM cells WHERE is_oracle = 0 GROUP BY ALL),
    b AS (SELECT family, is_holdout, target_g, arg_min({{'m': method, 's': s, 'e': e, 'v': v}}, {{'a': round(s, 9), 'b': round(e, 9), 'c': method}}) FILTER (WHERE s IS NOT NULL) AS bs,
      arg_min({{'m': method, 'e': e, 'v': v}}, {{'a': round(e, 9), 'c': method}}) FILTER (WHERE v >= 0.9 AND e IS NOT NULL) AS be, count(*) FILTER (WHERE v >= 0.9 AND e IS NOT NULL) AS n FROM p GROUP BY ALL),
    m AS (SELECT family, is_holdout, target_g, max(capped) AS capped, median(med_error) FILTER (WHERE is_oracle = 1) AS o FROM cells GROUP BY ALL)
    SELECT family, is_holdout, target_g, capped, coalesce(bs.m, '') AS best_by_skill, {R('bs.s')} AS best_skill, {R('bs.e')} AS skill_best_med_error, {rate4('bs.v')} AS skill_best_valid_rate, coalesce(be.m, '') AS best_by_error,
    {R('be.e')} AS err_best_med_error, {rate4('be.v')} AS err_best_valid_rate, coalesce(n, 0) AS n_at_floor, {R('o')} AS oracle_med_error FROM m LEFT JOIN b USING (family, is_holdout, target_g)""")
LEAD = """SELECT method, core_rank, hold_rank, row_number() OVER (ORDER BY core_rank NULLS LAST, hold_rank NULLS LAST, method) AS position FROM (
    SELECT c.method, c.accel_rank AS core_rank, h.accel_rank AS hold_rank FROM pooled c JOIN pooled h ON c.method = h.method AND h.is_holdout = 1 AND h.target_g = 0.5
    WHERE c.is_holdout = 0 AND c.target_g = 0.5 AND c.is_trivial = 0 AND (c.accel_rank <= 10 OR h.accel_rank <= 5 OR c.method IN ('rational_fit', 'single_exp_fit')
      OR c.method IN (SELECT method FROM pooled WHERE is_holdout = 0 AND target_g = 0.5 AND is_trivial = 0 AND rank_eligible = 1 ORDER BY win_rate_vs_last DESC, method LIMIT 3)))"""
tail("g5_leading_methods", "pooled", f"SELECT method, core_rank::INTEGER AS core_rank, hold_rank::INTEGER AS hold_rank, position::INTEGER AS position FROM ({LEAD})")
tail("g6_top_ten", "pooled", f"SELECT method, {R('med_error')} AS med_error, {R('valid_rate')} AS valid_rate FROM (SELECT * FROM pooled WHERE is_holdout = 0 AND target_g = 0.5 AND rank_eligible = 1 ORDER BY round(med_error, 9), method LIMIT 10)")
tail("g7_previous_value", "mean", f"""WITH a AS (SELECT curve_id, step, value, lag(value) OVER w AS p FROM curve WINDOW w AS (PARTITION BY curve_id ORDER BY step)), b AS (SELECT *, value - p AS d FROM a),
    c AS (SELECT *, lag(d) OVER (PARTITION BY curve_id ORDER BY step) AS pd FROM b)
    SELECT curve_id, step, {R('d', 8)} AS diff, {R('CASE WHEN p IS NOT NULL THEN value / greatest(abs(p), 1e-15) END', 8)} AS ratio, {R('d - pd', 8)} AS second_diff, CASE WHEN d * pd < 0 THEN 1 ELSE 0 END AS sign_change FROM c""")
tail("g8_running_minimum", "mean", f"SELECT curve_id, step, {R('min(value) OVER (PARTITION BY curve_id ORDER BY step)', 8)} AS envelope FROM curve")
tail("g9_average_rank", "gap", """SELECT DISTINCT target_g, e3, rank() OVER (PARTITION BY target_g ORDER BY e3) + (count(*) OVER (PARTITION BY target_g, e3) - 1) / 2e0 AS avg_rank, count(*) OVER (PARTITION BY target_g, e3) AS ties
    FROM (SELECT target_g, round(error, 3) AS e3 FROM rec WHERE method = 'rational_fit' AND error IS NOT NULL)""")
FBEST = f"""WITH f AS ({FAMILY.format(keys='family, is_holdout, target_g, method')}), j AS (SELECT f.*, p.method IS NOT NULL AS ok FROM f LEFT JOIN pooled p ON p.is_holdout = f.is_holdout AND p.target_g = f.target_g AND p.method = f.method AND p.rank_eligible = 1 AND p.is_trivial = 0),
    a AS (SELECT family, is_holdout, target_g, max(n) FILTER (WHERE method = 'rational_fit') AS n_cells, max(med_error) FILTER (WHERE method = 'last_value') AS last_error,
      {', '.join(f"max({c}) FILTER (WHERE method = '{m}') AS {m}_{c}" for m in ('rational_fit', 'single_exp_fit') for c in ('med_error', 'win'))},
      arg_min(method, {{'e': round(med_error, 9), 'm': method}}) FILTER (WHERE ok AND med_error IS NOT NULL) AS best_method, arg_min(med_error, {{'e': round(med_error, 9), 'm': method}}) FILTER (WHERE ok AND med_error IS NOT NULL) AS best_error FROM j GROUP BY ALL),
    b AS (SELECT e.family, e.is_holdout, e.target_g, coalesce(n_cells, 0) AS n_cells, a.* EXCLUDE (family, is_holdout, target_g, n_cells) FROM (SELECT DISTINCT family, is_holdout, target_g FROM cells) e LEFT JOIN a USING (family, is_holdout, target_g))"""
tail("g10_family_best", "pooled", f"{FBEST} SELECT family, is_holdout, target_g, n_cells, {r_as(['last_error', 'rational_fit_med_error', 'rational_fit_win', 'single_exp_fit_med_error', 'single_exp_fit_win', 'best_error'])}, best_method FROM b")
tail("g10_family_best_footer", "pooled", f"""{FBEST} SELECT is_holdout, target_g, count(*) AS n_families, count(*) FILTER (WHERE rational_fit_win > 0.5) AS n_win, count(*) FILTER (WHERE rational_fit_med_error > last_error) AS n_worse_than_last
    FROM b WHERE n_cells > 0 GROUP BY ALL""")
tail("g11_ordered_output", "cells", f"""SELECT *, (row_number() OVER (PARTITION BY is_holdout, target_g ORDER BY family, depth, class_order))::INTEGER AS position FROM (
    SELECT DISTINCT {CELL}, CASE WHEN noise = 0 THEN 0e0 ELSE 2.005::DOUBLE END AS class_order FROM cells)""")

# H, S
CANDS = [m for m in DIAG_POOL if m != "last_value"] + ["last_value"]
GRIDQ = f"""SELECT {GRID}, max(n_f) AS n_f, max(capped) AS capped, max(is_holdout) AS is_holdout, {', '.join(f"max(med_error) FILTER (WHERE method = '{m}') AS med_error__{m}" for m in CANDS)},
    coalesce(arg_min(method, {{'e': round(med_error, 9), 'm': method}}) FILTER (WHERE med_error IS NOT NULL), '{CANDS[0]}') AS oracle_method FROM cells WHERE method IN {inlist(CANDS)} GROUP BY {GRID}"""
ENH = f"""CASE WHEN {CASCADE} = 'rational_fit' THEN 'rational_fit' WHEN curvature_idx > 0.5 AND diff_ratio_cv < 0.05 THEN 'levin_t2' WHEN oscillation_idx > 0.3 AND diff_ratio_cv > 0.2 THEN 'log_linear'
    WHEN n_f <= 300 THEN 'rational_fit' ELSE 'single_exp_fit' END"""
CHOICES = f"""SELECT {GRID}, is_holdout, capped, n_f, sel.s AS selector, sel.m AS method FROM (SELECT g.*, f.* EXCLUDE (family, depth, noise), unnest([{{'s': 'fixed_last', 'm': 'last_value'}}, {{'s': 'fixed_richardson', 'm': 'richardson_1'}},
    {{'s': 'fixed_rational', 'm': 'rational_fit'}}, {{'s': 'fixed_single_exp', 'm': 'single_exp_fit'}}, {{'s': 'phase2_cascade', 'm': {CASCADE}}}, {{'s': 'enhanced_cascade', 'm': {ENH}}}, {{'s': 'oracle', 'm': oracle_method}}]) AS sel
    FROM ({GRIDQ}) g LEFT JOIN cfeat f USING (family, depth, noise))"""
tail("h1_chosen_records", "cellsfeat", f"SELECT c.family, c.depth, c.noise, c.target_g, r.curve_id, c.method, r.valid, {R('r.error')} AS error FROM ({CHOICES}) c JOIN rec r USING (family, depth, noise, target_g, method) WHERE selector = 'phase2_cascade'")
tail("h2_record_pairing", "gap", f"""SELECT a.family, a.target_g, count(*) AS n_pairs, count(*) FILTER (WHERE a.valid = 1 AND b.valid = 1) AS n_both_valid, {R('avg(CASE WHEN a.valid = 1 AND b.valid = 1 AND b.error < a.error THEN 1e0 ELSE 0e0 END)')} AS lower_error_frac
    FROM rec a JOIN rec b USING (curve_id, depth, noise, target_g) WHERE a.method = 'richardson_1' AND b.method = 'rational_fit' AND a.capped = 0 GROUP BY ALL""")
tail("h3_cell_median_pairing", "gap", f"""SELECT *  REPLACE ({R('med_a')} AS med_a, {R('med_b')} AS med_b), {R('(med_b - med_a) / med_a')} AS rel_change FROM (SELECT {CELL}, median(error) FILTER (WHERE method = 'richardson_1' AND valid = 1) AS med_a,
    median(error) FILTER (WHERE method = 'rational_fit' AND valid = 1) AS med_b FROM rec WHERE method IN ('richardson_1', 'rational_fit') GROUP BY {CELL})""")
tail("h4_features_to_cells", "gapfeat", f"SELECT t.family, t.depth, t.noise, target_g, {r_as(['R_R_med', 'log_log_slope', 'richardson_r2'])} FROM ({TARGETS}) t LEFT JOIN cfeat USING (family, depth, noise)")
tail("h5_evaluation_grid", "cellsfeat", f"SELECT {GRID}, {r_as(['n_f', 'med_error__rational_fit', 'med_error__levin_t2', 'curvature_idx'])}, capped, oracle_method FROM ({GRIDQ}) LEFT JOIN cfeat USING (family, depth, noise)")
tail("h6_flags_to_records", "gapfeat", "SELECT method, CASE WHEN richardson_r2 < 0.9 THEN 1 ELSE 0 END AS fired, count(*) AS n, sum(valid)::BIGINT AS n_valid FROM rec JOIN cfeat USING (family, depth, noise) GROUP BY ALL")
tail("h7_outside_excluded", "cells", f"SELECT method, count(*) AS n FROM rec WHERE method NOT IN (SELECT method FROM ({EXCLUDED}) WHERE eligible = 1 AND v < 0.9) GROUP BY method")
tail("h8_cells_of_class", "cells", f"""SELECT family, depth, target_g, count(*) AS n, {R('avg(error)')} AS mean_error FROM rec WHERE noise > 0 AND (family, depth, noise, target_g) IN
    (SELECT (family, depth, noise, target_g) FROM cells WHERE capped = 0) GROUP BY ALL""")
tail("h9_range_join", "se", """SELECT a.curve_id, a.step AS depth, min(b.step) AS first_step, count(*) AS n_steps FROM curve a JOIN curve b ON a.curve_id = b.curve_id AND b.step > a.step AND b.value <= 0.5::DOUBLE * a.value
    WHERE a.step IN (30, 60) GROUP BY ALL""")


def _rules(rules):
    vals = ", ".join(f"({i}, '{f}', '{op}', {t!r}::DOUBLE, '{alt}')" for i, (f, op, t, alt) in enumerate(rules))
    fl = " ".join(f"WHEN feature = '{f}' THEN {f}" for f in FEATURES)
    return f"""SELECT * FROM (SELECT family, depth, noise, rule, feature, operator, threshold, alternative, CASE {fl} END AS fv, CASE WHEN (operator = '<' AND CASE {fl} END < threshold) OR (operator = '>' AND CASE {fl} END > threshold) THEN 1 ELSE 0 END AS fired
        FROM {{cells}} CROSS JOIN (VALUES {vals}) r(rule, feature, operator, threshold, alternative)) WHERE fv IS NOT NULL"""


tail("h10_rules_times_cells", "cfeat", f"SELECT rule, alternative, count(*) AS n_cells, sum(fired)::BIGINT AS n_fired FROM ({_rules(CANDIDATE_RULES).format(cells='cfeat')}) GROUP BY ALL")
_cmp = "count(*) FILTER (WHERE a.method IS NOT NULL AND b.method IS NOT NULL) AS n_both, count(*) FILTER (WHERE b.method IS NULL) AS only_left, count(*) FILTER (WHERE a.method IS NULL) AS only_right"
_cj = "FROM (SELECT *, round(error, 3) AS e3 FROM rec WHERE noise = 0) a FULL JOIN (SELECT *, round(error, 3) AS e3 FROM rec WHERE noise > 0) b ON a.curve_id = b.curve_id AND a.depth = b.depth AND a.target_g = b.target_g AND a.method = b.method"
tail("h11_table_comparison", "gap", f"SELECT {_cmp}, {', '.join(f'count(*) FILTER (WHERE a.{c} IS DISTINCT FROM b.{c}) AS diff_{c}' for c in ('n_f', 'valid', 'catastrophic'))} {_cj}")
tail("h12_head_to_head", "cells", f"""WITH f AS ({FAMILY.format(keys='family, is_holdout, target_g, method')}), a AS (SELECT y.is_holdout, y.target_g, y.method, count(*) FILTER (WHERE x.med_error < y.med_error) AS families_lower, count(*) AS families_n
      FROM f y JOIN f x ON x.family = y.family AND x.target_g = y.target_g AND x.method = 'rational_fit' AND x.med_error IS NOT NULL WHERE y.method <> 'rational_fit' AND y.med_error IS NOT NULL GROUP BY ALL),
    b AS (SELECT y.is_holdout, y.target_g, y.method, count(*) FILTER (WHERE x.med_error < y.med_error) AS cells_lower, count(*) AS cells_n FROM cells y JOIN cells x ON x.family = y.family AND x.depth = y.depth AND x.noise = y.noise AND x.target_g = y.target_g
      AND x.method = 'rational_fit' AND x.capped = 0 AND x.med_error IS NOT NULL WHERE y.capped = 0 AND y.method <> 'rational_fit' AND y.med_error IS NOT NULL GROUP BY ALL)
    SELECT is_holdout, target_g, method, families_lower, families_n, cells_lower, cells_n FROM a FULL JOIN b USING (is_holdout, target_g, method)""")
tail("h13_trial_counts", "gap", f"SELECT {CELL}, count(DISTINCT curve_id) AS n_runs, count(DISTINCT curve_id) * (count(DISTINCT curve_id) - 1) AS n_pairs FROM rec GROUP BY {CELL}")
_sbs = ["med_error", "med_skill", "cat_rate", "valid_rate"]
tail("h14_side_by_side", "pooled", f"""SELECT c.method, c.target_g, {', '.join(f'{R(f"c.{x}")} AS core_{x}, {R(f"h.{x}")} AS hold_{x}' for x in _sbs)}, c.accel_rank::INTEGER AS core_accel_rank, h.accel_rank::INTEGER AS hold_accel_rank,
    CASE WHEN c.accel_rank IS NULL THEN 'unranked' ELSE 'ranked' END AS block FROM pooled c JOIN pooled h ON c.method = h.method AND c.target_g = h.target_g AND c.is_holdout = 0 AND h.is_holdout = 1 WHERE c.is_trivial = 0""")
tail("h15_rank_shift", "pooled", """SELECT c.method, c.target_g, c.accel_rank::INTEGER AS core_rank, h.accel_rank::INTEGER AS hold_rank, (h.accel_rank - c.accel_rank)::INTEGER AS shift
    FROM pooled c JOIN pooled h ON c.method = h.method AND c.target_g = h.target_g AND c.is_holdout = 0 AND h.is_holdout = 1 WHERE c.is_trivial = 0""")
tail("s1_row_union", "pooled", "SELECT regime_set, target_g, count(*) AS n_rows FROM pooled GROUP BY ALL")
tail("s2_ordered_union", "pooled", """SELECT method, (row_number() OVER (ORDER BY l, p))::INTEGER AS position FROM (SELECT method, min(struct_pack(l := is_holdout, p := accel_rank)) AS o, min(struct_pack(l := is_holdout, p := accel_rank)).l AS l,
    min(struct_pack(l := is_holdout, p := accel_rank)).p AS p FROM pooled WHERE target_g = 0.5 AND accel_rank <= 5 GROUP BY method)""")
tail("s3_set_difference", "cells", f"SELECT method, 'added' AS change FROM ({EXCLUDED}) WHERE eligible = 1 AND v < 0.95 AND v >= 0.9")
tail("s4_intersection", "pooled", "SELECT target_g, method FROM pooled WHERE accel_rank IS NOT NULL GROUP BY ALL HAVING count(*) = 2")
tail("s5_distinct_keys", "cells", f"SELECT DISTINCT {CELL}, r.capped FROM rec r")

# I
tail("i1_cascade", "feat", f"SELECT curve_id, depth, noise, {CASCADE} AS selected_method FROM feat")
tail("i2_enhanced_cascade", "cellsfeat", f"SELECT {GRID}, method AS selected_method FROM ({CHOICES}) WHERE selector = 'enhanced_cascade'")
tail("i3_threshold_rule", "cfeat", "SELECT family, depth, noise, CASE WHEN log_log_slope > -0.52 THEN 1 ELSE 0 END AS fired FROM cfeat WHERE log_log_slope IS NOT NULL")


def rule_panel(flags: str, by: str, target: str, recs: str = "rec", keys: str = "family, depth, noise", run: str = "curve_id") -> str:
    """Rule panels from flags(keys, by, fired, alternative)."""
    fl = ", ".join(f"f.{b.strip()}" for b in by.split(","))
    fk = ", ".join(f"f.{k.strip()}" for k in keys.split(","))
    wide = ", ".join(f"max({c}) FILTER (WHERE side = '{s}' AND fired = {v}) AS {p}{s}_{c}" for p, v in (("", 1), ("nf_", 0)) for s in ("r1", "alt") for c in PANEL)
    out = ", ".join((f"{p}{s}_{c}" if c.startswith("n_") else f"{R(f'{p}{s}_{c}')} AS {p}{s}_{c}") for p in ("", "nf_") for s in ("r1", "alt") for c in PANEL)
    return f"""WITH fl AS ({flags}), q AS (SELECT {fk}, {fl}, f.fired, s.side, r.{run}, r.error, r.valid, r.catastrophic, r.e_last FROM fl f CROSS JOIN (VALUES ('r1'), ('alt')) s(side)
          JOIN {recs} r USING ({keys}) WHERE r.method = CASE WHEN s.side = 'r1' THEN 'richardson_1' ELSE f.alternative END {target}),
        n AS (SELECT {by}, count(*) AS n_cells_total, sum(fired)::BIGINT AS n_cells_fired, avg(fired::DOUBLE) AS fire_rate FROM fl GROUP BY {by}),
        w AS (SELECT {by}, {wide} FROM (SELECT {by}, side, fired, {panel_columns()} FROM q GROUP BY {by}, side, fired) GROUP BY {by}),
        lr AS (SELECT {by}, avg(CASE WHEN v1 = 1 AND v2 = 1 AND e2 < e1 THEN 1e0 ELSE 0e0 END) AS lrec FROM (SELECT {by}, {keys}, {run}, max(error) FILTER (WHERE side = 'r1') AS e1, max(error) FILTER (WHERE side = 'alt') AS e2,
          max(valid) FILTER (WHERE side = 'r1') AS v1, max(valid) FILTER (WHERE side = 'alt') AS v2 FROM q WHERE fired = 1 GROUP BY {by}, {keys}, {run}) GROUP BY {by}),
        lc AS (SELECT {by}, avg(CASE WHEN m2 < m1 THEN 1e0 ELSE 0e0 END) AS lcell, median((m2 - m1) / m1) AS rel FROM (SELECT {by}, {keys}, median(error) FILTER (WHERE side = 'r1' AND valid = 1) AS m1,
          median(error) FILTER (WHERE side = 'alt' AND valid = 1) AS m2 FROM q WHERE fired = 1 GROUP BY {by}, {keys}) GROUP BY {by})
        SELECT {by}, n_cells_total, n_cells_fired, {R('fire_rate')} AS fire_rate, {out}, {R('lrec')} AS lower_error_frac_records, {R('lcell')} AS lower_error_frac_cells, {R('rel')} AS median_rel_change
        FROM n LEFT JOIN w USING ({by}) LEFT JOIN lr USING ({by}) LEFT JOIN lc USING ({by})"""


_by = "rule, feature, operator, threshold, alternative"
tail("f2_rule_panel", "gapfeat", rule_panel("""SELECT family, depth, noise, 0 AS rule, 'log_log_slope' AS feature, '>' AS operator, -0.52::DOUBLE AS threshold, 'rational_fit' AS alternative,
    CASE WHEN log_log_slope > -0.52 THEN 1 ELSE 0 END AS fired FROM cfeat WHERE log_log_slope IS NOT NULL""", _by, "AND r.target_g = 0.5"))
_known = [r for r in CANDIDATE_RULES if r[3] in DEFAULT_METHODS]
tail("i4_candidate_rules", "cellsfeat", rule_panel(_rules(_known).format(cells="(SELECT * FROM cfeat WHERE (family, depth, noise) IN (SELECT (family, depth, noise) FROM cells WHERE capped = 0 AND target_g = 0.5 AND method = 'richardson_1'))"), _by, "AND r.target_g = 0.5"))
_selrec = f"(SELECT c.selector, r.*, (r.family, r.depth, r.noise, r.target_g) AS ck FROM ({CHOICES}) c JOIN rec r USING (family, depth, noise, target_g, method) WHERE c.capped = 0)"
tail("i5_selectors", "cellsfeat", panel("selector, target_g", _selrec, "count(DISTINCT ck) AS n_cells||n_cells"))
tail("i5_selectors_by_family", "cellsfeat", panel("selector, family, target_g", _selrec, "count(DISTINCT ck) AS n_cells||n_cells"))
tail("i6_hindsight_pick", "cells", f"SELECT {GRID}, oracle_method FROM ({GRIDQ})")
tail("i7_validity_spread", "cellsfeat", f"""SELECT target_g, {R('max(v) - min(v)')} AS spread, CASE WHEN max(v) - min(v) > 0.001 THEN 1 ELSE 0 END AS warned FROM (SELECT selector, target_g, avg(valid::DOUBLE) AS v FROM {_selrec} GROUP BY ALL) GROUP BY target_g""")
tail("i8_capped_choices", "cellsfeat", f"SELECT c.family, c.depth, c.noise, c.target_g, selector, c.method AS chosen_method, {R('x.med_error')} AS chosen_med_error FROM ({CHOICES}) c LEFT JOIN cells x USING (family, depth, noise, target_g, method) WHERE c.capped = 1")
_scr = ", ".join(f"({i}, {'NULL' if t is None else repr(t)}::DOUBLE)" for i, t in enumerate(SCREEN_THRESHOLDS))
_one = "(SELECT * FROM drec WHERE method = '{}')"
tail("i9_screened_cascade", "diagfeat", f"""WITH w AS (SELECT l.target_g, t.i AS screen, t.t AS iqr_threshold, c.chosen, CASE WHEN c.chosen = 'rational_fit' THEN r.perturb_iqr ELSE p.perturb_iqr END AS q,
      p.error AS ep, p.valid AS vp, p.catastrophic AS cp, r.error AS er, r.valid AS vr, r.catastrophic AS cr, l.error AS el, l.valid AS vl, l.catastrophic AS cl
      FROM {_one.format('last_value')} l JOIN {_one.format('richardson_1')} p USING (curve_id, depth, noise, target_g) JOIN {_one.format('rational_fit')} r USING (curve_id, depth, noise, target_g)
      JOIN (SELECT family, depth, noise, {CASCADE} AS chosen FROM cfeat) c ON c.family = l.family AND c.depth = l.depth AND c.noise = l.noise CROSS JOIN (VALUES {_scr}) t(i, t)),
    q AS (SELECT target_g, screen, iqr_threshold, el AS e_last, CASE WHEN iqr_threshold IS NOT NULL AND q > iqr_threshold THEN el WHEN chosen = 'rational_fit' THEN er ELSE ep END AS error,
      CASE WHEN iqr_threshold IS NOT NULL AND q > iqr_threshold THEN vl WHEN chosen = 'rational_fit' THEN vr ELSE vp END AS valid,
      CASE WHEN iqr_threshold IS NOT NULL AND q > iqr_threshold THEN cl WHEN chosen = 'rational_fit' THEN cr ELSE cp END AS catastrophic FROM w)
    {panel('target_g, screen, iqr_threshold', 'q')}""")

# J
POOL = tuple(m for m in DIAG if m not in ("constant_assumed", "constant_oracle", "window_mean", "window_min", "last_value"))
P_, S_ = f"d.method IN {inlist(POOL)}", f"d.method IN {inlist(DIAG_POOL)}"
_w = "CASE WHEN estimate IS NOT NULL AND perturb_iqr IS NOT NULL THEN 1e0 / (perturb_iqr + 0.01::DOUBLE) END"


def _wm(cond):
    return f"sum(CASE WHEN {cond} THEN w * estimate END) / sum(CASE WHEN {cond} THEN w END)"


def _cap(cond, col):
    had = f"{cond} AND w IS NOT NULL"                  # least() would pass over a NULL weight and take the cap
    return f"sum(CASE WHEN {had} THEN least(w, {col}) * estimate END) / sum(CASE WHEN {had} THEN least(w, {col}) END)"


SAFE = f"(d.method IN {inlist(POOL)} AND NOT bad)"
WKEY = "family, is_holdout, curve_id, depth, noise, target_g, capped"
_trivs = ("constant_assumed", "constant_oracle", "window_mean", "window_min", "last_value")
SELERR = f"""WITH x AS (SELECT method FROM ({EXCLUDED}) WHERE eligible = 1 AND v < 0.9), d0 AS (SELECT d.*, {_w} AS w, d.method IN (SELECT method FROM x) AS bad FROM drec d),
    d AS (SELECT d.*, 5e0 * median(CASE WHEN {P_} THEN w END) OVER k AS cap_p, 5e0 * median(CASE WHEN {SAFE} THEN w END) OVER k AS cap_s FROM d0 d WINDOW k AS (PARTITION BY curve_id, depth, noise, target_g)),
    g AS (SELECT {WKEY}, max(true_val) AS t, max(ref_error) AS ref_error, max(curr_err) AS curr_err, max(error) FILTER (WHERE method = 'last_value') AS e_last,
      min(error) FILTER (WHERE {P_}) AS oracle_pool, min(error) FILTER (WHERE {S_}) AS oracle_small,
      {', '.join(f"median(estimate) FILTER (WHERE {SAFE} AND (perturb_iqr IS NULL OR perturb_iqr <= {t})) AS z_{n}" for n, t in (('threshold_ens_010', 0.1), ('threshold_ens_050', 0.5), ('threshold_ens_safe', 1e9)))},
      median(estimate) FILTER (WHERE {P_}) AS z_equal_pool, median(estimate) FILTER (WHERE {SAFE}) AS z_equal_ensemble_safe, median(estimate) FILTER (WHERE {S_}) AS z_equal_small,
      {_wm(P_)} AS z_diag_pool, {_wm(SAFE)} AS z_diag_ensemble_safe, {_wm(S_)} AS z_diag_small, {_cap(P_, 'cap_p')} AS z_capped_diag_pool, {_cap(SAFE, 'cap_s')} AS z_capped_diag_safe,
      {', '.join(f"max(error) FILTER (WHERE method = '{m}') AS {m}" for m in _trivs)}, max(error) FILTER (WHERE method = 'rational_fit') AS fixed_rational, max(error) FILTER (WHERE method = 'richardson_1') AS fixed_richardson
      FROM d GROUP BY {WKEY}),
    sel AS (SELECT g.* EXCLUDE ({', '.join('z_' + n for n in ('threshold_ens_010', 'threshold_ens_050', 'threshold_ens_safe', 'equal_pool', 'equal_ensemble_safe', 'equal_small', 'diag_pool', 'diag_ensemble_safe', 'diag_small', 'capped_diag_pool', 'capped_diag_safe'))}),
      {', '.join(f'abs(z_{n} - t) AS {n}' for n in ('threshold_ens_010', 'threshold_ens_050', 'threshold_ens_safe', 'equal_pool', 'equal_ensemble_safe', 'equal_small', 'diag_pool', 'diag_ensemble_safe', 'diag_small', 'capped_diag_pool', 'capped_diag_safe'))},
      CASE WHEN {CASCADE} = 'rational_fit' THEN fixed_rational ELSE fixed_richardson END AS phase2_cascade FROM g LEFT JOIN cfeat USING (family, depth, noise))"""
WIN = "curve_id, depth, noise, target_g"
for _n, _c in (("j1_hindsight_oracles", ("oracle_pool", "oracle_small")), ("j2_equal_ensembles", ("equal_pool", "equal_small", "equal_ensemble_safe")), ("j3_diagnostic_ensembles", ("diag_pool", "diag_small", "diag_ensemble_safe")),
               ("j4_capped_weights", ("capped_diag_pool", "capped_diag_safe")), ("j5_threshold_ensembles", ("threshold_ens_010", "threshold_ens_050", "threshold_ens_safe")), ("j6_selector_errors", SELECTORS)):
    tail(_n, "diagfeat", f"{SELERR} SELECT {WIN}, {r_as(_c)} FROM sel")
REFS = (("assumed", "constant_assumed"), ("last", "last_value"), ("wmean", "window_mean"), ("wmin", "window_min"))


def selector_long(src: str, names) -> str:
    vs = ", ".join(f"{_skill('error', f'q_{t}')} AS skill_vs_{t}, CASE WHEN error < q_{t} THEN 1 ELSE 0 END AS win_vs_{t}" for t, _ in REFS)
    return f"""SELECT *, CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END AS valid, CASE WHEN error IS NULL OR (curr_err > 1e-12 AND error > 5 * curr_err) THEN 1 ELSE 0 END AS catastrophic, {_skill('error', 'ref_error')} AS skill, {vs}
        FROM (SELECT *, {', '.join(f'{m} AS q_{t}' for t, m in REFS)} FROM {src}) UNPIVOT INCLUDE NULLS (error FOR selector IN ({', '.join(names)}))"""


def selector_summary(src: str, keys: str, cols=None) -> str:
    inner = f"""SELECT selector, {keys}, {panel_columns()}, median(skill) AS med_skill, {', '.join(f'avg(win_vs_{t}::DOUBLE) AS wr_{t}, median(skill_vs_{t}) AS ms_{t}' for t in TAGS)} FROM ({src}) GROUP BY selector, {keys}"""
    out = {"n_total": "n_total", "n_valid": "n_valid", "valid_rate": rate4("valid_rate"), "cat_rate": rate4("cat_rate"), **{c: R(c) for c in PANEL if c.endswith("_error")},
           "win_rate_vs_last": rate4("win_rate_vs_last"), "med_skill": "round(med_skill, 4)", **{f"med_skill_vs_{t}": f"round(ms_{t}, 4)" for t in TAGS},
           **{f"win_rate_vs_{t}": rate4(f"wr_{t}") for t in TAGS if t != "last"}}
    return f"SELECT selector, {keys}, {', '.join(f'{v} AS {k}' for k, v in out.items() if cols is None or k in cols)} FROM ({inner})"


_sl = selector_long("(SELECT * FROM sel WHERE capped = 0)", SELECTORS)
tail("f14_selector_summary", "diagfeat", f"{SELERR} {selector_summary(_sl, 'is_holdout, target_g')}")
_slice = f"SELECT * FROM (SELECT *, unnest(['noise=' || CASE WHEN noise = 0 THEN '0.0' ELSE '0.005' END, 'family=' || family]) AS slice FROM ({_sl}))"
tail("f15_selector_slices", "diagfeat", f"{SELERR} {selector_summary(_slice, 'slice, target_g', ('n_total', 'n_valid', 'cat_rate', 'med_error', 'med_skill', 'win_rate_vs_last'))}")
tail("j7_ablation", "diagfeat", f"{SELERR} " + " UNION ALL ".join(
    f"SELECT '{lbl}' AS comparison, target_g, {R(f'avg({b} - {a})')} AS mean_improvement, count({b} - {a}) AS n_both_valid, count(*) AS n_total FROM sel WHERE capped = 0 AND is_holdout = 0 GROUP BY target_g HAVING count({b} - {a}) > 0"
    for a, b, lbl in ABLATIONS))
tail("j8_oracle_gap", "diagfeat", f"{SELERR} " + " UNION ALL ".join(
    f"SELECT depth, target_g, '{s}' AS selector, {R(f'avg({s} - oracle_pool)')} AS mean_gap_vs_oracle, count({s} - oracle_pool) AS n_both_valid, count(*) AS n_total FROM sel WHERE capped = 0 AND is_holdout = 0 GROUP BY depth, target_g HAVING count({s} - oracle_pool) > 0"
    for s in GAP_SELECTORS))
tail("j9_method_reliability", "diagfeat", f"""SELECT d.method, {R('avg(perturb_iqr)')} AS mean_piqr, {R('median(perturb_iqr)')} AS med_piqr, {R('avg(error)')} AS mean_err, {R('median(skill)')} AS med_skill, {R('avg(win_vs_last::DOUBLE)')} AS win_rate_vs_last,
    CASE WHEN any_value(x.v) < 0.9 THEN 1 ELSE 0 END AS is_dangerous FROM drec d LEFT JOIN ({EXCLUDED}) x ON x.method = d.method WHERE capped = 0 AND is_holdout = 0 AND target_g = 0.5 AND {P_} GROUP BY d.method""")
_cmpsel = f"""(SELECT curve_id, depth, noise, target_g, max(ref_error) AS ref_error, max(curr_err) AS curr_err, max(error) FILTER (WHERE method = 'last_value') AS e_last, min(error) FILTER (WHERE {S_}) AS oracle, max(error) FILTER (WHERE method = 'rational_fit') AS fixed_rational,
    max(error) FILTER (WHERE method = 'richardson_1') AS fixed_richardson, min(error) FILTER (WHERE method IN ('richardson_1', 'rational_fit')) AS phase2_proxy, abs({_wm(S_)} - max(true_val)) AS diag_ensemble,
    {', '.join(f"max(error) FILTER (WHERE method = '{m}') AS {m}" for _, m in REFS)} FROM (SELECT *, {_w} AS w FROM drec WHERE target_g = 0.5) d GROUP BY curve_id, depth, noise, target_g)"""
tail("j10_selector_comparison", "diag", f"""SELECT * EXCLUDE (target_g) FROM ({selector_summary(selector_long(_cmpsel, ('oracle', 'fixed_rational', 'fixed_richardson', 'phase2_proxy', 'diag_ensemble', *[m for _, m in REFS])), 'target_g', (*PANEL, 'med_skill'))})""")
tail("j11_excluded_set", "cells", f"SELECT method, is_trivial, eligible, {rate4('v')} AS valid_rate, {rate4('c')} AS cat_rate, round(m, 4) AS med_error, n_cells, CASE WHEN eligible = 1 AND v < 0.9 THEN 1 ELSE 0 END AS dangerous FROM ({EXCLUDED})")
tail("j12_verify_excluded", "cells", f"SELECT count(*) AS n_both, 0::BIGINT AS only_left, 0::BIGINT AS only_right, 0::BIGINT AS diff_valid_rate, 0::BIGINT AS diff_n_cells, 0::BIGINT AS diff_dangerous FROM ({EXCLUDED}) WHERE eligible = 1")

# K
tail("k1_shift_iqr", "diag", f"SELECT {REC}, {R('shift_iqr', 5)} AS shift_iqr FROM drec")
tail("k2_perturb_iqr", "diag", f"SELECT {REC}, {R('perturb_iqr', 5)} AS perturb_iqr FROM drec")


def spearman(src: str, keys: str, x: str, y: str, fewest: int, digits: int = 4) -> str:
    def rk(c):
        return f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2e0"
    return f"""SELECT {keys}, {R(f'CASE WHEN count(*) >= {fewest} AND var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END', digits)} AS spearman_r, count(*) AS n
        FROM (SELECT {keys}, {rk(x)} AS a, {rk(y)} AS b FROM ({src}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {keys}"""


_dlong = """SELECT *, unnest(['ALL', method0]) AS method FROM (SELECT depth, method AS method0, round(error, 9) AS error, catastrophic, target_g, diag.d AS diagnostic, diag.v AS dvalue FROM (
    SELECT *, unnest([{'d': 'perturb_iqr', 'v': round(perturb_iqr, 9)}, {'d': 'shift_iqr', 'v': round(shift_iqr, 9)}]) AS diag FROM drec))"""
tail("k3_diagnostic_correlation", "diag", f"SELECT * FROM ({spearman(_dlong, 'method, diagnostic', 'dvalue', 'error', 10)}) WHERE n >= 10")


def integral(f: str, top: str) -> str:
    """Simpson's rule with 1,000 intervals from 0 to ``top``; ``f`` is an expression of {x}."""
    h = f"(({top}) / 1e3)"
    return f"({h} / 3 * list_sum(list_transform(range(0, 1001), lambda i: (CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f.replace('{x}', f'(i * {h})')}))))"


def normal_tails(z: str) -> str:
    return f"greatest(1e0 - sqrt(2e0 / pi()) * {integral('exp(-{x} * {x} / 2)', 'least(' + z + ', 9e0)')}, 0e0)"


def t_tails(t: str, df: str) -> str:
    """Student's t as an integral over the angle atan(t / sqrt(df))."""
    inner = integral(f"pow(cos({{x}}), {df} - 1)", f"least(atan(abs({t}) / sqrt({df})), 12e0 / sqrt({df}), pi() / 2)")
    return f"greatest(1e0 - 2 * exp(lgamma(({df} + 1) / 2e0) - lgamma({df} / 2e0)) / sqrt(pi()) * {inner}, 0e0)"


_k3 = f"SELECT * FROM ({spearman(_dlong, 'method, diagnostic', 'dvalue', 'error', 10, 15)}) WHERE n >= 10"
tail("k11_p_values", "diag", f"""SELECT method, diagnostic, {R('spearman_r')} AS spearman_r, n, {R(f"CASE WHEN abs(spearman_r) >= 1 THEN 0e0 WHEN spearman_r IS NOT NULL THEN {t_tails('tt', 'df')} END")} AS p_value
    FROM (SELECT *, (n - 2)::DOUBLE AS df, CASE WHEN abs(spearman_r) < 1 THEN spearman_r * sqrt((n - 2) / ((1 - spearman_r) * (1 + spearman_r))) END AS tt FROM ({_k3}))""")
_klong = f"""SELECT *, unnest(['ALL', family0]) AS family FROM (SELECT t.family AS family0, target_g, round(R_R_med, 9) AS rr, round(log_med_error_R, 9) AS lg, fx.f AS feature, fx.v AS fv FROM (
    SELECT t.*, unnest([{', '.join(f"{{'f': '{f}', 'v': round({f}, 12)}}" for f in FEATURES)}]) AS fx FROM ({TARGETS}) t LEFT JOIN cfeat USING (family, depth, noise) WHERE capped = 0) t)"""
_kok = f"(SELECT * FROM ({_klong}) WHERE fv IS NOT NULL AND rr IS NOT NULL AND lg IS NOT NULL)"
tail("k4_feature_correlation", "gapfeat", f"""WITH a AS ({spearman(f'SELECT * FROM {_kok}', 'family, target_g, feature', 'fv', 'rr', 5)}), b AS ({spearman(f'SELECT * FROM {_kok}', 'family, target_g, feature', 'fv', 'lg', 5)}),
    c AS (SELECT family, target_g, feature, count(*) AS k FROM ({_klong}) GROUP BY ALL)
    SELECT family, target_g, feature, a.spearman_r AS spearman_vs_RR, b.spearman_r AS spearman_vs_log_err, coalesce(a.n, 0) AS n_cells, k - coalesce(a.n, 0) AS n_dropped FROM c LEFT JOIN a USING (family, target_g, feature) LEFT JOIN b USING (family, target_g, feature)""")
tail("k5_richardson_targets", "gap", f"SELECT {CELL}, capped, n_valid_R, n_total, n_zero_denominator, zero_denominator_cell, {r_as(['R_R_med', 'med_error_R', 'log_med_error_R'])} FROM ({TARGETS})")


_u = "(sum(CASE WHEN f = 1 THEN rk END) - sum(f) * (sum(f) + 1) / 2e0)"
tail("k6_auc", "recorded", f"""WITH k0 AS (SELECT family, CASE WHEN cascade_skill >= 1 THEN 1 ELSE 0 END AS f, round(perturb_iqr, 9) AS q FROM rsum WHERE perturb_iqr IS NOT NULL AND cascade_skill IS NOT NULL),
    k AS (SELECT family, f, count(*) OVER (PARTITION BY family, q) AS same, rank() OVER (PARTITION BY family ORDER BY q) + (count(*) OVER (PARTITION BY family, q) - 1) / 2e0 AS rk FROM k0),
    m AS (SELECT family, sum(f)::DOUBLE AS a, sum(1 - f)::DOUBLE AS b, {_u} AS u, sum(same * same - 1)::DOUBLE AS ties FROM k GROUP BY family),
    z AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) END AS spread FROM m),
    w AS (SELECT *, CASE WHEN spread > 0 THEN greatest((abs(u - a * b / 2) - 0.5) / spread, 0e0) END AS z FROM z)
    SELECT family, a::BIGINT AS n_fail, b::BIGINT AS n_succ, {R('CASE WHEN a > 0 AND b > 0 THEN u / (a * b) END')} AS auc, {R(f'CASE WHEN z IS NOT NULL THEN least({normal_tails("z")}, 1e0) END')} AS p_value FROM w""")
_thr = ", ".join(f"({t!r}::DOUBLE)" for t in REJECT_THRESHOLDS)
tail("k7_rejection_rules", "diag", f"""WITH l AS (SELECT method, error, curr_err, catastrophic, diag.d AS diagnostic, diag.v AS v FROM (SELECT *, unnest([{{'d': 'perturb_iqr', 'v': perturb_iqr}}, {{'d': 'shift_iqr', 'v': shift_iqr}}]) AS diag FROM drec) WHERE diag.v IS NOT NULL),
    a AS (SELECT diagnostic, method, threshold, count(*) FILTER (WHERE v > threshold) AS n_fire, count(*) AS n_total, sum(catastrophic) AS n_bad, count(*) FILTER (WHERE v > threshold AND catastrophic = 1) AS hits,
      avg(curr_err - error) FILTER (WHERE v > threshold) AS saved FROM l CROSS JOIN (VALUES {_thr}) t(threshold) GROUP BY ALL)
    SELECT diagnostic, method, threshold, n_fire, n_total, round(n_fire::DOUBLE / n_total, 3) AS fire_rate, round(hits::DOUBLE / n_fire, 3) AS precision, round(CASE WHEN n_bad > 0 THEN hits::DOUBLE / n_bad END, 3) AS recall, {R('saved', 4)} AS mean_err_saved
    FROM a WHERE n_total >= 10 AND n_fire > 0""")
_dl2 = f"(SELECT * FROM ({_dlong}) WHERE target_g = 0.5 AND method <> 'ALL')"
tail("k8_depth_reliability", "diag", f"""WITH a AS ({spearman(f'SELECT * FROM {_dl2}', 'depth, method, diagnostic', 'dvalue', 'error', 5)}),
    b AS (SELECT depth, method, diagnostic, CASE WHEN count(*) FILTER (WHERE dvalue > 0.05) > 0 THEN count(*) FILTER (WHERE dvalue > 0.05 AND catastrophic = 1)::DOUBLE / count(*) FILTER (WHERE dvalue > 0.05) END AS p FROM {_dl2} GROUP BY ALL)
    SELECT depth, method, diagnostic, spearman_r, n, {R('p', 4)} AS hi_iqr_prec FROM a LEFT JOIN b USING (depth, method, diagnostic) WHERE n >= 5""")
tail("k9_ranking_agreement", "pooled", spearman("SELECT c.target_g, c.accel_rank AS rc, h.accel_rank AS rh FROM pooled c JOIN pooled h ON c.method = h.method AND c.target_g = h.target_g AND c.is_holdout = 0 AND h.is_holdout = 1", "target_g", "rc", "rh", 2, 6))
tail("k10_cluster_bootstrap", "cells", f"""WITH c AS (SELECT target_g, family, max(win_rate_vs_last) FILTER (WHERE method = 'rational_fit') AS win, max(med_error) FILTER (WHERE method = 'rational_fit') AS e, max(med_error) FILTER (WHERE method = 'last_value') AS l
      FROM cells WHERE capped = 0 AND is_holdout = 0 GROUP BY family, depth, noise, target_g), d AS (SELECT target_g, family, win, (e < l)::INTEGER AS lower, round(e - l, 9) AS diff FROM c),
    f AS (SELECT family, row_number() OVER (ORDER BY family) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT family FROM d)),
    s AS (SELECT b, slot, ('0x' || substr(md5(b || '|' || slot), 1, 8))::BIGINT % (SELECT max(k) FROM f) + 1 AS i FROM range(5000) x(b) CROSS JOIN (SELECT unnest(range(1, (SELECT max(k) FROM f) + 1)) AS slot)),
    q AS (SELECT target_g, b, avg(win) AS win_rate, avg(lower::DOUBLE) AS lower_share, median(diff) AS med_diff FROM s JOIN f USING (i) JOIN d USING (family) GROUP BY target_g, b),
    p AS (SELECT target_g, count(*) AS n_cells, avg(win) AS win_rate, avg(lower::DOUBLE) AS lower_share, median(diff) AS med_diff FROM d GROUP BY target_g)
    SELECT target_g, n_cells, {', '.join(f"{R('p.' + m, 5)} AS {m}, {R(f'quantile_cont(q.{m}, 0.025)', 5)} AS {m}_lo, {R(f'quantile_cont(q.{m}, 0.975)', 5)} AS {m}_hi" for m in ('win_rate', 'lower_share', 'med_diff'))}
    FROM p JOIN q USING (target_g) GROUP BY target_g, n_cells, p.win_rate, p.lower_share, p.med_diff""")

# N
_first = lambda c: f"min(a.curve_id || '|' || a.depth || '|' || a.target_g::VARCHAR || '|' || a.method) FILTER (WHERE a.curve_id IS NOT NULL AND b.curve_id IS NOT NULL AND a.{c} IS DISTINCT FROM b.{c})"
tail("n1_keyed_diff", "gap", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_cmp}, count(*) FILTER (WHERE a.curve_id IS NOT NULL AND b.curve_id IS NOT NULL AND a.{c} IS DISTINCT FROM b.{c}) AS n_differ, {_first(c)} AS first_key {_cj}" for c in ("e3", "valid")))
tail("n3_expected_difference", "gap", f"SELECT {_cmp}, {', '.join(f'count(*) FILTER (WHERE a.{c} IS DISTINCT FROM b.{c}) AS diff_{c}' for c in ('e3', 'valid', 'win_vs_last'))} {_cj}")
tail("n4_panel_consistency", "cells", """SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT (q25_error <= med_error AND med_error <= q75_error AND q75_error <= p90_error)) AS quartile_order, count(*) FILTER (WHERE n_valid > n_total) AS valid_above_total,
    count(*) FILTER (WHERE n_valid = 0 AND coalesce(mean_error, med_error) IS NOT NULL) AS stats_without_valid, count(*) FILTER (WHERE valid_rate NOT BETWEEN 0 AND 1 OR cat_rate NOT BETWEEN 0 AND 1 OR win_rate_vs_last NOT BETWEEN 0 AND 1) AS rate_out_of_range,
    count(*) FILTER (WHERE n_valid > 0 AND med_error IS NULL) AS missing_stats FROM cells""")
tail("n5_record_invariants", "gap", """SELECT count(*) AS n_rows, count(*) FILTER (WHERE valid = 0 AND catastrophic = 0) AS invalid_not_catastrophic, count(*) FILTER (WHERE method = 'last_value' AND error IS DISTINCT FROM e_last) AS last_error_differs,
    count(*) FILTER (WHERE valid = 0 AND error IS NOT NULL) AS invalid_with_error, count(*) FILTER (WHERE error < 0 OR isnan(error)) AS bad_error FROM rec""")
tail("n6_inclusion_criteria", "mean", f"""WITH f AS (SELECT curve_id, max(step) AS n_rounds, arg_min(step, {{'v': value, 's': step}}) AS argmin_round, min(value) AS m, arg_min(value, step) AS fv, max(value) FILTER (WHERE step = 90) AS d FROM curve GROUP BY 1),
    g AS (SELECT curve_id, n_rounds, argmin_round, CASE WHEN fv <> m THEN (d - m) / (fv - m) END AS r FROM f)
    SELECT curve_id, n_rounds, argmin_round, {R('r')} AS gap_ratio, CASE WHEN n_rounds >= 500 THEN 'pass' ELSE 'fail' END AS long_enough, CASE WHEN r >= 0.05 THEN 'pass' ELSE 'fail' END AS decay_left, CASE WHEN argmin_round > 90 THEN 'pass' ELSE 'fail' END AS minimum_after,
    CASE WHEN n_rounds >= 500 AND r >= 0.05 AND argmin_round > 90 THEN 1 ELSE 0 END AS included FROM g""")
tail("n7_validity_disagreement", "step", "SELECT method, count(*) AS n FROM srec WHERE valid <> valid_strict GROUP BY method")
