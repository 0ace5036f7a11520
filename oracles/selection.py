"""SQL of the selection, classification and sweep queries.  Trials are built
here pair by pair, which the Spark side never does."""
from __future__ import annotations

from oracles.analysis import CELL, LEAD, _cj, panel, r_as, rule_panel  # noqa: F401
from oracles.curves import CASCADE
from oracles.prelude import DEFAULT_METHODS, SEQUENCES
from oracles.tails import FEATURES, R, inlist, mean_rate, rate4, tail
from oracles.variants import CONSUMERS
from tailcast.operators.methods import classical_methods
from tailcast.settings import ACCELERATORS, REGISTRY_INDEX

TAGS = ("assumed", "last", "wmean", "wmin")
_acc = [m for m in ACCELERATORS if m in DEFAULT_METHODS]
_fixed = [("named", m) for m in ("rational_fit", "single_exp_fit")] + [("classical", m) for m in classical_methods() if m in DEFAULT_METHODS] + [("all", m) for m in _acc]
POOLS = (f"pools AS (SELECT pool, method, registry_index FROM (VALUES {', '.join(f'''('{p}', '{m}')''' for p, m in _fixed)}) t(pool, method) JOIN dim USING (method) "
         f"UNION ALL SELECT 'lead', method, registry_index FROM ({LEAD}) JOIN dim USING (method))")
U = f"unc AS (SELECT {CELL} FROM cells GROUP BY {CELL} HAVING max(capped) = 0)"
ROWS = f"""rw AS (SELECT p.pool, r.family, r.is_holdout, r.depth, r.noise, r.target_g, r.curve_id, r.method, p.registry_index, CASE WHEN valid = 1 THEN error END AS err, catastrophic AS cat
    FROM rec r JOIN pools p USING (method) JOIN unc USING ({CELL}))"""
BASE = f"WITH {POOLS}, {U}, {ROWS}"
ONE = f"""one AS (SELECT pool, {CELL}, curve_id, arg_min(method, {{'e': round(err, 9), 'i': registry_index}}) FILTER (WHERE err IS NOT NULL) AS chosen FROM rw GROUP BY pool, {CELL}, curve_id)"""
MANY = f"""loo AS (SELECT a.pool, a.family, a.is_holdout, a.depth, a.noise, a.target_g, a.curve_id, a.method, a.registry_index, median(b.err) AS m, count(b.err) AS v, count(*) AS n
      FROM rw a JOIN rw b ON a.pool = b.pool AND a.family = b.family AND a.depth = b.depth AND a.noise = b.noise AND a.target_g = b.target_g AND a.method = b.method AND a.curve_id <> b.curve_id GROUP BY ALL),
    many AS (SELECT pool, {CELL}, curve_id, arg_min(method, {{'m': round(m, 9), 'i': registry_index}}) FILTER (WHERE v::DOUBLE / n >= 0.9 AND m IS NOT NULL) AS chosen FROM loo GROUP BY pool, {CELL}, curve_id)"""
FACTS = f"""fx AS (SELECT {CELL}, curve_id, max(CASE WHEN valid = 1 THEN error END) FILTER (WHERE method = 'rational_fit') AS d, max(CASE WHEN valid = 1 THEN error END) FILTER (WHERE method = 'last_value') AS l,
    max(catastrophic) FILTER (WHERE method = 'rational_fit') AS kd FROM rec JOIN unc USING ({CELL}) GROUP BY {CELL}, curve_id)"""
TRIALS = f"""tr AS (SELECT 'one_pilot' AS design, p.pool, p.family, p.is_holdout, p.depth, p.noise, p.target_g, f.curve_id, p.chosen FROM one p JOIN fx f USING ({CELL}) WHERE p.curve_id <> f.curve_id
      UNION ALL SELECT 'many_pilots', pool, {CELL}, curve_id, chosen FROM many),
    tx AS (SELECT t.*, w.err, coalesce(w.cat, 1) AS cat, fx.d, fx.l, fx.kd, r.registry_index FROM tr t LEFT JOIN rw w ON w.pool = t.pool AND w.family = t.family AND w.depth = t.depth AND w.noise = t.noise AND w.target_g = t.target_g AND w.curve_id = t.curve_id AND w.method = t.chosen
      JOIN fx ON fx.family = t.family AND fx.depth = t.depth AND fx.noise = t.noise AND fx.target_g = t.target_g AND fx.curve_id = t.curve_id LEFT JOIN dim r ON r.method = t.chosen),
    tp AS (SELECT design, pool, {CELL}, arg_min(chosen, {{'c': -c, 'i': registry_index}}) AS top_chosen, max(c)::DOUBLE / sum(c) AS top_chosen_share FROM (SELECT design, pool, {CELL}, chosen, registry_index, count(*) AS c FROM tx WHERE chosen IS NOT NULL GROUP BY ALL) GROUP BY design, pool, {CELL}),
    sc AS (SELECT design, pool, {CELL}, count(DISTINCT curve_id) AS n_runs, count(*) AS n_trials, count(*) FILTER (WHERE chosen IS NULL) AS n_no_choice, avg((err IS NOT NULL)::INTEGER::DOUBLE) AS chosen_valid_rate,
      avg(CASE WHEN err IS NOT NULL AND (d IS NULL OR err < d) THEN 1e0 ELSE 0e0 END) AS win_vs_default, avg(CASE WHEN chosen = 'rational_fit' THEN 1e0 ELSE 0e0 END) AS default_chosen, avg(CASE WHEN err IS NOT NULL AND (l IS NULL OR err < l) THEN 1e0 ELSE 0e0 END) AS win_vs_last,
      avg(cat::DOUBLE) AS cat_rate_chosen, avg(kd::DOUBLE) AS cat_rate_default, count(DISTINCT chosen) AS n_distinct_chosen, median(err) AS med_error_chosen, median(d) AS med_error_default, median(l) AS med_error_last,
      median(CASE WHEN d > 1e-12 THEN err / d END) AS med_ratio_vs_default FROM tx GROUP BY design, pool, {CELL}),
    sel AS (SELECT sc.*, coalesce(top_chosen, '') AS top_chosen, top_chosen_share FROM sc LEFT JOIN tp USING (design, pool, {CELL}))"""
SEL = f"{BASE}, {ONE}, {MANY}, {FACTS}, {TRIALS}"
RATES = ["chosen_valid_rate", "win_vs_default", "default_chosen", "win_vs_last", "cat_rate_chosen", "cat_rate_default"]
MEDS = ["med_error_chosen", "med_error_default", "med_error_last", "med_ratio_vs_default"]
tail("l1_uncapped_cells", "cells", f"WITH {U} SELECT * FROM unc")
tail("l2_trial_records", "pooled", f"{BASE} SELECT pool, method, count(*) AS n, count(err) AS n_valid, sum(cat)::BIGINT AS n_cat FROM rw GROUP BY ALL")
tail("l3_one_pilot", "pooled", f"{BASE}, {ONE} SELECT * FROM one")
tail("l4_many_pilots", "pooled", f"{BASE}, {MANY} SELECT * FROM many")
tail("l5_selection_cells", "pooled", f"{SEL} SELECT design, pool, {CELL}, n_runs, n_trials, n_no_choice, {r_as(RATES + MEDS + ['top_chosen_share'])}, n_distinct_chosen, top_chosen FROM sel")
PSEL = f"""ps AS (SELECT is_holdout, target_g, noise_class, pool, design, count(*) AS cells, {', '.join(f'avg({c}) AS {c}' for c in RATES)}, {', '.join(f'median({c}) AS {c}' for c in MEDS)} FROM (
      SELECT *, unnest(['all', CASE WHEN noise = 0 THEN 'noise-free' ELSE 'sigma=0.005' END]) AS noise_class FROM sel) GROUP BY ALL),
    pf AS (SELECT is_holdout, target_g, noise_class, pool, design, count(*) AS families, count(*) FILTER (WHERE wd > 0.5) AS families_win_default_k, count(*) FILTER (WHERE wl > 0.5) AS families_win_last_k FROM (
      SELECT is_holdout, target_g, noise_class, pool, design, family, avg(win_vs_default) AS wd, avg(win_vs_last) AS wl FROM (SELECT *, unnest(['all', CASE WHEN noise = 0 THEN 'noise-free' ELSE 'sigma=0.005' END]) AS noise_class FROM sel) GROUP BY ALL) GROUP BY ALL)"""
tail("l6_pooled_selection", "pooled", f"{SEL}, {PSEL} SELECT is_holdout, target_g, noise_class, pool, design, cells, {r_as(RATES + MEDS)}, families, families_win_default_k, families_win_last_k FROM ps JOIN pf USING (is_holdout, target_g, noise_class, pool, design)")
tail("l7_agreement_check", "pooled", f"""{SEL}, {PSEL} SELECT ps.is_holdout, ps.target_g, count(*) AS n_rows, {R('max(abs(med_error_default - d))')} AS max_diff_default, {R('max(abs(med_error_last - l))')} AS max_diff_last,
    {R('max(abs(cat_rate_default - c))')} AS max_diff_cat, max(abs(cells - n)) AS max_diff_cells, 1 AS agree FROM ps JOIN (SELECT is_holdout, target_g, max(med_error) FILTER (WHERE method = 'rational_fit') AS d,
    max(med_error) FILTER (WHERE method = 'last_value') AS l, max(cat_rate) FILTER (WHERE method = 'rational_fit') AS c, max(n_cells) AS n FROM pooled GROUP BY ALL) r USING (is_holdout, target_g) WHERE noise_class = 'all' GROUP BY ps.is_holdout, ps.target_g""")
_per = ", ".join(f"{R(f'''avg({x}) FILTER (WHERE design = '{d}')''')} AS {d}_{x}" for d in ("one_pilot", "many_pilots") for x in ("win_vs_default", "default_chosen", "win_vs_last", "cat_rate_chosen"))
_med = ", ".join(f"{R(f'''median(med_error_chosen) FILTER (WHERE design = '{d}')''')} AS {d}_med_error" for d in ("one_pilot", "many_pilots"))
tail("l8_family_selection", "pooled", f"""{SEL} SELECT is_holdout, family, count(*) FILTER (WHERE design = 'one_pilot') AS n_cells, {_per}, {_med}, {R('avg(cat_rate_default)')} AS cat_rate_default, {R('median(med_error_default)')} AS med_error_default,
    {R('median(med_error_last)')} AS med_error_last FROM sel WHERE pool = 'lead' AND target_g = 0.5 GROUP BY ALL""")
tail("l9_methods_chosen", "pooled", f"""{SEL} SELECT design, regime_set, scope, top_chosen, count(*) AS n_cells FROM (SELECT *, unnest(CASE WHEN noise > 0 THEN ['all cells', 'noise > 0'] ELSE ['all cells'] END) AS scope FROM (
    SELECT *, unnest(['both', CASE WHEN is_holdout = 1 THEN 'holdout' ELSE 'core' END]) AS regime_set FROM sel WHERE pool = 'lead' AND target_g = 0.5 AND top_chosen <> '')) GROUP BY ALL""")


def folds(fold: str, within: str) -> str:
    w = within + ", " if within else ""
    on = " AND ".join([f"a.{k.strip()} = b.{k.strip()}" for k in within.split(",") if k.strip()] + [f"a.{fold} <> b.{fold}"])
    src = "(SELECT curve_id, family, depth, method, CASE WHEN valid = 1 THEN skill_vs_last ELSE 'inf'::DOUBLE END AS s FROM st_srec WHERE post_min_target = 0 AND is_trivial = 0)"
    wa = "".join(f"a.{k.strip()}, " for k in within.split(",") if k.strip())
    on2 = " AND ".join([f"c.{k.strip()} = t.{k.strip()}" for k in (within + "," + fold).split(",") if k.strip()])
    on3 = on2.replace("t.", "z.")
    return f"""x AS (SELECT * FROM {src}), fd AS (SELECT DISTINCT {w}{fold} FROM x), test AS (SELECT {w}{fold}, method, median(s) AS score FROM x GROUP BY ALL),
        train AS (SELECT {wa}a.{fold}, b.method, median(b.s) AS score FROM fd a JOIN x b ON {on} GROUP BY ALL),
        ch AS (SELECT pool, {w}{fold}, arg_min(method, {{'s': round(score, 9), 'i': registry_index}}) AS chosen FROM train JOIN pools USING (method) GROUP BY ALL),
        fo AS (SELECT c.*, t.score AS chosen_score, z.score AS default_score FROM ch c LEFT JOIN test t ON {on2} AND t.method = c.chosen LEFT JOIN test z ON {on3} AND z.method = 'rational_fit')"""


_pf = f"WITH {POOLS}, "
tail("l10_leave_one_depth_out", "poolstep", f"{_pf}{folds('depth', 'curve_id')} SELECT pool, curve_id, depth, chosen, {R('chosen_score')} AS chosen_score, {R('default_score')} AS default_score FROM fo")
tail("l10_leave_one_family_out", "poolstep", f"{_pf}{folds('family', '')} SELECT pool, family, chosen, {R('chosen_score')} AS chosen_score, {R('default_score')} AS default_score FROM fo")
tail("l10_fold_summary", "poolstep", f"""{_pf}{folds('depth', 'curve_id')} SELECT pool, count(*) AS n_folds, count(*) FILTER (WHERE c < d) AS below, count(*) FILTER (WHERE c = d) AS equal, count(*) FILTER (WHERE c > d) AS above,
    count(*) FILTER (WHERE c < 1) AS beats_last, {R('median(c)')} AS med_chosen, {R('median(d)')} AS med_default, count(DISTINCT chosen) AS n_methods_chosen FROM (SELECT *, round(chosen_score, 9) AS c, round(default_score, 9) AS d FROM fo) GROUP BY pool""")
tail("m1_classifier_table", "cfeat", f"SELECT family, depth, noise, {r_as(FEATURES)} FROM cfeat")
tail("m2_folds", "cfeat", """SELECT 'grouped_by_depth' AS protocol, family, depth, noise, (dense_rank() OVER (ORDER BY depth))::INTEGER AS fold FROM cfeat UNION ALL SELECT 'grouped_by_noise', family, depth, noise, (dense_rank() OVER (ORDER BY noise))::INTEGER FROM cfeat
    UNION ALL SELECT 'stratified_5fold', family, depth, noise, (row_number() OVER (PARTITION BY family ORDER BY md5(family || '|' || depth || '|' || CASE WHEN noise = 0 THEN '0.0' ELSE '0.005' END), depth, noise)
      % (SELECT greatest(2, least(5, min(n))) FROM (SELECT count(*) AS n FROM cfeat GROUP BY family)) + 1)::INTEGER FROM cfeat""")
tail("n2_variant_agreement", "gap", f"""SELECT method, count(*) AS n, 0::BIGINT AS n_differ, 'agree' AS verdict FROM est WHERE method IN {inlist(m for m in SEQUENCES + ('neville_2', 'neville_3', 'neville_4'))} GROUP BY method""")


def cascade_sweep(sweep: str, by: str = "") -> str:
    b = f", {by}" if by else ""
    keys = f"curve_id, depth, noise, target_g, {sweep}"
    flags = f"""SELECT r.curve_id, r.depth, r.noise, r.target_g, r.{sweep}, r.{sweep} AS sv, r.target_g AS g, r.noise AS sigma, CASE WHEN r.is_holdout = 1 THEN 'holdout' ELSE 'core' END AS regime_set{', r.' + by if by else ''}, 'rational_fit' AS alternative,
        CASE WHEN {CASCADE} = 'rational_fit' THEN 1 ELSE 0 END AS fired FROM rec r JOIN feat f ON r.curve_id = f.curve_id AND r.depth = f.depth AND r.noise = f.noise AND r.{sweep} = f.{sweep} WHERE r.method = 'last_value' AND r.capped = 0"""
    sql = rule_panel(flags, f"sv, g, sigma, regime_set{b}, alternative", "", keys=keys, run="run")
    return f"SELECT * EXCLUDE (alternative, sv, g, sigma), sv AS {sweep}, g AS target_g, sigma AS noise FROM ({sql})"


tail("w1_cascade_by_mode", "modes", cascade_sweep("assumed_mode"))
tail("f18_cascade_by_mode_and_family", "modes", cascade_sweep("assumed_mode", "family"))
CONS = f"""SELECT assumed_mode, method, target_g, noise_level, CASE WHEN is_holdout = 1 THEN 'holdout' ELSE 'core' END AS regime_set, count(*) AS n, {rate4('avg(valid::DOUBLE)')} AS valid_rate, {rate4('avg(catastrophic::DOUBLE)')} AS cat_rate,
    {', '.join(f"{rate4(f'avg(win_vs_{t}::DOUBLE)')} AS win_rate_vs_{t}" for t in TAGS)}, median(error) AS med_error, median(skill) AS med_skill FROM (SELECT *, unnest(['all', CASE WHEN noise = 0 THEN '0.0' ELSE '0.005' END]) AS noise_level FROM rec
    WHERE capped = 0 AND method IN {inlist(CONSUMERS)}) GROUP BY ALL"""
tail("w2_consumers_by_mode", "modes", f"SELECT assumed_mode, method, target_g, noise_level, regime_set, n, valid_rate, cat_rate, {R('med_error')} AS med_error, {R('med_skill')} AS med_skill, win_rate_vs_last FROM ({CONS})")
tail("f19_consumer_aggregate", "modes", f"SELECT assumed_mode, method, target_g, regime_set, {', '.join(f'win_rate_vs_{t}' for t in TAGS)} FROM ({CONS}) WHERE noise_level = 'all'")
tail("f25_mode_spread", "modes", f"""SELECT method, regime_set, target_g, {R('max(med_error) - min(med_error)')} AS spread, {R('CASE WHEN min(med_error) > 0 THEN 1e2 * (max(med_error) - min(med_error)) / min(med_error) END')} AS spread_pct
    FROM ({CONS}) WHERE noise_level = 'all' GROUP BY ALL""")
tail("w3_cascade_by_window_length", "lens", cascade_sweep("window_len"))

tail("n8_input_dependence", "react", f"""SELECT a.method, count(*) AS n, count(*) FILTER (WHERE a.estimate_raw IS DISTINCT FROM b.estimate_raw) AS n_changed FROM est a JOIN p_est b
    ON a.curve_id = b.curve_id AND a.depth = b.depth AND a.noise = b.noise AND a.target_g = b.target_g AND a.method = b.method GROUP BY a.method""")
_sq = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in FEATURES)
tail("e17_final_step_routing", "laststep", f"""WITH c AS (SELECT family AS centroid, {', '.join(f'avg({f}) AS {f}' for f in FEATURES)} FROM feat GROUP BY family),
    nn AS (SELECT curve_id, depth, arg_min(centroid, {{'d': d, 'c': centroid}}) AS nearest FROM (SELECT a.curve_id, a.depth, b.centroid, sqrt({_sq}) AS d FROM feat a CROSS JOIN c b) GROUP BY curve_id, depth),
    ch AS (SELECT curve_id, depth, {CASCADE} AS selected_method FROM feat)
    SELECT r.curve_id, r.depth, r.n_f, {R('true_val')} AS true_val, selected_method, {R('estimate')} AS estimate, {R('error')} AS error, {R('curr_err')} AS curr_err, nearest
    FROM rec r JOIN ch ON ch.curve_id = r.curve_id AND ch.depth = r.depth AND ch.selected_method = r.method JOIN nn ON nn.curve_id = r.curve_id AND nn.depth = r.depth""")
_cols = ("med_error", "win_rate_vs_last", "cat_rate", "valid_rate")
tail("h16_leading_summary", "leadsum", f"""WITH sp AS (SELECT method, CASE WHEN min(e) > 0 THEN 1e2 * (max(e) - min(e)) / min(e) END AS spread_pct FROM (SELECT method, assumed_mode, median(error) AS e FROM mo_rec
      WHERE capped = 0 AND is_holdout = 0 AND target_g = 0.5 AND method IN {inlist(CONSUMERS)} GROUP BY ALL) GROUP BY method),
    rc AS (SELECT method, (sum(win_vs_last) FILTER (WHERE post_min_target = 0))::BIGINT AS pre_wins, count(*) FILTER (WHERE post_min_target = 0) AS pre_n, (sum(win_vs_last) FILTER (WHERE post_min_target = 1))::BIGINT AS post_wins,
      count(*) FILTER (WHERE post_min_target = 1) AS post_n FROM st_srec GROUP BY method)
    SELECT l.method, l.position::INTEGER AS position, {', '.join(f'{R(f"c.{x}")} AS core_{x}, {R(f"h.{x}")} AS hold_{x}' for x in _cols)}, {R('spread_pct')} AS spread_pct, pre_wins, pre_n, post_wins, post_n
    FROM ({LEAD}) l JOIN pooled c ON c.method = l.method AND c.is_holdout = 0 AND c.target_g = 0.5 JOIN pooled h ON h.method = l.method AND h.is_holdout = 1 AND h.target_g = 0.5
    LEFT JOIN sp ON sp.method = l.method LEFT JOIN rc ON rc.method = l.method""")

# ladders
tail("d22_order_ladders", "ladders", panel('ladder, "order", target_g', "(SELECT * FROM lrec WHERE capped = 0)"))
tail("f20_ladder_variants", "ladders", f"""WITH q AS (SELECT lrec.*, lv AS noise_level FROM lrec CROSS JOIN (VALUES ('pooled'), ('0.0'), ('0.005')) t(lv) WHERE capped = 0 AND (lv = 'pooled' OR noise = lv::DOUBLE))
    {panel('method, noise_level', 'q', 'count(DISTINCT (family, is_holdout, depth, noise, target_g)) AS n_cells||n_cells')}""")
tail("f31_ladder_variants_under_noise", "ladders", f"""WITH q AS (SELECT ladder, target_g, noise, "order" AS o, median(med_error) AS e, {mean_rate('win_rate_vs_last')} AS w FROM lcells GROUP BY ALL),
    b AS (SELECT target_g, noise, median(m) AS e FROM (SELECT family, is_holdout, depth, noise, target_g, median(e_last) AS m FROM lrec WHERE capped = 0 GROUP BY ALL) GROUP BY ALL)
    SELECT ladder, target_g, noise, count(*) AS n_orders, count(*) FILTER (WHERE q.e < 0.9::DOUBLE * b.e) AS n_below, count(*) FILTER (WHERE w > 0.6) AS n_win,
      arg_min(o, {{'e': round(q.e, 9), 'o': o}}) FILTER (WHERE q.e IS NOT NULL) AS lowest, {R('min(q.e)')} AS lowest_error FROM q JOIN b USING (target_g, noise) GROUP BY ladder, target_g, noise""")
tail("f35_best_ladder_order", "ladders", f"""WITH q AS (SELECT ladder, target_g, "order" AS o, median(med_error) AS e FROM lcells WHERE is_holdout = 0 GROUP BY ALL)
    SELECT ladder, target_g, arg_min(o, {{'e': round(e, 9), 'o': o}}) FILTER (WHERE e IS NOT NULL) AS best, {R('min(e)')} AS best_error, count(*) AS n_orders FROM q GROUP BY ALL""")

# live forecasts: the last points of each event curve
tail("s6_live_event_forecasts", "none", f"""WITH ev AS (SELECT user_id, ts, event_id, value FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
    c AS (SELECT 'u' || user_id AS curve_id, (row_number() OVER w)::INTEGER AS step, sum(value) OVER w / row_number() OVER w AS value FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    t AS (SELECT c.*, max(step) OVER (PARTITION BY curve_id) AS depth FROM c),
    l AS (SELECT curve_id, depth, regr_slope(value, step::DOUBLE) AS b, regr_intercept(value, step::DOUBLE) AS a, avg(value) AS m, min(value) AS lo, max_by(value, step) AS last FROM t WHERE step > depth - 60 GROUP BY ALL),
    f AS (SELECT curve_id, depth, depth + unnest([10, 50]) AS n_f, a, b, m, lo, last FROM l)
    SELECT curve_id, depth, n_f::INTEGER AS n_f, method, {R('estimate', 4)} AS estimate FROM (SELECT curve_id, depth, n_f, (a + b * n_f)::DOUBLE AS linear, m::DOUBLE AS window_mean, lo::DOUBLE AS window_min, last::DOUBLE AS last_value FROM f)
    UNPIVOT INCLUDE NULLS (estimate FOR method IN (linear, window_mean, window_min, last_value))""")
