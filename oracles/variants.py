"""CTEs for altered windows: perturbations, shifts, other limits, other lengths."""
from __future__ import annotations

from oracles import prelude as P

DIAG = P.PLAIN_METHODS
DEPTHS = (30, 60, 90)
CONSUMERS = ("richardson_1", "single_exp_fit", "rational_fit", "log_fit", "log_linear", "stability_weighted", "median_ensemble", "constant_assumed")
SWEPT = CONSUMERS + ("last_value", "window_mean", "window_min")
ROUTED = ("richardson_1", "rational_fit", "last_value", "window_mean", "window_min")


def _isolated(ctes: dict[str, str], prefix: str, shared=()) -> dict[str, str]:
    """Rename the CTEs of a chain so two copies can stand side by side."""
    import re
    names = [n for n in ctes if n not in shared]
    out = {}
    for name, sql in ctes.items():
        for n in names:
            sql = re.sub(rf"(?<![\w.'_]){n}(?![\w'(]|\s*\()", f"{prefix}{n}", sql) if n not in ("est", "seq") else re.sub(rf"(?<![\w'_]){n}(?![\w'])", f"{prefix}{n}", sql)
        out[f"{prefix}{name}" if name in names else name] = sql
    return out


def forecast_chain(prefix: str, wins_sql: str, tgt_sql: str, methods, key: str) -> dict[str, str]:
    """Forecast CTEs over another window table.  The variant number rides in the
    ``window_len`` key."""
    base = {"wins": wins_sql, "tgt": tgt_sql, **P.estimate_ctes(methods)}
    return _isolated(base, prefix)


def _summaries(ys="ys"):
    return f"list_min({ys}) AS min_v, list_max({ys}) AS max_v, list_avg({ys}) AS mean_v, {ys}[len({ys})] AS last_v"


def pwins_sql(depths=DEPTHS, source="wins", trials: int = 5, scale: str = "0.02") -> str:
    return f"""SELECT curve_id, family, is_holdout, run, depth, noise, trial AS window_len, trial, assumed_mode, L_true, L_hat, xs, ys, {_summaries()} FROM (
        SELECT * EXCLUDE (ys, window_len, min_v, max_v, mean_v, last_v), list_transform(range(1, len(ys) + 1), lambda i: ys[i] * (1e0 + {scale}::DOUBLE * (2e0 *
          (('0x' || substr(md5(curve_id || '|' || depth || '|' || CAST(round(noise * 1e6) AS BIGINT) || '|' || trial || '|' || xs[i]::INTEGER), 1, 8))::BIGINT)::DOUBLE / 4294967296e0 - 1e0))) AS ys
        FROM {source} CROSS JOIN (SELECT unnest(range(1, {trials + 1}))::INTEGER AS trial) WHERE depth IN ({', '.join(map(str, depths))}))"""


def perturb_ctes(methods=DIAG, depths=DEPTHS) -> dict[str, str]:
    p = forecast_chain("p_", pwins_sql(depths), "SELECT * FROM tgt", methods, "trial")
    p["p_tgt"] = "SELECT * FROM tgt"
    p["p_wins"] = pwins_sql(depths)
    v = f"CASE WHEN {P._valid('estimate_raw')} THEN estimate_raw END"
    p["piqr"] = f"""SELECT curve_id, depth, noise, target_g, n_f, method, CASE WHEN count({v}) >= 2 THEN quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) END AS perturb_iqr
        FROM p_est GROUP BY ALL"""
    return p


def shift_wins(depths) -> str:
    return f"""SELECT curve_id, family, is_holdout, run, depth, noise, s AS window_len, assumed_mode, L_true, L_hat, xs, ys, {_summaries()} FROM (
        SELECT * EXCLUDE (xs, ys, window_len, min_v, max_v, mean_v, last_v), s, xs[1 + s:] AS xs, ys[1 + s:] AS ys FROM wins
        CROSS JOIN (SELECT unnest(range(0, 3))::INTEGER AS s) WHERE depth IN ({', '.join(map(str, depths))}) AND len(ys) - s >= 3)"""


def shift_ctes(methods=DIAG, depths=DEPTHS) -> dict[str, str]:
    p = forecast_chain("s_", "", "", methods, "s")
    p["s_wins"], p["s_tgt"] = shift_wins(depths), "SELECT * FROM tgt"
    v = f"CASE WHEN {P._valid('estimate_raw')} THEN estimate_raw END"
    p["siqr"] = f"""SELECT curve_id, depth, noise, target_g, n_f, method, CASE WHEN count({v}) >= 2 THEN quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) END AS shift_iqr
        FROM (SELECT s_est.* FROM s_est JOIN (VALUES (0), (0), (0), (1), (2)) t(sh) ON s_est.window_len = sh) GROUP BY ALL"""
    return p


DIAG_REC = {"drec": f"""SELECT r.*, p.perturb_iqr, s.shift_iqr FROM rec r
    LEFT JOIN piqr p ON p.curve_id = r.curve_id AND p.depth = r.depth AND p.noise = r.noise AND p.target_g = r.target_g AND p.method = r.method
    LEFT JOIN siqr s ON s.curve_id = r.curve_id AND s.depth = r.depth AND s.noise = r.noise AND s.target_g = r.target_g AND s.method = r.method
    WHERE r.method IN ({', '.join(f"'{m}'" for m in DIAG)})"""}


def recorded_ctes() -> dict[str, str]:
    """rsum: one row per recorded cell with the cascade's choice."""
    from oracles.curves import BEST_REF, CASCADE
    p = forecast_chain("p_", "", "", ("richardson_1", "rational_fit"), "trial")
    p["p_wins"], p["p_tgt"] = pwins_sql((30, 60, 90, 120, 150)), "SELECT * FROM tgt"
    v = f"CASE WHEN {P._valid('estimate_raw')} THEN estimate_raw END"
    p["riqr"] = f"""SELECT curve_id, depth, n_f, method, CASE WHEN count({v}) >= 3 THEN quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) END AS perturb_iqr
        FROM p_est WHERE method IN ('richardson_1', 'rational_fit') GROUP BY ALL"""
    p["rsel"] = f"SELECT curve_id, depth, {CASCADE} AS selected_method FROM feat"
    pick = ", ".join(f"max(CASE WHEN method = selected_method THEN {c} END) AS cascade_{a}" for c, a in (
        ("estimate", "pred"), ("error", "err"), ("skill", "skill"),
        *[(f"{k}_vs_{t}", f"{k}_vs_{t}") for t in ("assumed", "last", "wmean", "wmin") for k in ("skill", "win")]))
    p["rsum0"] = f"""SELECT s.curve_id, s.family, s.depth, s.n_f, selected_method, argmin_round, rise_from_min, post_min_target, max(true_val) AS true_val,
        max(curr_err) AS current_err, max(ref_error) AS ref_error, {BEST_REF} AS ref_best_method, max(CASE WHEN method = 'richardson_1' THEN error END) AS richardson_err,
        max(CASE WHEN method = 'rational_fit' THEN error END) AS rational_err, {pick}
        FROM srec s JOIN rsel ON s.curve_id = rsel.curve_id AND s.depth = rsel.depth GROUP BY ALL"""
    p["rsum"] = """SELECT r.*, CASE WHEN cascade_err IS NOT NULL AND current_err > 1e-10 THEN (current_err - cascade_err) / current_err END AS improvement, q.perturb_iqr
        FROM rsum0 r LEFT JOIN riqr q ON q.curve_id = r.curve_id AND q.depth = r.depth AND q.n_f = r.n_f AND q.method = r.selected_method"""
    return p


def renamed_step() -> dict[str, str]:
    """The recorded study beside the benchmark, under other names."""
    return _isolated({k: v for k, v in P.step_study().items()}, "st_")


def mode_study() -> dict[str, str]:
    modes = ("zero", "half", "oracle", "double", "winmin")
    from oracles.tails import feature_ctes
    return {**P.curve_ctes("se"), **P.horizon_ctes(DEPTHS, (0.7, 0.5, 0.1)),
            **P.window_ctes(DEPTHS, (0.0, 0.005), limit="0.01::DOUBLE", modes=modes), **P.estimate_ctes(SWEPT), **P.record_ctes(), **feature_ctes()}


def length_study() -> dict[str, str]:
    from oracles.tails import feature_ctes
    return {**P.curve_ctes("se"), **P.horizon_ctes(DEPTHS, (0.7, 0.5, 0.1)),
            **P.window_ctes(DEPTHS, (0.0, 0.005), limit="0e0", lens=(20, 40, 60, 80, 100)), **P.estimate_ctes(ROUTED), **P.record_ctes(), **feature_ctes()}


def reaction_ctes() -> dict[str, str]:
    """One perturbation of one percent beside the plain forecasts."""
    p = forecast_chain("p_", "", "", DIAG, "trial")
    p["p_wins"], p["p_tgt"] = pwins_sql(trials=1, scale="0.01"), "SELECT * FROM tgt"
    return p


def last_step_study() -> dict[str, str]:
    """Target = last step of the curve, every depth before it."""
    from oracles.tails import feature_ctes
    depths = (30, 60, 90, 120, 150)
    return {**P.curve_ctes("mean"), "tgt": "SELECT curve_id, d AS depth, max(step) AS n_f, max_by(value, step) AS true_val FROM curve CROSS JOIN (VALUES (30), (60), (90), (120), (150)) t(d) GROUP BY curve_id, d",
            **P.window_ctes(depths), **P.estimate_ctes(ROUTED), **P.record_ctes(), **feature_ctes()}


def renamed_modes() -> dict[str, str]:
    return _isolated({k: v for k, v in mode_study().items() if not k.startswith(("f_", "fw", "fp", "fslope", "feat"))}, "mo_")
