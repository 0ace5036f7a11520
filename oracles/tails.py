"""SQL of every query that SQL can express: name -> (CTE group, final SELECT)."""
from __future__ import annotations

from oracles import prelude as P

TAILS: dict[str, tuple[str, str]] = {}


def R(expr: str, digits: int = 6) -> str:
    """Rounded double; adding zero turns -0 into 0."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0e0)"


def rate4(expr: str) -> str:
    return f"(floor(({expr}) * 1e4 + 0.5::DOUBLE) / 1e4)"


def mean_rate(col: str, flt: str = "") -> str:
    f = f" FILTER (WHERE {flt})" if flt else ""
    return f"(sum(round({col} * 1e4)::BIGINT){f}::DOUBLE / (count({col}){f} * 1e4))"


def tail(name: str, group: str, sql: str) -> None:
    TAILS[name] = (group, sql)


REC = "curve_id, depth, noise, target_g, method"
DIAG = P.PLAIN_METHODS
DIAG_POOL = ("last_value", "richardson_1", "richardson_a10", "single_exp_fit", "rational_fit", "pade_22", "log_linear", "levin_t2", "anderson_1")
TAGS = ("assumed", "last", "wmean", "wmin")
FEATURES = ("log_log_slope", "curvature_idx", "oscillation_idx", "noise_var", "richardson_r2", "diff_ratio_cv")


def inlist(items) -> str:
    return "(" + ", ".join(f"'{i}'" if isinstance(i, str) else str(i) for i in items) + ")"


# ---- shared CTEs on top of the prelude ------------------------------------------
def panel_columns(err="error", valid="valid", cat="catastrophic", last="e_last") -> str:
    e = f"CASE WHEN {valid} = 1 THEN {err} END"
    return (f"count(*) AS n_total, count(CASE WHEN {valid} = 1 THEN 1 END) AS n_valid, "
            f"count(CASE WHEN {valid} = 1 THEN 1 END)::DOUBLE / count(*) AS valid_rate, avg({cat}::DOUBLE) AS cat_rate, "
            f"avg({e}) AS mean_error, stddev_samp({e}) AS sd_error, quantile_cont({e}, 0.5) AS med_error, "
            f"quantile_cont({e}, 0.25) AS q25_error, quantile_cont({e}, 0.75) AS q75_error, quantile_cont({e}, 0.9) AS p90_error, "
            f"avg(CASE WHEN {valid} = 1 AND {err} < {last} THEN 1e0 ELSE 0e0 END) AS win_rate_vs_last")


PANEL = ("n_total", "n_valid", "valid_rate", "cat_rate", "mean_error", "sd_error", "med_error", "q25_error", "q75_error",
         "p90_error", "win_rate_vs_last")


def panel_out(prefix="") -> str:
    return ", ".join(f"{prefix}{c}" if c.startswith("n_") else f"{R(prefix + c)} AS {prefix}{c}" for c in PANEL)


CELLS = {
    "cells_raw": f"""SELECT method, family, is_holdout, depth, noise, target_g, {panel_columns()}, max(capped) AS capped,
        median(n_f) AS n_f, median(achieved_g) AS achieved_g, median(L_hat) AS L_hat, median(improve_ratio) AS med_improve,
        median(skill) AS med_skill_, {', '.join(f'median(skill_vs_{t}) AS ms_{t}, avg(win_vs_{t}::DOUBLE) AS wr_{t}' for t in TAGS)},
        max(method_family) AS method_family, max(method_type) AS method_type, max(is_trivial) AS is_trivial, max(is_oracle) AS is_oracle
        FROM rec GROUP BY method, family, is_holdout, depth, noise, target_g""",
    "cells": f"""SELECT * EXCLUDE (valid_rate, cat_rate, win_rate_vs_last, med_skill_), {rate4('valid_rate')} AS valid_rate, {rate4('cat_rate')} AS cat_rate,
        med_skill_ AS med_skill, {', '.join(f'round(ms_{t}, 4) AS med_skill_vs_{t}, {rate4(f"wr_{t}")} AS win_rate_vs_{t}' for t in TAGS)}
        FROM cells_raw""",
}

POOLED = {
    "pooled0": f"""SELECT is_holdout, method, target_g, max(method_family) AS method_family, max(method_type) AS method_type,
        max(is_trivial) AS is_trivial, max(is_oracle) AS is_oracle,
        {rate4(mean_rate('valid_rate', 'capped = 0'))} AS valid_rate, {rate4(mean_rate('cat_rate', 'capped = 0'))} AS cat_rate,
        median(med_error) FILTER (WHERE capped = 0) AS med_error, median(med_improve) FILTER (WHERE capped = 0) AS med_improve,
        median(med_skill) FILTER (WHERE capped = 0) AS med_skill,
        {', '.join(f'median(med_skill_vs_{t}) FILTER (WHERE capped = 0) AS med_skill_vs_{t}' for t in TAGS)},
        {', '.join(f"{rate4(mean_rate(f'win_rate_vs_{t}', 'capped = 0'))} AS win_rate_vs_{t}" for t in TAGS)},
        count(DISTINCT family) FILTER (WHERE capped = 0) AS n_families, count(*) FILTER (WHERE capped = 0) AS n_cells,
        count(*) FILTER (WHERE capped = 1) AS n_capped_excluded FROM cells GROUP BY is_holdout, method, target_g""",
    "pooled1": """SELECT *, CASE WHEN is_oracle = 0 AND med_error IS NOT NULL AND isfinite(med_error) AND valid_rate >= 0.9 THEN 1 ELSE 0 END AS rank_eligible FROM pooled0""",
    "pooled": """SELECT *, CASE WHEN is_holdout = 1 THEN 'holdout' ELSE 'core' END AS regime_set,
        CASE WHEN rank_eligible = 1 THEN row_number() OVER (PARTITION BY is_holdout, target_g, rank_eligible ORDER BY round(med_error, 9), method) END AS rank,
        CASE WHEN rank_eligible = 1 AND is_trivial = 0 THEN row_number() OVER (PARTITION BY is_holdout, target_g, rank_eligible, is_trivial ORDER BY round(med_error, 9), method) END AS accel_rank
        FROM pooled1""",
}


LADDER_CELLS = f"""SELECT ladder, "order", method, family, is_holdout, depth, noise, target_g, median(CASE WHEN valid = 1 THEN error END) AS med_error,
    {rate4('avg(CASE WHEN valid = 1 AND error < e_last THEN 1e0 ELSE 0e0 END)')} AS win_rate_vs_last FROM lrec WHERE capped = 0 GROUP BY ALL"""


def feature_ctes(wins="wins", name="feat") -> dict[str, str]:
    """Window features, power-law fit with a fixed limit included."""
    k = P.KEYS
    out = {
        "fw": f"SELECT *, CASE WHEN min_v <= 0 THEN 0e0 ELSE greatest(0e0, least(L_hat, 0.5::DOUBLE * min_v)) END AS L0 FROM {wins}",
        "fp": f"SELECT {k}, L0, unnest(xs) AS x, unnest(ys) AS y FROM fw",
        "fslope": f"""SELECT {k}, CASE WHEN count(*) FILTER (WHERE y > L0) >= 3 THEN regr_slope(CASE WHEN y > L0 THEN ln(y - L0) END, ln(greatest(x, 1e0))) END AS log_log_slope,
            regr_syy(y, y) AS sst FROM fp GROUP BY {k}""",
    }
    src = f"(SELECT DISTINCT {k}, 0.05::DOUBLE AS lo, 4e0 AS hi FROM fp)"
    for i in range(4):
        out[f"f_{i}"] = f"""SELECT {k}, min(sse) AS sse, any_value(lo) * pow(any_value(hi) / any_value(lo), greatest(arg_min(kk, {{'s': sse, 'k': kk}}) - 1, 0) / 31e0) AS lo,
              any_value(lo) * pow(any_value(hi) / any_value(lo), least(arg_min(kk, {{'s': sse, 'k': kk}}) + 1, 31) / 31e0) AS hi
            FROM (SELECT {k}, kk, lo, hi, see - 2 * a * spe + a * a * spp AS sse FROM (
              SELECT {k}, kk, any_value(lo) AS lo, any_value(hi) AS hi, sum(phi * phi) AS spp, sum(phi * e) AS spe, sum(e * e) AS see,
                least(greatest(sum(phi * e) / sum(phi * phi), 0e0), 5e0) AS a
              FROM (SELECT {k}, kk, lo, hi, y - L0 AS e, pow(greatest(x, 1e0), -(s.lo * pow(s.hi / s.lo, kk / 31e0))) AS phi
                FROM fp JOIN {src} s USING ({k}) CROSS JOIN range(32) g(kk)) GROUP BY {k}, kk))
            GROUP BY {k}"""
        src = f"f_{i}"
    d2 = "list_transform(range(1, len(ys) - 1), lambda i: (ys[i+2] - ys[i+1]) - (ys[i+1] - ys[i]))"
    rt = "list_transform(range(1, len(ys)), lambda i: ys[i+1] / greatest(abs(ys[i]), 1e-15))"
    out[name] = f"""SELECT fw.curve_id, fw.family, fw.is_holdout, fw.run, fw.depth, fw.noise, fw.window_len, fw.assumed_mode, L_hat, log_log_slope,
        CASE WHEN len(ys) >= 3 THEN list_avg(list_transform({d2}, lambda v: abs(v))) / (max_v - min_v + 1e-15) END AS curvature_idx,
        CASE WHEN len(ys) >= 3 THEN list_sum(list_transform(range(1, len(ys) - 1), lambda i: CASE WHEN (ys[i+1] - ys[i]) * (ys[i+2] - ys[i+1]) < 0 THEN 1e0 ELSE 0e0 END)) / greatest(len(ys) - 2, 1) END AS oscillation_idx,
        CASE WHEN len(ys) >= 4 THEN list_var_pop({d2}) END AS noise_var,
        least(greatest(1e0 - f_3.sse / (sst + 1e-20), -1e1), 1e0) AS richardson_r2,
        CASE WHEN len(ys) >= 4 THEN list_stddev_pop({rt}) / (abs(list_avg({rt})) + 1e-15) END AS diff_ratio_cv
        FROM fw JOIN fslope USING ({k}) JOIN f_3 USING ({k})"""
    return out


CELLFEAT = {"cfeat": "SELECT family, depth, noise, " + ", ".join(f"avg({f}) AS {f}" for f in FEATURES) + " FROM feat GROUP BY family, depth, noise"}


def groups() -> dict[str, dict[str, str]]:
    """CTE groups the tails refer to."""
    gap = P.gap_study()
    step = P.step_study()
    gap_windows = {**P.curve_ctes("se"), **P.horizon_ctes((30, 60, 90), (0.7, 0.5, 0.1)), **P.window_ctes((30, 60, 90), (0.0, 0.005), limit="0e0")}
    step_windows = {**P.curve_ctes("mean"), **P.step_target_ctes((30, 60, 90, 120, 150), (200, 300, 400)), **P.window_ctes((30, 60, 90, 120, 150)), **P.minima_cte()}
    from oracles import orders as O
    from oracles import variants as V
    return {
        "flag": {**P.curve_ctes("se"), **P.step_target_ctes((30, 60, 90, 120, 150), (200, 300, 400)), **P.window_ctes((30, 60, 90, 120, 150), limit="0e0"),
                 **P.estimate_ctes(("linear", "log_linear", "constant_assumed", "constant_oracle", "window_mean", "window_min", "last_value"), grid=False), **P.record_ctes()},
        "none": {}, "se": P.curve_ctes("se"), "mean": {**P.curve_ctes("mean"), **P.minima_cte()},
        "semin": {**P.curve_ctes("se"), **P.minima_cte()},
        "hz": {**P.curve_ctes("se"), **P.horizon_ctes((30, 60, 90), (0.7, 0.5, 0.1))},
        "bfive": {**P.curve_ctes("se"), **P.window_ctes((30, 60, 90, 120, 150), limit="0.01::DOUBLE", modes=("zero", "half", "oracle", "double", "winmin"))},
        "pert": {**gap_windows, "pwins": V.pwins_sql()},
        "gapwin": gap_windows, "stepwin": step_windows,
        "orders": {**gap_windows, **O.order_ctes()}, "ladders": {**gap_windows, **O.ladder_ctes(), "lcells": LADDER_CELLS},
        "steppade": {**step_windows, **P.estimate_ctes(tuple(P.PADE))}, "stepmix": {**step_windows, **P.estimate_ctes(P.COMPOSITES)},
        "gap": gap, "step": step, "cells": {**gap, **CELLS}, "pooled": {**gap, **CELLS, **POOLED},
        "feat": {**gap_windows, **feature_ctes()}, "cfeat": {**gap_windows, **feature_ctes(), **CELLFEAT},
        "stepfeat": {**step_windows, **feature_ctes()},
        "gapfeat": {**gap, **feature_ctes(), **CELLFEAT}, "cellsfeat": {**gap, **CELLS, **feature_ctes(), **CELLFEAT},
        "diag": {**gap, **V.perturb_ctes(), **V.shift_ctes(), **V.DIAG_REC},
        "diagfeat": {**gap, **V.perturb_ctes(), **V.shift_ctes(), **V.DIAG_REC, **CELLS, **feature_ctes(), **CELLFEAT},
        "recorded": {**step, **feature_ctes(), **V.recorded_ctes()},
        "poolstep": {**gap, **CELLS, **POOLED, **{k: v for k, v in V.renamed_step().items()}},
        "react": {**gap, **V.reaction_ctes()}, "laststep": V.last_step_study(),
        "leadsum": {**gap, **CELLS, **POOLED, **V.renamed_step(), **V.renamed_modes()},
        "modes": V.mode_study(), "lens": V.length_study(),
    }


def oracle_sql() -> dict[str, str]:
    from oracles import analysis, curves, selection  # noqa: F401
    g = groups()
    return {name: P.with_ctes(g[group], sql) if g[group] else sql for name, (group, sql) in TAILS.items()}
