"""Ensembles and hindsight selectors over a pool of methods.

A group is one (window, target): one row per method, so the group is bounded by
the registry and all selectors of a group are computed in one aggregation.
"""
from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailcast.functions.arrays import let
from tailcast.operators.panels import TAGS, WIN_RATES, SKILL_MEDIANS, error_panel, exclude_capped, mean_rate, rate4, rounded
from tailcast.operators.rules import cascade
from tailcast.operators.scoring import REFERENCE_COLUMN, distance, error_of, is_catastrophic, is_valid, skill, wins
from tailcast.settings import (ENSEMBLE_EPS, ENSEMBLE_MEMBERS, MAX_VALID, MIN_VALID, RANK_MIN_VALID, REFERENCES, SHANKS_WYNN,
                               SMALL_POOL, TRIVIALS)

# executors need not have this package installed: functions that run there travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP = ("family", "is_holdout", "curve_id", "depth", "noise", "target_g", "capped")
ABLATIONS = (
    ("threshold_ens_010", "equal_pool", "threshold_vs_equal"),
    ("threshold_ens_010", "fixed_rational", "threshold_vs_rational"),
    ("capped_diag_pool", "equal_pool", "capped_diag_vs_equal"),
    ("diag_pool", "equal_pool", "diag_vs_equal"),
    ("diag_small", "equal_small", "weighting_small"),
    ("threshold_ens_010", "threshold_ens_safe", "filter_benefit"),
    ("equal_pool", "equal_small", "pool_expansion_gain"),
    ("threshold_ens_010", "constant_assumed", "threshold_vs_constant_assumed"),
    ("fixed_rational", "window_min", "rational_vs_window_min"),
)
GAP_SELECTORS = ("threshold_ens_010", "threshold_ens_safe", "diag_pool", "equal_pool", "fixed_rational", "constant_assumed")
# fixed values: published selector names
SELECTORS = ("oracle_pool", "oracle_small", "threshold_ens_010", "threshold_ens_050", "threshold_ens_safe",
             "capped_diag_pool", "capped_diag_safe", "diag_pool", "diag_ensemble_safe", "equal_pool", "equal_ensemble_safe",
             "diag_small", "equal_small", "phase2_cascade", "fixed_rational", "fixed_richardson", *TRIVIALS)


def derive_excluded(cells: DataFrame, floor: float = RANK_MIN_VALID) -> DataFrame:
    """Per method: pooled validity over uncapped core cells (the unrounded mean
    decides) and whether an accelerator falls below the floor."""
    rows = cells.filter("is_holdout = 0 AND is_oracle = 0 AND capped = 0")
    t = rows.groupBy("method").agg(F.max("is_trivial").alias("is_trivial"), mean_rate(F.col("valid_rate")).alias("_v"),
                                   mean_rate(F.col("cat_rate")).alias("_c"), F.percentile("med_error", F.lit(0.5)).alias("_m"),
                                   F.count(F.lit(1)).alias("n_cells"))
    eligible = 1 - F.col("is_trivial")
    return t.select("method", "is_trivial", eligible.alias("eligible"), rate4("_v").alias("valid_rate"),
                    rate4("_c").alias("cat_rate"), F.round("_m", 4).alias("med_error"), "n_cells",
                    ((eligible == 1) & (F.col("_v") < floor)).cast("int").alias("dangerous"))


def selector_errors(records: DataFrame, feats: DataFrame, pool, excluded: DataFrame, small=SMALL_POOL,
                    group=GROUP) -> DataFrame:
    """One row per (window, target) with the error of every selector.
    ``records`` carry ``perturb_iqr``; ``feats`` the cell features of the cascade."""
    flagged = records.join(F.broadcast(excluded.filter("dangerous = 1").select("method", F.lit(1).alias("_x"))), "method", "left")
    p, s = F.col("method").isin(*pool), F.col("method").isin(*small)
    safe = p & F.col("_x").isNull()
    e, q = F.col("estimate"), F.col("perturb_iqr")
    w = F.when(e.isNotNull() & q.isNotNull(), F.lit(1.0) / (q + F.lit(ENSEMBLE_EPS)))

    def weighted(which):
        return F.try_divide(F.sum(F.when(which, w * e)), F.sum(F.when(which, w)))

    def med(which):
        return F.percentile(F.when(which, e), F.lit(0.5))

    def err_of(m):
        return F.max(F.when(F.col("method") == m, F.col("error")))

    def members(which):
        return F.collect_list(F.when(which & w.isNotNull(), F.struct(w.alias("w"), e.alias("e"))))

    calm = {t: safe & (q.isNull() | (q <= t)) for t in (0.10, 0.50, 1e9)}
    agg = flagged.groupBy(*group).agg(
        F.max("true_val").alias("true_val"), F.max("ref_error").alias("ref_error"), F.max("curr_err").alias("curr_err"),
        err_of("last_value").alias("E_last"),
        F.min(F.when(p, F.col("error"))).alias("oracle_pool"), F.min(F.when(s, F.col("error"))).alias("oracle_small"),
        *[med(c).alias(f"_{n}") for n, c in (("threshold_ens_010", calm[0.10]), ("threshold_ens_050", calm[0.50]),
                                             ("threshold_ens_safe", calm[1e9]), ("equal_pool", p), ("equal_ensemble_safe", safe), ("equal_small", s))],
        *[weighted(c).alias(f"_{n}") for n, c in (("diag_pool", p), ("diag_ensemble_safe", safe), ("diag_small", s))],
        members(p).alias("_m_pool"), members(safe).alias("_m_safe"),
        *[err_of(m).alias(m) for m in TRIVIALS],
        err_of("rational_fit").alias("fixed_rational"), err_of("richardson_1").alias("fixed_richardson"))

    def capped(col):
        """Weights limited to five times the median weight."""
        ws = F.array_sort(F.transform(col, lambda m: m["w"]))
        mid = let(ws, lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2.0)

        def fold(limit):
            part = F.transform(col, lambda m: F.struct(F.least(m["w"], limit).alias("w"), m["e"].alias("e")))
            return F.aggregate(part, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d")),
                               lambda a, m: F.struct((a["n"] + m["w"] * m["e"]).alias("n"), (a["d"] + m["w"]).alias("d")),
                               lambda a: F.try_divide(a["n"], a["d"]))
        return let(F.lit(5.0) * mid, fold)

    agg = agg.withColumns({"_capped_diag_pool": capped(F.col("_m_pool")), "_capped_diag_safe": capped(F.col("_m_safe"))})
    return _with_cascade(agg, feats, group)


def _with_cascade(agg: DataFrame, feats: DataFrame, group) -> DataFrame:
    values = [c[1:] for c in agg.columns if c.startswith("_") and not c.startswith("_m_")]
    out = agg.join(feats.withColumn("_route", cascade()).select("family", "depth", "noise", "_route"),
                   ["family", "depth", "noise"], "left")
    return out.select(
        *group, "true_val", "ref_error", "curr_err", "E_last", "oracle_pool", "oracle_small",
        *[F.abs(F.col(f"_{v}") - F.col("true_val")).alias(v) for v in values],
        F.when(F.col("_route") == "rational_fit", F.col("fixed_rational")).otherwise(F.col("fixed_richardson")).alias("phase2_cascade"),
        "fixed_rational", "fixed_richardson", *TRIVIALS)


MEDIANS = ("threshold_ens_010", "threshold_ens_050", "threshold_ens_safe", "equal_pool", "equal_ensemble_safe", "equal_small")
WEIGHTED = ("diag_pool", "diag_ensemble_safe", "diag_small")
LIMITED = ("capped_diag_pool", "capped_diag_safe")
NAMED = {**{m: m for m in TRIVIALS}, "fixed_rational": "rational_fit", "fixed_richardson": "richardson_1"}
IN_ROW = ("oracle_pool", "oracle_small", *MEDIANS, *WEIGHTED, *LIMITED, *NAMED)


def _middle(v: np.ndarray) -> np.ndarray:
    """Median of the values of each row that are not NaN."""
    v = np.sort(v, axis=1)
    n = np.count_nonzero(~np.isnan(v), axis=1)
    a, b = (np.take_along_axis(v, np.maximum(i, 0)[:, None], axis=1)[:, 0] for i in ((n - 1) // 2, np.minimum(n // 2, v.shape[1] - 1)))
    return np.where(n > 0, np.where(a == b, a, 0.5 * a + 0.5 * b), np.nan)


def _selectors_of_block(ests, spread, truth, methods, pool, small, dangerous) -> np.ndarray:
    """The values ``IN_ROW`` for a block of (window, target) rows with a column per method; NaN stands for NULL."""
    here = lambda names: np.array([m in names for m in methods])
    p, s = here(pool), here(small)
    safe = p & ~here(dangerous)
    with np.errstate(all="ignore"):
        e = np.where(np.isfinite(ests) & (ests >= MIN_VALID) & (ests <= MAX_VALID), ests, np.nan)
        err = np.rint(np.abs(e - truth[:, None]) * 1e12) / 1e12
        w = 1.0 / (np.where(np.isnan(e), np.nan, spread) + ENSEMBLE_EPS)
        calm = lambda most: safe & ~(spread > most)
        only = lambda v, which: np.where(which, v, np.nan)

        def mean(weights):
            return np.where(np.isnan(weights).all(axis=1), np.nan, np.nansum(weights * e, axis=1) / np.nansum(weights, axis=1))

        def limited(which):
            own = only(w, which)
            return mean(np.minimum(own, 5.0 * _middle(own)[:, None]))

        out = [np.fmin.reduce(only(err, which), axis=1) for which in (p, s)]
        out += [_middle(only(e, which)) for which in (calm(0.10), calm(0.50), calm(1e9), p, safe, s)]
        out += [mean(only(w, which)) for which in (p, safe, s)]
        out += [limited(which) for which in (p, safe)]
    lost = np.full(len(ests), np.nan)
    out += [err[:, methods.index(m)] if m in methods else lost for m in NAMED.values()]
    return np.stack(out, axis=1)


def _selectors_in_row(methods, pool, small, dangerous):
    """Arrow function (estimates, spreads, true value) -> ARRAY<DOUBLE> of the values ``IN_ROW``."""
    methods, pool, small, dangerous = list(methods), set(pool), set(small), set(dangerous)

    @F.arrow_udf("array<double>")
    def run(ests: pa.Array, spread: pa.Array, truth: pa.Array) -> pa.Array:
        e, q = (np.asarray(a.flatten(), dtype=float).reshape(-1, len(methods)) for a in (ests, spread))
        out = _selectors_of_block(e, q, np.asarray(truth, dtype=float), methods, pool, small, dangerous)
        flat = out.reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(flat, mask=np.isnan(flat)))
    return run


def packed_selector_errors(rows: DataFrame, methods, feats: DataFrame, pool, excluded: DataFrame, records, small=SMALL_POOL, group=GROUP) -> DataFrame:
    """``selector_errors`` from packed estimates with their spreads (see ``diagnostics.packed_with_spreads``): the methods of a
    (window, target) stand in one row, so nothing is grouped or shuffled.  Where rows share a group, they are
    gathered from the ``records`` (a function that returns them) instead."""
    if rows.groupBy(*group).count().filter("count > 1").limit(1).count():
        return selector_errors(records(), feats, pool, excluded, small, group)
    dangerous = [r.method for r in excluded.filter("dangerous = 1").select("method").collect()]      # at most the registered methods
    refs = [error_of(F.col(REFERENCE_COLUMN[m]), F.col("true_val")) for m, _ in REFERENCES]
    found = rows.withColumns({"_all": _selectors_in_row(methods, pool, small, dangerous)("ests", "perturb_iqr", "true_val"),
                              "ref_error": F.least(*refs), "curr_err": distance(F.col("last_v"), F.col("true_val"))})
    of = {n: F.get("_all", F.lit(i)) for i, n in enumerate(IN_ROW)}
    agg = found.select(*group, "true_val", "ref_error", "curr_err", of["last_value"].alias("E_last"), of["oracle_pool"].alias("oracle_pool"), of["oracle_small"].alias("oracle_small"),
                       *[of[n].alias(f"_{n}") for n in (*MEDIANS, *WEIGHTED, *LIMITED)], *[of[n].alias(n) for n in NAMED])
    return _with_cascade(agg, feats, group)


def selector_long(wide: DataFrame, selectors=SELECTORS) -> DataFrame:
    """Selectors as records: the catastrophe and skill rules of any other record."""
    refs = {tag: F.col(f"_r_{tag}") for _, tag in REFERENCES}
    keep = [c for c in wide.columns if c not in selectors]
    rows = wide.withColumns({f"_r_{tag}": F.col(m) for m, tag in REFERENCES}).unpivot(
        [*keep, *[f"_r_{tag}" for tag in refs]], list(selectors), "selector", "error")
    rows = rows.withColumns({
        "valid": F.col("error").isNotNull().cast("int"),
        "catastrophic": is_catastrophic(F.col("error"), F.col("curr_err")).cast("int"),
        "skill": skill(F.col("error"), F.col("ref_error")),
        **{f"skill_vs_{t}": skill(F.col("error"), r) for t, r in refs.items()},
        **{f"win_vs_{t}": wins(F.col("error"), r) for t, r in refs.items()}})
    return rows.drop(*[f"_r_{tag}" for tag in refs])


def selector_summary(long: DataFrame, keys) -> DataFrame:
    """Panel, median skill and fixed-reference aggregates per selector and slice."""
    out = error_panel(long, ["selector", *keys],
                      [F.avg(F.col(f"win_vs_{t}").cast("double")).alias(f"win_rate_vs_{t}") for t in TAGS if t != "last"],
                      {"med_skill": "skill", **{f"med_skill_vs_{t}": f"skill_vs_{t}" for t in TAGS}})
    out = rounded(out, ["valid_rate", "cat_rate", "med_skill", *WIN_RATES, *SKILL_MEDIANS])
    return rounded(out, ["mean_error", "sd_error", "med_error", "q25_error", "q75_error", "p90_error"], 6)


def ablation(wide: DataFrame) -> DataFrame:
    """Mean paired difference of selector pairs where both are valid (core, uncapped)."""
    core = exclude_capped(wide).filter("is_holdout = 0")
    aggs = [F.count(F.lit(1)).alias("n_total")]
    for i, (a, b, _) in enumerate(ABLATIONS):
        aggs += [F.avg(F.col(b) - F.col(a)).alias(f"g{i}"), F.count(F.col(b) - F.col(a)).alias(f"n{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(lbl).alias("comparison"), F.col(f"g{i}").alias("gain"), F.col(f"n{i}").alias("n_both_valid"))
                               for i, (_, _, lbl) in enumerate(ABLATIONS)])).alias("r")
    return core.groupBy("target_g").agg(*aggs).select("target_g", "n_total", rows).select(
        "r.comparison", "target_g", F.round("r.gain", 6).alias("mean_improvement"), "r.n_both_valid", "n_total").filter("n_both_valid > 0")


def oracle_gap(wide: DataFrame) -> DataFrame:
    """Mean distance of selectors to the pool oracle by depth."""
    core = exclude_capped(wide).filter("is_holdout = 0")
    aggs = [F.count(F.lit(1)).alias("n_total")]
    for s in GAP_SELECTORS:
        d = F.col(s) - F.col("oracle_pool")
        aggs += [F.avg(d).alias(f"g_{s}"), F.count(d).alias(f"n_{s}")]
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("selector"), F.col(f"g_{s}").alias("gap"), F.col(f"n_{s}").alias("n_both_valid"))
                               for s in GAP_SELECTORS])).alias("r")
    return core.groupBy("depth", "target_g").agg(*aggs).select("depth", "target_g", "n_total", rows).select(
        "depth", "target_g", "r.selector", F.round("r.gap", 6).alias("mean_gap_vs_oracle"), "r.n_both_valid", "n_total").filter("n_both_valid > 0")


def method_reliability(records: DataFrame, excluded: DataFrame, pool, target: float) -> DataFrame:
    from tailcast.functions.quantiles import grouped
    rows = exclude_capped(records).filter((F.col("is_holdout") == 0) & (F.col("target_g") == target) & F.col("method").isin(*pool))
    out = grouped(rows, ["method"], [F.avg("perturb_iqr").alias("mean_piqr"), F.avg("error").alias("mean_err"),
                                     *[F.avg(F.col(f"win_vs_{t}").cast("double")).alias(f"win_rate_vs_{t}") for t in TAGS]],
                  {"med_piqr": ("perturb_iqr", 0.5), "med_skill": ("skill", 0.5),
                   **{f"med_skill_vs_{t}": (f"skill_vs_{t}", 0.5) for t in TAGS}})
    return out.join(F.broadcast(excluded.select("method", F.col("dangerous").alias("is_dangerous"))), "method", "left")


def selector_comparison(records: DataFrame, target: float, pool=SMALL_POOL) -> DataFrame:
    """The short selector table at one target: oracle over the pool, two fixed
    methods, the better of the two, the diagnostic ensemble, the trivials."""
    group = [c for c in GROUP]
    s = F.col("method").isin(*pool)
    w = F.when(s & F.col("estimate").isNotNull() & F.col("perturb_iqr").isNotNull(), F.lit(1.0) / (F.col("perturb_iqr") + F.lit(ENSEMBLE_EPS)))

    def err_of(m):
        return F.max(F.when(F.col("method") == m, F.col("error")))

    wide = (records.filter(F.col("target_g") == target).groupBy(*group).agg(
        F.max("ref_error").alias("ref_error"), F.max("curr_err").alias("curr_err"), err_of("last_value").alias("E_last"),
        F.min(F.when(s, F.col("error"))).alias("oracle"), err_of("rational_fit").alias("fixed_rational"),
        err_of("richardson_1").alias("fixed_richardson"),
        F.min(F.when(F.col("method").isin("richardson_1", "rational_fit"), F.col("error"))).alias("phase2_proxy"),
        F.abs(F.try_divide(F.sum(w * F.col("estimate")), F.sum(w)) - F.max("true_val")).alias("diag_ensemble"),
        *[err_of(m).alias(m) for m, _ in REFERENCES]))
    names = ("oracle", "fixed_rational", "fixed_richardson", "phase2_proxy", "diag_ensemble", *[m for m, _ in REFERENCES])
    return selector_summary(selector_long(wide, names), ["target_g"])
