"""Descriptive panels of records and the aggregates built on them.

A cell is one (family, depth, noise, target); its records are the runs.  Error
statistics are over the valid records, rates over all of them.
"""
from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.functions import quantiles
from tailcast.functions.quantiles import grouped
from tailcast.operators.scoring import REFERENCE_COLUMN
from tailcast.settings import CAT_MULT, MAX_VALID, MIN_VALID, RANK_MIN_VALID, REFERENCES, SKILL_EPS

# executors need not have this package installed: functions that run there travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PANEL = ("n_total", "n_valid", "valid_rate", "cat_rate", "mean_error", "sd_error", "med_error",
         "q25_error", "q75_error", "p90_error", "win_rate_vs_last")
TAGS = tuple(tag for _, tag in REFERENCES)
SKILL_MEDIANS = tuple(f"med_skill_vs_{t}" for t in TAGS)
WIN_RATES = tuple(f"win_rate_vs_{t}" for t in TAGS)
GAP_CELL = ("family", "is_holdout", "depth", "noise", "target_g")
METHOD_ATTRS = ("method_family", "method_type", "is_trivial", "is_oracle")


def panel_aggregates() -> list[Column]:
    ok = F.col("valid") == 1
    err = F.when(ok, F.col("error"))
    win = F.coalesce(ok & (F.col("error") < F.col("E_last")), F.lit(False))
    return [F.count(F.lit(1)).alias("n_total"), F.count(F.when(ok, 1)).alias("n_valid"),
            (F.count(F.when(ok, 1)) / F.count(F.lit(1))).alias("valid_rate"),
            F.avg(F.col("catastrophic").cast("double")).alias("cat_rate"),
            F.avg(err).alias("mean_error"), F.stddev_samp(err).alias("sd_error"),
            F.avg(win.cast("double")).alias("win_rate_vs_last")]


def error_quantiles() -> dict[str, tuple[str, float]]:
    return {"q25_error": ("_err", 0.25), "med_error": ("_err", 0.5),
            "q75_error": ("_err", 0.75), "p90_error": ("_err", 0.9)}


def error_panel(records: DataFrame, keys, extra=(), medians=None) -> DataFrame:
    """The eleven panel statistics per group, plus extra aggregates and medians."""
    rows = records.withColumn("_err", F.when(F.col("valid") == 1, F.col("error")))
    quantiles = error_quantiles()
    for name, col in (medians or {}).items():
        quantiles[name] = (col, 0.5)
    out = grouped(rows, keys, [*panel_aggregates(), *extra], quantiles)
    rest = [c for c in out.columns if c not in PANEL and c not in keys]
    return out.select(*keys, *PANEL, *rest)


RATES = ("valid_rate", "cat_rate", *WIN_RATES)


def rate4(v) -> Column:
    """A rate in [0, 1] with four decimals, half up on the scaled double."""
    v = F.col(v) if isinstance(v, str) else v
    return F.floor(v * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)


def mean_rate(v: Column) -> Column:
    """Mean of four-decimal rates from an exact integer sum: the result does not
    depend on the order of the rows, so a tie at the next rounding is stable."""
    return F.sum(F.round(v * F.lit(1e4)).cast("long")) / (F.count(v) * F.lit(1e4))


def rounded(df: DataFrame, columns, digits: int = 4) -> DataFrame:
    """Four-decimal rates and rounded statistics, where the columns exist."""
    return df.withColumns({c: rate4(c) if c in RATES else F.round(c, digits) for c in columns if c in df.columns})


def cell_table(records: DataFrame, cell=GAP_CELL) -> DataFrame:
    """Aggregate per (method, cell); rates carry four decimals, as every later
    table reads them."""
    extra = [F.max("capped").alias("capped")] if "capped" in records.columns else []
    medians = {"n_f": "n_f", "L_hat": "L_hat", "med_improve": "improve_ratio", "med_skill": "skill",
               **{f"med_skill_vs_{t}": f"skill_vs_{t}" for t in TAGS}}
    if "achieved_g" in records.columns:
        medians["achieved_g"] = "achieved_g"
    if "n_f" in cell:
        medians.pop("n_f")
    extra += [F.avg(F.col(f"win_vs_{t}").cast("double")).alias(f"win_rate_vs_{t}") for t in TAGS if t != "last"]
    extra += [F.max(a).alias(a) for a in METHOD_ATTRS if a in records.columns]
    out = error_panel(records, ["method", *cell], extra, medians)
    return rounded(out, ["valid_rate", "cat_rate", *SKILL_MEDIANS, *WIN_RATES])


METHOD_BLOCK = 9               # methods of a cell that travel together
CELL_ROWS = 500_000            # windows of a cell that one task may hold
CELL_DOUBLES = ("valid_rate", "cat_rate", "mean_error", "sd_error", "med_error", "q25_error", "q75_error", "p90_error", "win_rate_vs_last",
                "win_rate_vs_assumed", "win_rate_vs_wmean", "win_rate_vs_wmin", "n_f", "L_hat", "med_improve", "med_skill", *SKILL_MEDIANS, "achieved_g")


def _quantiles(values: np.ndarray, probs) -> list[np.ndarray]:
    """Quantiles of the values of each column that are not NaN, interpolated as Spark's percentile does."""
    v = np.sort(values, axis=0)
    n = np.count_nonzero(~np.isnan(v), axis=0)
    out = []
    for p in probs:
        pos = p * np.maximum(n - 1, 0)
        low, high = np.floor(pos), np.ceil(pos)
        a, b = (v[i.astype(int), np.arange(v.shape[1])] for i in (low, high))
        with np.errstate(invalid="ignore"):
            out.append(np.where(n > 0, np.where(a == b, a, (high - pos) * a + (pos - low) * b), np.nan))
    return out


def _cell_of_method(ests: np.ndarray, truth, refs: dict) -> dict:
    """The statistics of ``cell_table`` for one cell and a column of estimates, one per window.  The rules are those of
    ``scoring``; NaN stands for NULL."""
    apart = lambda a, b: np.rint(np.abs(a - b) * 1e12) / 1e12
    sound = lambda v: np.isfinite(v) & (v >= MIN_VALID) & (v <= MAX_VALID)
    rows = len(ests)
    with np.errstate(all="ignore"):
        valid = sound(ests)
        err = np.where(valid, apart(ests, truth[:, None]), np.nan)
        known = {t: np.where(sound(v), apart(v, truth), np.nan)[:, None] for t, v in refs.items()}
        current = apart(refs["last"], truth)[:, None]
        best = np.fmin.reduce(list(known.values()))

        def ratio(ref):
            exact = np.where(err <= SKILL_EPS, 1.0, np.inf)
            return np.where(np.isnan(err) | np.isnan(ref), np.nan, np.where(ref <= SKILL_EPS, exact, err / ref))

        n = np.count_nonzero(~np.isnan(err), axis=0)
        mean = np.where(n > 0, np.nansum(err, axis=0) / n, np.nan)
        out = {"n_total": np.full(err.shape[1], rows), "n_valid": valid.sum(axis=0), "mean_error": mean,
               "sd_error": np.where(n > 1, np.sqrt(np.nansum((err - mean) ** 2, axis=0) / (n - 1)), np.nan),
               "cat_rate": (np.isnan(err) | ((current > 1e-12) & (err > CAT_MULT * current))).sum(axis=0) / rows,
               "med_improve": _quantiles(np.where(err > 1e-12, current / err, np.where(np.isnan(err), np.nan, 1.0)), [0.5])[0],
               "med_skill": _quantiles(ratio(best), [0.5])[0]}
        out["valid_rate"] = out["n_valid"] / rows
        for t, ref in known.items():
            out[f"win_rate_vs_{t}"] = (err < ref).sum(axis=0) / rows
            out[f"med_skill_vs_{t}"] = _quantiles(ratio(ref), [0.5])[0]
    return out | dict(zip(("q25_error", "med_error", "q75_error", "p90_error"), _quantiles(err, [0.25, 0.5, 0.75, 0.9])))


def packed_cell_table(rows: DataFrame, methods, attributes: DataFrame, records, cell=GAP_CELL) -> DataFrame:
    """``cell_table`` from packed estimates (one row per window and target, see ``forecast.packed``): instead of ten columns of
    every record, the estimates and the five numbers that all methods share go to their cell, in blocks of methods,
    where numpy scores and sorts one method after the other.  A cell and block is at most ``CELL_ROWS`` rows of about 130 bytes; with
    larger cells the ``records`` (a function that returns them) take the way of ``grouped``, which has no such bound."""
    if quantiles._largest(rows, cell) > CELL_ROWS:
        return cell_table(records(), cell)
    methods, tags = list(methods), {t: REFERENCE_COLUMN[m] for m, t in REFERENCES}
    parts = [methods[i:i + METHOD_BLOCK] for i in range(0, len(methods), METHOD_BLOCK)]
    part = F.explode(F.array(*[F.struct(F.lit(i).alias("_part"), F.slice("ests", i * METHOD_BLOCK + 1, len(p)).alias("ests")) for i, p in enumerate(parts)]))
    shared = ["capped", "n_f", "achieved_g", "true_val", *tags.values()]
    dealt = rows.select(*cell, *shared, part.alias("_e")).select(*cell, *shared, "_e.*")
    types = dict(rows.dtypes)
    schema = ", ".join(["method string", *[f"{k} {types[k]}" for k in cell], "n_total bigint", "n_valid bigint", "capped int", *[f"{c} double" for c in CELL_DOUBLES]])
    doubles = CELL_DOUBLES

    def run(table: pa.Table) -> pa.Table:
        number = lambda c: np.asarray(table.column(c).combine_chunks().cast(pa.float64()), dtype=float)
        names = parts[table.column("_part")[0].as_py()]
        ests = np.asarray(table.column("ests").combine_chunks().flatten(), dtype=float).reshape(-1, len(names))
        truth, refs = number("true_val"), {t: number(c) for t, c in tags.items()}
        each = [_cell_of_method(ests[:, [i]], truth, refs) for i in range(len(names))]
        found = {c: np.concatenate([e[c] for e in each]) for c in each[0]}
        for c, v in (("n_f", number("n_f")), ("L_hat", refs["assumed"]), ("achieved_g", number("achieved_g"))):
            found[c] = np.repeat(_quantiles(v[:, None], [0.5])[0], len(names))
        here = {k: pa.array([table.column(k)[0].as_py()] * len(names), type=table.column(k).type) for k in cell}
        capped = number("capped")
        capped = [None if np.isnan(capped).all() else int(np.nanmax(capped))] * len(names)
        return pa.table({"method": pa.array(names), **here, "n_total": pa.array(found["n_total"], type=pa.int64()), "n_valid": pa.array(found["n_valid"], type=pa.int64()),
                         "capped": pa.array(capped, type=pa.int32()), **{c: pa.array(found[c], type=pa.float64(), mask=np.isnan(found[c])) for c in doubles}})

    out = dealt.groupBy(*cell, "_part").applyInArrow(run, schema).join(F.broadcast(attributes.select("method", *METHOD_ATTRS)), "method", "left")
    order = ["method", *cell, *PANEL, "capped", *[w for w in WIN_RATES if w not in PANEL], *METHOD_ATTRS, "n_f", "L_hat", "med_improve", "med_skill", *SKILL_MEDIANS, "achieved_g"]
    return rounded(out.select(*order), ["valid_rate", "cat_rate", *SKILL_MEDIANS, *WIN_RATES])


def skill_aggregates(records: DataFrame, keys) -> DataFrame:
    """Median of each skill ratio and mean of each win flag."""
    out = grouped(records, keys, [F.avg(F.col(f"win_vs_{t}").cast("double")).alias(f"win_rate_vs_{t}") for t in TAGS],
                  {f"med_skill_vs_{t}": (f"skill_vs_{t}", 0.5) for t in TAGS})
    return rounded(out, [*SKILL_MEDIANS, *WIN_RATES])


def exclude_capped(df: DataFrame) -> DataFrame:
    return df.filter(F.col("capped") == 0) if "capped" in df.columns else df


def capped_block(df: DataFrame, keys, values) -> DataFrame:
    """The capped rows that pooled tables leave out: medians and counts."""
    out = grouped(df.filter(F.col("capped") == 1), keys, [F.count(F.lit(1)).alias("n")],
                  {"n_f": ("n_f", 0.5), "achieved_g": ("achieved_g", 0.5), **{f"med_{v}": (v, 0.5) for v in values}})
    return out.select(*keys, "n_f", "achieved_g", *[f"med_{v}" for v in values], "n")


def pooled_table(cells: DataFrame, by=("method", "target_g")) -> DataFrame:
    """Second level: means of cell rates and medians of cell medians per method
    and target, capped cells excluded; a method with capped cells only keeps a
    row of NULLs.  Cells number families x depths x noises, so a buffer holds them."""
    c = cells.withColumn("_use", F.col("capped") == 0 if "capped" in cells.columns else F.lit(True))
    use = F.col("_use")

    def kept(col):
        return F.when(use, F.col(col))

    def med(col):
        return F.percentile(kept(col), F.lit(0.5))

    return c.groupBy(*by).agg(
        *[F.max(a).alias(a) for a in METHOD_ATTRS if a in cells.columns],
        rate4(mean_rate(kept("valid_rate"))).alias("valid_rate"),
        rate4(mean_rate(kept("cat_rate"))).alias("cat_rate"),
        med("med_error").alias("med_error"), med("med_improve").alias("med_improve"),
        med("med_skill").alias("med_skill"),
        *[med(s).alias(s) for s in SKILL_MEDIANS],
        *[rate4(mean_rate(kept(w))).alias(w) for w in WIN_RATES],
        F.count_distinct(kept("family")).alias("n_families"),
        F.count(F.when(use, 1)).alias("n_cells"),
        F.count(F.when(~use, 1)).alias("n_capped_excluded"))


def heat_map(cells: DataFrame, families, value: str = "med_error", how: str = "median") -> DataFrame:
    """Method x family table of a cell statistic."""
    agg = F.percentile(value, F.lit(0.5)) if how == "median" else F.avg(value)
    return cells.groupBy("method").pivot("family", list(families)).agg(agg)


def family_table(cells: DataFrame, keys=("family", "target_g", "method")) -> DataFrame:
    return exclude_capped(cells).groupBy(*keys).agg(
        F.percentile("med_error", F.lit(0.5)).alias("med_error"), mean_rate(F.col("win_rate_vs_last")).alias("win"),
        mean_rate(F.col("valid_rate")).alias("valid"), mean_rate(F.col("cat_rate")).alias("cat_rate"), F.count(F.lit(1)).alias("n"))


def validity_by_depth(records: DataFrame) -> DataFrame:
    return records.groupBy("method", "depth", "noise").agg(
        rate4(F.avg(F.col("valid").cast("double"))).alias("valid_rate"), F.count(F.lit(1)).alias("n"))


def validity_over_noise(validity: DataFrame, depths) -> DataFrame:
    """n-weighted validity per method and depth over the noise levels, the
    smallest single (depth, noise) rate, and whether any depth is below the floor."""
    wide = validity.groupBy("method").pivot("depth", list(depths)).agg(
        F.sum(F.col("valid_rate") * F.col("n")) / F.sum("n"))
    worst = validity.groupBy("method").agg(F.min("valid_rate").alias("min_rate"))
    below = F.greatest(*[(F.col(str(d)) < RANK_MIN_VALID).cast("int") for d in depths])
    return (wide.join(worst, "method").withColumn("below_floor", below)
            .withColumnsRenamed({str(d): f"rate_{d}" for d in depths}))


def effective_sample(cells: DataFrame) -> DataFrame:
    """Per set and target: families and cells in use, families fully capped."""
    one = cells.select("is_holdout", "target_g", "family", "depth", "noise", "capped").distinct()
    return one.groupBy("is_holdout", "target_g").agg(
        F.count_distinct(F.when(F.col("capped") == 0, F.col("family"))).alias("families_used"),
        F.count(F.when(F.col("capped") == 0, 1)).alias("cells_used"),
        (F.count_distinct("family") - F.count_distinct(F.when(F.col("capped") == 0, F.col("family"))))
        .alias("families_capped"))


def invalid_rates(records: DataFrame, excluded: DataFrame) -> DataFrame:
    """Share of invalid accelerator records outside the excluded set: in all, by
    noise and by depth, from one pass."""
    kept = records.filter(F.col("is_trivial") == 0).join(F.broadcast(excluded.select("method")), "method", "left_anti")
    return (kept.select("noise", "depth", (1 - F.col("valid")).alias("bad"))
            .groupingSets([["noise"], ["depth"], []], "noise", "depth")
            .agg(F.sum("bad").alias("n_invalid"), F.count(F.lit(1)).alias("n"),
                 F.avg(F.col("bad").cast("double")).alias("invalid_rate")))


def baseline_summary(ranked: DataFrame, rank_col: str = "accel_rank") -> DataFrame:
    """Per set and target: the best ranked accelerator, medians over the
    accelerators and how many beat a trivial predictor."""
    acc = ranked.filter(F.col("is_trivial") == 0)

    def med(col):
        return F.percentile(col, F.lit(0.5)).alias(f"median_{col}")

    def trivial(m):
        return F.max(F.when(F.col("method") == m, F.col("med_error")))

    stats = acc.groupBy("regime_set", "target_g").agg(
        F.min_by("method", rank_col).alias("best_method"), F.sum("rank_eligible").alias("n_eligible"),
        *[med(c) for c in ("med_error", "med_skill", "win_rate_vs_assumed", "win_rate_vs_last")],
        F.count(F.when(F.col("win_rate_vs_assumed") > 0.5, 1)).alias("n_win_assumed"),
        F.count(F.when(F.col("win_rate_vs_last") > 0.5, 1)).alias("n_win_last"),
        F.count(F.when(F.col("med_skill") < 1.0, 1)).alias("n_strict"))
    refs = ranked.groupBy("regime_set", "target_g").agg(
        trivial("constant_oracle").alias("oracle_error"), trivial("constant_assumed").alias("assumed_error"),
        trivial("last_value").alias("last_error"))
    return stats.join(refs, ["regime_set", "target_g"])


def skill_summary(cells: DataFrame) -> DataFrame:
    """Share of uncapped cells with median skill below 1, per method family and
    over all accelerators; a missing median counts as not below."""
    a = exclude_capped(cells).filter(F.col("is_oracle") == 0)
    below = F.coalesce(F.col("med_skill") < 1.0, F.lit(False)).cast("int")
    rows = a.select("method_family", "target_g", "is_holdout", "method", "is_trivial", below.alias("beats"))
    per_family = rows.groupBy("method_family", "target_g", "is_holdout")
    total = rows.filter(F.col("is_trivial") == 0).groupBy(
        F.lit("all accelerators").alias("method_family"), "target_g", "is_holdout")
    aggs = [F.count_distinct("method").alias("n_methods"), F.sum("beats").alias("n_below"),
            F.count(F.lit(1)).alias("n_cells"), F.avg(F.col("beats").cast("double")).alias("share_below")]
    return per_family.agg(*aggs).unionByName(total.agg(*aggs))


def noop_statistics(cells: DataFrame, methods, classes: Column) -> DataFrame:
    """How close methods stay to doing nothing, per noise class and over all:
    per variant medians first, then counts inside the bands and the spread."""
    rows = exclude_capped(cells).filter(F.col("method").isin(*methods)).withColumn("noise_class", classes)
    per = (rows.groupingSets([["target_g", "is_holdout", "method", "noise_class"], ["target_g", "is_holdout", "method"]],
                             "target_g", "is_holdout", "method", "noise_class")
           .agg(F.percentile("med_improve", F.lit(0.5)).alias("mi"), mean_rate(F.col("win_rate_vs_last")).alias("win"),
                F.count(F.lit(1)).alias("n_cells")))
    per = per.withColumn("noise_class", F.coalesce("noise_class", F.lit("all")))
    return per.groupBy("target_g", "is_holdout", "noise_class").agg(
        F.count(F.lit(1)).alias("n_variants"), F.max("n_cells").alias("n_cells"),
        F.count(F.when(F.col("mi").between(0.9, 1.1), 1)).alias("n_mi_band"),
        F.count(F.when(F.col("win").between(0.4, 0.6), 1)).alias("n_win_band"),
        F.min("mi").alias("min_mi"), F.percentile("mi", F.lit(0.5)).alias("med_mi"), F.max("mi").alias("max_mi"),
        F.min("win").alias("min_win"), F.percentile("win", F.lit(0.5)).alias("med_win"), F.max("win").alias("max_win"))


def capped_inventory(cells: DataFrame) -> DataFrame:
    """Per capped (family, target): horizon, achieved fraction, how many cells."""
    one = cells.filter(F.col("capped") == 1).select(
        "family", "is_holdout", "depth", "noise", "target_g", "n_f", "achieved_g").distinct()
    return one.groupBy("family", "is_holdout", "target_g").agg(
        F.min("n_f").alias("min_n_f"), F.max("n_f").alias("max_n_f"),
        F.min("achieved_g").alias("min_achieved"), F.max("achieved_g").alias("max_achieved"),
        F.count(F.lit(1)).alias("n_cells"), F.count_distinct("depth").alias("n_depths"))


# ---- recorded-curve summaries --------------------------------------------------
def strata(summary: DataFrame) -> DataFrame:
    """Every summary statistic over all cells and before / after the minimum,
    from one scan."""
    fail = F.coalesce(F.col("cascade_skill") >= 1.0, F.lit(False))
    part = F.explode(F.array(F.lit("all"), F.when(F.col("post_min_target") == 1, "post_min").otherwise("pre_min")))
    s = summary.withColumn("_fail", fail.cast("int")).withColumns({
        "stratum": part, "_iqr_fail": F.when(F.col("_fail") == 1, F.col("perturb_iqr")), "_iqr_succ": F.when(F.col("_fail") == 0, F.col("perturb_iqr"))})
    return grouped(s, ["stratum"], [
        F.count(F.lit(1)).alias("n_cells"), F.sum("_fail").alias("n_fail"),
        rate4(F.avg(F.col("_fail").cast("double"))).alias("fail_rate"),
        F.count(F.when(F.col("improvement") < 0, 1)).alias("n_neg_improvement"),
        *[rate4(F.avg(F.col(f"cascade_win_vs_{t}").cast("double"))).alias(f"win_rate_vs_{t}") for t in TAGS]],
        {"med_cascade_err": ("cascade_err", 0.5), "med_cascade_skill": ("cascade_skill", 0.5), "med_improvement": ("improvement", 0.5),
         "med_perturb_iqr_fail": ("_iqr_fail", 0.5), "med_perturb_iqr_succ": ("_iqr_succ", 0.5)})


def fixed_method_blocks(records: DataFrame, methods) -> DataFrame:
    """n, valid, wins, catastrophes and median ratios per family, split at the
    minimum, with pooled rows."""
    ok = F.col("valid") == 1
    one = records.filter(F.col("method").isin(*methods) & F.col("method").isNotNull()).select(
        "method", "valid", "win_vs_last", "catastrophic", F.when(ok, F.col("skill_vs_last")).alias("_ratio"), F.when(ok, F.col("improve_ratio")).alias("_improve"),
        F.explode(F.array(F.col("family"), F.lit("ALL"))).alias("family"), "post_min_target")
    rows = one.withColumn("stratum", F.explode(F.array(F.lit("all"), F.when(F.col("post_min_target") == 1, "post").otherwise("pre"))))
    return grouped(rows, ["family", "stratum", "method"], [
        F.count(F.lit(1)).alias("n"), F.sum("valid").alias("n_valid"), F.sum("win_vs_last").alias("n_win"), F.sum("catastrophic").alias("n_cat")],
        {"med_ratio": ("_ratio", 0.5), "med_improve": ("_improve", 0.5)})


def win_everywhere(records: DataFrame, default: str) -> DataFrame:
    """Per split and accelerator: wins, and whether it wins every cell or more
    cells than the default."""
    acc = records.filter(F.col("is_trivial") == 0)
    split = F.explode(F.array(F.lit("all"), F.when(F.col("post_min_target") == 1, "post").otherwise("pre")))
    per = (acc.select("method", "win_vs_last", split.alias("split")).groupBy("split", "method")
           .agg(F.sum("win_vs_last").alias("n_win"), F.count(F.lit(1)).alias("n")))
    ref = per.filter(F.col("method") == default).select("split", F.col("n_win").alias("default_wins"))
    return per.join(F.broadcast(ref), "split").withColumns({
        "wins_every": (F.col("n_win") == F.col("n")).cast("int"),
        "more_than_default": (F.col("n_win") > F.col("default_wins")).cast("int")})


def final_loss(records: DataFrame, methods, last_step: int) -> DataFrame:
    """Error as a percentage of the true value per depth, on curves whose
    minimum is at the last target step."""
    rows = records.filter((F.col("argmin_round") >= last_step) & (F.col("n_f") == last_step)
                          & F.col("method").isin(*methods))
    rel = F.when(F.col("valid") == 1, F.lit(100.0) * F.col("error") / F.col("true_val"))
    return grouped(rows.withColumn("_rel", rel), ["depth", "method"], [
        F.max(rel).alias("max_pct"), F.sum("valid").alias("n_valid"), F.count(F.lit(1)).alias("n")], {"med_pct": ("_rel", 0.5)})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts, share and whether a value is the most frequent (ties by value)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    top = counts.agg(F.max_by(column, F.struct("n", column)).alias("_top"))
    return counts.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(top)).select(
        column, "n", (F.col("n") / F.col("total")).alias("share"),
        F.col(column).eqNullSafe(F.col("_top")).cast("int").alias("is_top"))


def mode_spread(by_mode: DataFrame, keys, value: str = "med_error") -> DataFrame:
    """Largest minus smallest value across the assumed-limit modes, absolute and
    relative to the smallest."""
    return by_mode.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"),
                                      F.count(F.lit(1)).alias("n_modes")).filter("n_modes >= 2").select(
        *keys, (F.col("hi") - F.col("lo")).alias("spread"),
        F.when(F.col("lo") > 0, F.lit(100.0) * (F.col("hi") - F.col("lo")) / F.col("lo")).alias("spread_pct"))
