"""Rank statistics and resampling, all as aggregates."""
from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.functions.quantiles import bucket_of, grouped, same
from tailcast.functions.special import normal_two_sided, t_two_sided
from tailcast.operators.ranking import average_rank
from tailcast.operators.scoring import skill, zero_denominator
from tailcast.session import for_every_task, settled
from tailcast.settings import FEATURES, REJECT_THRESHOLDS

# executors need not have this package installed: functions that run there travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


SALTS = 64                     # parts of a bucket that holds one value many times
HEAVY = 10_000                 # rows from which such a bucket is dealt out
OTHERS = 1 << 33               # a part's number: group, then bucket (25 bits), then salt (8 bits)


def _ranked(rows: DataFrame, source: DataFrame, value: str, carry, whole: bool) -> DataFrame:
    """Rows with the average rank of ``value`` within their group ``_g`` (``_f<value>``) and, where asked for, within all groups of
    their ``_o`` (``_w<value>``).  ``source`` has the same values and may be read instead of ``rows`` to count them.

    Buckets are counted first, so a rank is the count of earlier buckets and the place inside the own one.  Only the value
    and ``carry`` travel, once, to their bucket; a bucket of one value needs no order, and its rows go anywhere."""
    bucket = bucket_of(F.col(value))
    hist = settled(source.groupBy("_g", "_o", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")), "rank-buckets")

    def places(table, group, tag):
        before = F.sum("_n").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        return table.select(group, "_b", F.coalesce(before, F.lit(0)).alias(f"_before{tag}"), F.when(F.col("_lo") == F.col("_hi"), F.col("_n")).alias(f"_one{tag}"))

    every = hist.groupBy("_o", "_b").agg(F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    heavy = every.filter((F.col("_lo") == F.col("_hi")) & (F.col("_n") > HEAVY)).select("_o", "_b", F.lit(1).alias("_heavy"))
    salt = F.when(F.col("_heavy") == 1, F.pmod(F.xxhash64(*carry), F.lit(SALTS))).otherwise(0)
    met = rows.withColumn("_b", bucket).join(F.broadcast(heavy), ["_o", "_b"], "left")
    part = F.col("_o") * F.lit(OTHERS) + (F.col("_b") + F.lit(1 << 24)) * F.lit(256) + salt
    met = met.select(part.cast("long").alias("_p"), "_g", value, *carry)
    sets = ([("w", ["_p"], "_o")] if whole else []) + [("f", ["_p", "_g"], "_g")]     # the wider one first: its parts hold the others'
    for tag, by, _ in sets:
        inside = Window.partitionBy(*by).orderBy(value)
        met = met.withColumns({f"_rank{tag}": F.rank().over(inside), f"_ties{tag}": F.count(F.lit(1)).over(inside.rangeBetween(0, 0))})
    met = met.withColumns({"_o": F.floor(F.col("_p") / F.lit(OTHERS)).cast("long"), "_b": F.floor(F.col("_p") % F.lit(OTHERS) / F.lit(256)).cast("long") - F.lit(1 << 24)})
    for tag, _, group in sets:
        table = settled(places(hist if tag == "f" else every, group, tag), "rank-places")
        met = met.join(for_every_task(table) or table, [group, "_b"])
        own = F.when(F.col(f"_one{tag}").isNotNull(), (F.col(f"_one{tag}") + 1) / 2.0).otherwise(F.col(f"_rank{tag}") + (F.col(f"_ties{tag}") - 1) / 2.0)
        met = met.withColumn(f"_{tag}{value}", F.col(f"_before{tag}") + own)
    return met.select("_g", "_o", *carry, *[f"_{tag}{value}" for tag, *_ in sets])


def spearman(df: DataFrame, keys, x: str, y: str, fewest: int = 10, total: str | None = None, label: str = "ALL") -> DataFrame:
    """Rank correlation per group over complete pairs.  Ties share their average
    rank; infinities are values.  With ``total``, one of the keys, also over all its groups together, under ``label``.

    A pair travels twice, to the bucket of its x and to that of its y, whatever the number of
    rankings it stands in; no group is sorted in one task."""
    keys = list(keys)
    outer = [k for k in keys if k != total]
    pairs = df.select(*keys, (F.col(x).cast("double") + F.lit(0.0)).alias("x"), (F.col(y).cast("double") + F.lit(0.0)).alias("y")).filter(
        reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in ("x", "y", *outer)]))
    groups = pairs.select(*keys).distinct()
    groups = settled(groups.select(*keys, F.row_number().over(Window.orderBy(*keys)).cast("long").alias("_g"),
                                   (F.dense_rank().over(Window.orderBy(*outer)) if outer else F.lit(1)).cast("long").alias("_o")), "rank-groups")
    rows = pairs.alias("r").join(F.broadcast(groups).alias("w"), same("r", "w", keys)).select("_g", "_o", "r.x", "r.y")
    fx, wx = "_fx", "_wx"
    ranked = _ranked(_ranked(rows, rows, "x", ["y"], bool(total)), rows, "y", [fx, wx] if total else [fx], bool(total))

    def sums(tag):
        a, b = F.col(f"_{tag}x"), F.col(f"_{tag}y")
        return {f"_{tag}{name}": v for name, v in (("sa", a), ("sb", b), ("saa", a * a), ("sbb", b * b), ("sab", a * b))}

    def result(s, tag, by):
        n, sa, sb, saa, sbb, sab = (F.col("n"), *[F.col(f"_{tag}{name}") for name in ("sa", "sb", "saa", "sbb", "sab")])
        va, vb = n * saa - sa * sa, n * sbb - sb * sb
        rho = F.when((va > 0) & (vb > 0), (n * sab - sa * sb) / (F.sqrt(va) * F.sqrt(vb)))
        return s.select(*by, F.when(n >= fewest, rho).alias("spearman_r"), n.alias("n"))

    wanted = sums("f") | (sums("w") if total else {})
    s = ranked.groupBy("_g", "_o").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in wanted.items()])
    s = settled(s.join(F.broadcast(groups.drop("_o")), "_g"), "rank-sums")
    out = result(s, "f", keys)
    if not total:
        return out
    over = s.groupBy("_o").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums("w")], *[F.min(k).alias(k) for k in outer])
    return out.filter(F.col(total).isNotNull()).unionByName(result(over.withColumn(total, F.lit(label)), "w", keys))


def spearman_p(table: DataFrame) -> DataFrame:
    """Two-sided p-value of a rank correlation: Student's t with n - 2 degrees of freedom.  A correlation of one has 0."""
    r, n = F.col("spearman_r"), F.col("n")
    inside = F.when(F.abs(r) < 1, r)
    t = inside * F.sqrt((n - 2) / ((F.lit(1.0) - inside) * (F.lit(1.0) + inside)))
    return table.withColumn("p_value", F.when(r.isNotNull() & (n > 2), F.when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided(t, n - 2))))


def with_totals(df: DataFrame, key: str, label: str = "ALL") -> DataFrame:
    """Each row once under its own key and once under the total."""
    rest = [c for c in df.columns if c != key]
    return df.select(F.explode(F.array(F.col(key), F.lit(label))).alias(key), *rest)


def diagnostic_correlations(records: DataFrame, diagnostics=("perturb_iqr", "shift_iqr"), fewest: int = 10) -> DataFrame:
    long = records.select("method", "error", *diagnostics).unpivot(["method", "error"], list(diagnostics), "diagnostic", "dvalue")
    return spearman(long, ["method", "diagnostic"], "dvalue", "error", fewest, total="method").filter(F.col("n") >= fewest)


def depth_reliability(records: DataFrame, diagnostics=("perturb_iqr", "shift_iqr"), fewest: int = 5, high: float = 0.05) -> DataFrame:
    keys = ["depth", "method", "diagnostic"]
    long = records.select("depth", "method", "error", "catastrophic", *diagnostics).unpivot(
        ["depth", "method", "error", "catastrophic"], list(diagnostics), "diagnostic", "dvalue")
    rho = spearman(long, keys, "dvalue", "error", fewest).filter(F.col("n") >= fewest)
    hi = F.coalesce(F.col("dvalue") > high, F.lit(False))
    prec = long.groupBy(*keys).agg(F.try_divide(F.count(F.when(hi & (F.col("catastrophic") == 1), 1)), F.count(F.when(hi, 1)))
                                   .alias("hi_iqr_prec"))
    return rho.join(prec, keys, "left")


def rejection_rules(records: DataFrame, diagnostics=("perturb_iqr", "shift_iqr"), thresholds=REJECT_THRESHOLDS, fewest: int = 10) -> DataFrame:
    """Reject above a threshold: precision and recall of the catastrophe, fire
    rate and mean error saved.  The thresholds are crossed in as an array."""
    long = records.select("method", "error", "curr_err", "catastrophic", *diagnostics).unpivot(
        ["method", "error", "curr_err", "catastrophic"], list(diagnostics), "diagnostic", "dvalue").filter("dvalue IS NOT NULL")
    # one aggregate column per threshold: rows are not multiplied
    keys = ["diagnostic", "method"]
    aggs = [F.count(F.lit(1)).alias("n_total"), F.sum("catastrophic").alias("n_bad")]
    for i, t in enumerate(thresholds):
        fire = F.col("dvalue") > t
        aggs += [F.count(F.when(fire, 1)).alias(f"f{i}"), F.count(F.when(fire & (F.col("catastrophic") == 1), 1)).alias(f"p{i}"),
                 F.avg(F.when(fire & F.col("error").isNotNull(), F.col("curr_err") - F.col("error"))).alias(f"s{i}")]
    wide = long.groupBy(*keys).agg(*aggs).filter(F.col("n_total") >= fewest)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"f{i}").alias("n_fire"), F.col(f"p{i}").alias("hits"),
                                        F.col(f"s{i}").alias("saved")) for i, t in enumerate(thresholds)])).alias("r")
    r = wide.select(*keys, "n_total", "n_bad", rows).select(*keys, "n_total", "n_bad", "r.*").filter("n_fire > 0")
    return r.select(*keys, "threshold", "n_fire", "n_total", F.round(F.col("n_fire") / F.col("n_total"), 3).alias("fire_rate"),
                    F.round(F.col("hits") / F.col("n_fire"), 3).alias("precision"),
                    F.round(F.try_divide(F.col("hits"), F.col("n_bad")), 3).alias("recall"), F.round("saved", 4).alias("mean_err_saved"))


def richardson_targets(records: DataFrame, cell=("family", "is_holdout", "depth", "noise", "target_g"), method: str = "richardson_1") -> DataFrame:
    """Per cell: median error relative to the last value, log of the median
    error (-inf for an exact zero) and zero-denominator counts."""
    ok = F.col("valid") == 1
    rows = records.filter(F.col("method") == method).withColumns({
        "_ratio": F.when(ok, skill(F.col("error"), F.col("E_last"))), "_err": F.when(ok, F.col("error")),
        "_zero": zero_denominator(F.col("error"), F.col("E_last")).cast("int")})
    out = grouped(rows, cell, [F.max("capped").alias("capped"), F.count(F.when(ok, 1)).alias("n_valid_R"), F.count(F.lit(1)).alias("n_total"),
                               F.sum("_zero").alias("n_zero_denominator"), F.max("_zero").alias("zero_denominator_cell")],
                  {"R_R_med": ("_ratio", 0.5), "med_error_R": ("_err", 0.5)})
    return out.withColumn("log_med_error_R", F.when(F.col("med_error_R") == 0, F.lit(float("-inf"))).otherwise(F.ln("med_error_R")))


def denominator_counts(targets: DataFrame) -> DataFrame:
    return targets.filter("capped = 0").groupBy("target_g").agg(
        F.sum("n_zero_denominator").alias("n_records_zero_denominator"), F.sum("zero_denominator_cell").alias("n_cells_affected"),
        F.sum("n_total").alias("n_records_total"), F.count(F.lit(1)).alias("n_cells_total"))


def phase_diagram(targets: DataFrame) -> DataFrame:
    return targets.filter("capped = 0").groupBy("target_g", "depth", "noise").agg(
        F.percentile("R_R_med", F.lit(0.5)).alias("R_R_med"), F.count(F.lit(1)).alias("n_cells"))


def feature_correlations(targets: DataFrame, feats: DataFrame, fewest: int = 15) -> DataFrame:
    """Rank correlation of each cell feature with both targets, per family and
    over all, on cells where feature and targets are present."""
    base = targets.filter("capped = 0").join(feats, ["family", "depth", "noise"], "left")
    long = with_totals(base.select("family", "target_g", "R_R_med", "log_med_error_R", *FEATURES), "family").unpivot(
        ["family", "target_g", "R_R_med", "log_med_error_R"], list(FEATURES), "feature", "fvalue")
    keys = ["family", "target_g", "feature"]
    whole = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    ok = long.filter("fvalue IS NOT NULL AND R_R_med IS NOT NULL AND log_med_error_R IS NOT NULL")
    a = spearman(ok, keys, "fvalue", "R_R_med", fewest).withColumnsRenamed({"spearman_r": "spearman_vs_RR", "n": "n_cells"})
    b = spearman(ok, keys, "fvalue", "log_med_error_R", fewest).select(*keys, F.col("spearman_r").alias("spearman_vs_log_err"))
    return whole.join(a, keys, "left").join(b, keys, "left").select(
        *keys, F.round("spearman_vs_RR", 4).alias("spearman_vs_RR"), F.round("spearman_vs_log_err", 4).alias("spearman_vs_log_err"),
        F.coalesce("n_cells", F.lit(0)).alias("n_cells"), (F.col("_all") - F.coalesce("n_cells", F.lit(0))).alias("n_dropped"))


def auc_fail_vs_success(df: DataFrame, keys, value: str, fail: str) -> DataFrame:
    """P(value of a failing row > value of a succeeding row), ties one half, from the rank sum, and the
    two-sided p-value of the rank-sum test: normal, variance corrected for ties, half a rank of continuity.
    NULL p-value where a side is empty or all values are equal."""
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value, F.col(fail).cast("int").alias("_f"))
    ranks = average_rank(rows, keys, value, "_r").drop("_c")
    per_value = rows.groupBy(*keys, value).agg(F.sum("_f").alias("_nf"), F.count(F.lit(1)).alias("_n"))
    j = per_value.join(ranks, [*keys, value]) if keys else per_value.join(ranks, value)
    size = F.col("_n").cast("double")
    s = j.groupBy(*keys).agg(F.sum("_nf").alias("n_fail"), (F.sum("_n") - F.sum("_nf")).alias("n_succ"),
                             F.sum(F.col("_nf") * F.col("_r")).alias("_rs"), F.sum(size * size * size - size).alias("_ties"))
    a, b = F.col("n_fail").cast("double"), F.col("n_succ").cast("double")
    u, n = F.col("_rs") - a * (a + 1) / 2.0, a + b
    spread = F.sqrt(a * b / 12.0 * (n + 1.0 - F.try_divide(F.col("_ties"), n * (n - 1.0))))
    z = F.try_divide(F.abs(u - a * b / 2.0) - 0.5, spread)
    p = F.least(normal_two_sided(F.greatest(z, F.lit(0.0))), F.lit(1.0))
    return s.withColumns({"auc": F.try_divide(u, a * b), "p_value": F.when((a > 0) & (b > 0) & (spread > 0), p)}).drop("_rs", "_ties")


def ranking_agreement(core: DataFrame, hold: DataFrame) -> DataFrame:
    """Rank correlation of two rankings over the methods ranked in both."""
    c = core.filter("accel_rank IS NOT NULL").select("target_g", "method", F.col("accel_rank").cast("double").alias("rc"))
    h = hold.filter("accel_rank IS NOT NULL").select("target_g", "method", F.col("accel_rank").cast("double").alias("rh"))
    return spearman(c.join(h, ["target_g", "method"]), ["target_g"], "rc", "rh", 2)


DRAWS_PER_ROW = 50             # draws that one row of the resampling table stands for
PACKED_CELLS = 20_000          # cells of which one copy may travel with each such row


def draw_picks(draws: int, k: int) -> Column:
    """Family numbers (from 0) that the draws of a block take: element d * k + slot - 1 of the array belongs to draw
    ``first`` + d.  They depend on (draw, slot) only."""
    per_slot = lambda b, slot: F.conv(F.substring(F.md5(F.concat_ws("|", b.cast("string"), slot.cast("string"))), 1, 8), 16, 10).cast("long") % k
    some = F.sequence(F.col("first"), F.least(F.col("first") + DRAWS_PER_ROW, F.lit(draws)) - 1)
    return F.flatten(F.transform(some, lambda b: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda slot: per_slot(b, slot).cast("int"))))


def weighted_medians(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Median of each row of ``weights`` over ascending ``values``: one cumulative count matrix, both middles by counting."""
    upto = np.cumsum(weights, axis=1)
    n = upto[:, -1] if upto.shape[1] else np.zeros(len(weights), np.int64)
    low, high = ((upto <= at[:, None]).sum(axis=1) for at in ((n - 1) // 2, n // 2))
    pad = np.append(values, np.nan)
    return np.where(n > 0, (pad[np.minimum(low, len(values))] + pad[np.minimum(high, len(values))]) / 2, np.nan)


def _resample(batches):
    """Statistics of every draw of a block and target: (target_g, b, win_rate, lower_share, med_diff)."""
    for batch in batches:
        out = {"target_g": [], "b": [], "win_rate": [], "lower_share": [], "med_diff": []}
        for r in range(len(batch)):
            k, first = batch.column("k")[r].as_py(), batch.column("first")[r].as_py()
            picks = batch.column("picks")[r].values.to_numpy()
            draws = len(picks) // k
            times = np.bincount(np.repeat(np.arange(draws), k) * k + picks, minlength=draws * k).reshape(draws, k)
            cells = {n: batch.column(n)[r].values.to_numpy(zero_copy_only=False).astype(float) for n in ("i", "target_g", "win", "n", "lower", "diff")}
            for target in np.unique(cells["target_g"]):
                at = cells["target_g"] == target
                family, win, n, lower, diff = (cells[c][at] for c in ("i", "win", "n", "lower", "diff"))
                family = family.astype(int)
                # additive statistics per family, then one product with the count matrix
                add = lambda v: np.bincount(family, weights=np.nan_to_num(v), minlength=k)
                has = np.bincount(family, minlength=k)
                cell_count = times @ has
                share = lambda v, of: np.where(times @ add(~np.isnan(v)) > 0, (times @ add(v)) / (times @ of), np.nan)
                known = ~np.isnan(diff)
                order = np.argsort(diff[known], kind="stable")
                with np.errstate(divide="ignore", invalid="ignore"):
                    rates = share(win, add(n)), share(lower, has)
                med = weighted_medians(diff[known][order], times[:, family[known][order]])
                here = cell_count > 0
                out["target_g"] += [float(target)] * int(here.sum())
                out["b"] += (first + np.flatnonzero(here)).tolist()
                for name, v in zip(("win_rate", "lower_share", "med_diff"), (*rates, med)):
                    out[name] += [None if np.isnan(x) else float(x) for x in v[here]]
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("target_g", pa.float64()), ("b", pa.int64()), ("win_rate", pa.float64()), ("lower_share", pa.float64()), ("med_diff", pa.float64())]))


def _drawn_by_matrix(cells: DataFrame, fam: DataFrame, draws: int, k: int) -> DataFrame:
    """All draws from one copy of the cells per block of draws: rows are blocks, not draws x cells."""
    numbered = cells.join(fam, "family").select((F.col("i") - 1).alias("i"), "target_g", *[F.col(c).cast("double").alias(c) for c in ("win", "n", "lower", "diff")])
    names = ("i", "target_g", "win", "n", "lower", "diff")
    packed = numbered.agg(F.collect_list(F.struct(*names)).alias("cells")).select(*[F.col(f"cells.{n}").alias(n) for n in names])
    spark = cells.sparkSession
    blocks = spark.range(0, draws, DRAWS_PER_ROW).select(F.col("id").alias("first")).select("first", F.lit(k).alias("k"), draw_picks(draws, k).alias("picks"))
    return blocks.crossJoin(F.broadcast(packed)).mapInArrow(_resample, "target_g double, b bigint, win_rate double, lower_share double, med_diff double")


def _drawn_by_rows(cells: DataFrame, fam: DataFrame, draws: int, k: int) -> DataFrame:
    """The same for tables beyond ``PACKED_CELLS``: draws x families rows meet the cells."""
    base = cells.sparkSession.range(draws).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("slot"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("b").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long")
    taken = (base.withColumn("i", (h % k + 1).cast("int")).join(fam, "i").groupBy("b", "family").agg(F.count(F.lit(1)).alias("times")))
    rows = settled(taken.join(cells, "family").select("target_g", "b", "times", "win", "n", "lower", "diff"), "draw-rows")
    times = F.col("times")
    return grouped(rows, ["target_g", "b"], [
        (F.sum(times * F.col("win")) / F.sum(times * F.col("n"))).alias("win_rate"), (F.sum(times * F.col("lower")) / F.sum(times)).alias("lower_share")],
        {"med_diff": ("diff", 0.5)}, weight="times")


def cluster_bootstrap(cells: DataFrame, families: DataFrame, draws: int = 5000) -> DataFrame:
    """Percentile intervals over resampled families.

    ``cells``: one row per cell (group keys ``target_g``, ``family``) with the additive statistics of the
    cell.  Families are numbered; draw (b, slot) takes the family md5(b, slot) mod k, the same for every
    statistic.  Up to ``PACKED_CELLS`` cells, a block of draws is one row: how often each draw takes each family is a
    matrix, rates are its products with the families' sums, and medians come from its running counts
    along the sorted cells.  Larger tables meet draws x families rows in a join; results are the same."""
    cells = settled(cells, "bootstrap-cells")
    fam = settled(families.select("family", F.row_number().over(Window.orderBy("family")).alias("i")), "bootstrap-families")
    k = fam.count()
    names = ("win_rate", "lower_share", "med_diff")
    if not k:
        draw = _drawn_by_rows(cells, fam, 0, 1)
    else:
        draw = (_drawn_by_matrix if cells.count() <= PACKED_CELLS else _drawn_by_rows)(cells, fam, draws, k)
    draw = settled(draw, "bootstrap-draws")
    ends = grouped(draw, ["target_g"], [F.count(F.lit(1)).alias("_n")], {f"{n}_{e}": (n, p) for n in names for e, p in (("lo", 0.025), ("hi", 0.975))})
    point = grouped(cells, ["target_g"], [(F.sum("win") / F.sum("n")).alias("win_rate"), F.avg("lower").alias("lower_share"), F.count(F.lit(1)).alias("n_cells")],
                    {"med_diff": ("diff", 0.5)})
    return point.join(ends, "target_g").select("target_g", "n_cells", *names, *[f"{n}_{e}" for n in names for e in ("lo", "hi")])
