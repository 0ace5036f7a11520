"""Preparation of curves: windows, assumed limits, targets, noise, horizons."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.functions.arrays import total
from tailcast.functions.quantiles import grouped
from tailcast.settings import (ASSUMED_MODES, ORACLE_MODES, PERTURB_SCALE,
                               PERTURB_TRIALS, TERCILE_EDGES, WINDOW_LEN)

CURVE_KEYS = ("curve_id", "family", "is_holdout", "run")


# ---- assumed limit -----------------------------------------------------------
def check_mode(mode: str, has_limit: bool = True) -> str:
    if mode not in ASSUMED_MODES:
        raise ValueError(f"unknown assumed-limit mode {mode!r}; expected one of {ASSUMED_MODES}")
    if mode in ORACLE_MODES and not has_limit:
        raise ValueError(f"mode {mode!r} needs the true limit; use 'zero' or 'winmin'")
    return mode


def assumed_limit(mode: str, window_min: Column, true_limit: Column | None = None) -> Column:
    """What a method is told about the limit.  Only half / oracle / double read
    the true limit."""
    check_mode(mode, true_limit is not None)
    if mode == "zero":
        return F.lit(0.0)
    if mode == "winmin":
        return F.greatest(F.lit(0.0), F.lit(0.9) * window_min)
    return true_limit * F.lit({"half": 0.5, "oracle": 1.0, "double": 2.0}[mode])


# ---- draws keyed on the data, not on the partitioning ------------------------
def uniform(*parts: Column) -> Column:
    """A number in [-1, 1) that depends on the key parts only."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double")
    return F.lit(2.0) * h / F.lit(4294967296.0) - F.lit(1.0)


def parts_per_million(level: Column) -> Column:
    return F.round(level * 1e6).cast("long")


# ---- windows -----------------------------------------------------------------
def prefixes(curves: DataFrame, max_depth: int) -> DataFrame:
    """One row per curve with its first ``max_depth`` steps as an array.  The
    filter bounds the array, whatever the length of the curve.  Grouping by the
    curve alone leaves a partitioning that the join with the targets reuses.
    The partition count is explicit: the rows are few but each costs dozens of
    fits, so merging partitions by size would leave most cores idle; and no
    curve has more than ``max_depth`` rows here, so none can be skewed."""
    parts = int(curves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (curves.filter(F.col("step") <= max_depth)
            .repartition(parts, "curve_id")
            .groupBy("curve_id")
            .agg(*[F.min(k).alias(k) for k in CURVE_KEYS[1:]],
                 F.array_sort(F.collect_list(F.struct("step", "value"))).alias("pts"),
                 F.max("step").alias("seen")))


def cut_windows(packed: DataFrame, depths, window_len: int = WINDOW_LEN, noise=(0.0,),
                mode: str = "winmin", true_limit: Column | None = None) -> DataFrame:
    """Explode packed prefixes into one row per (curve, depth, noise): steps and
    values of the last ``window_len`` steps up to the depth, with the noise
    applied, and the summaries every method may use."""
    level = F.explode(F.array(*[F.lit(float(s)) for s in noise])).alias("noise")
    depth = F.explode(F.array(*[F.lit(int(d)) for d in depths])).alias("depth")
    rows = packed.select("*", depth).filter(F.col("depth") <= F.col("seen")).select("*", level)
    inside = F.filter("pts", lambda p: p["step"].between(F.col("depth") - window_len + 1, F.col("depth")))
    rows = rows.withColumn("_w", inside).filter(F.size("_w") > 0)
    ppm = parts_per_million(F.col("noise"))
    value = F.when(F.col("noise") == 0.0, F.transform("_w", lambda p: p["value"])).otherwise(
        F.transform("_w", lambda p: p["value"] * (
            F.lit(1.0) + F.col("noise") * uniform(F.col("curve_id"), ppm, p["step"]))))
    rows = (rows.withColumn("xs", F.transform("_w", lambda p: p["step"].cast("double")))
            .withColumn("ys", value).drop("_w", "pts", "seen"))
    rows = summarise(rows)
    return rows.withColumns({
        "L_true": F.lit(None).cast("double") if true_limit is None else true_limit,
        "assumed_mode": F.lit(mode),
        "L_hat": assumed_limit(mode, F.col("min_v"), true_limit)})


def summarise(rows: DataFrame) -> DataFrame:
    """Last, mean, smallest and largest value of each window."""
    return rows.withColumns({
        "last_v": F.get("ys", F.size("ys") - 1),
        "mean_v": total(F.col("ys")) / F.size("ys"),
        "min_v": F.array_min("ys"),
        "max_v": F.array_max("ys")})


def perturbed(windows: DataFrame, trials: int = PERTURB_TRIALS, scale: float = PERTURB_SCALE) -> DataFrame:
    """``trials`` copies of each window, every value multiplied by 1 + scale * u.
    The draws are keyed on (curve, depth, noise, trial, step): all methods and
    targets of a window share them, in any partitioning."""
    rows = windows.select("*", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    return summarise(rows.withColumn("ys", _perturbed(F.col("trial"), scale)))


def _perturbed(trial: Column, scale: float) -> Column:
    ppm = parts_per_million(F.col("noise"))
    return F.zip_with("ys", "xs", lambda v, x: v * (F.lit(1.0) + F.lit(scale) * uniform(
        F.col("curve_id"), F.col("depth"), ppm, trial, x.cast("int"))))


def perturbed_values(trials: int = PERTURB_TRIALS, scale: float = PERTURB_SCALE) -> Column:
    """The values of all copies of ``perturbed`` in one array, copy after copy."""
    return F.flatten(F.array(*[_perturbed(F.lit(k), scale) for k in range(1, trials + 1)]))


def shifted(windows: DataFrame, shifts=(0, 1, 2), min_points: int = 3) -> DataFrame:
    """Windows with the first points dropped.  Negative shifts leave a window
    unchanged, so they are the shift 0 with a larger weight (see diagnostics)."""
    rows = windows.select("*", F.explode(F.array(*[F.lit(int(s)) for s in shifts])).alias("shift"))
    rows = rows.withColumns({
        "xs": F.slice("xs", F.col("shift") + 1, F.greatest(F.size("xs") - F.col("shift"), F.lit(0))),
        "ys": F.slice("ys", F.col("shift") + 1, F.greatest(F.size("ys") - F.col("shift"), F.lit(0)))})
    return summarise(rows.filter(F.size("ys") >= min_points))


# ---- targets -----------------------------------------------------------------
def step_targets(curves: DataFrame, targets) -> DataFrame:
    """Per curve the true values at the asked steps, as a short array."""
    return (curves.filter(F.col("step").isin(*[int(t) for t in targets]))
            .groupBy("curve_id")
            .agg(F.array_sort(F.collect_list(F.struct(
                F.col("step").alias("n_f"), F.col("value").alias("true_val")))).alias("targets")))


def gap_horizons(curves: DataFrame, depths, fractions, true_limit: float = 0.0,
                 cap: int | None = None) -> DataFrame:
    """First step beyond each depth where the gap to the limit has fallen to the
    fraction g of the gap at the depth; else the last step (not above ``cap``, where one is given),
    flagged ``capped``.  One pass of conditional minima per curve."""
    gap = F.col("value") - F.lit(true_limit)
    anchors = (curves.filter(F.col("step").isin(*depths)).groupBy("curve_id")
               .agg(*[F.max(F.when(F.col("step") == d, gap)).alias(f"_gap{d}") for d in depths]))
    pairs = [(d, k, float(g)) for d in depths for k, g in enumerate(fractions)]
    hits = ((curves if cap is None else curves.filter(F.col("step") <= cap)).join(anchors, "curve_id").groupBy("curve_id", "family")
            .agg(F.max("step").alias("_last"),
                 *[F.max(f"_gap{d}").alias(f"gap{d}") for d in depths],
                 *[F.min(F.when((F.col("step") > d) & (gap <= F.lit(g) * F.col(f"_gap{d}")), F.col("step")))
                   .alias(f"hit{d}_{k}") for d, k, g in pairs]))
    cells = F.explode(F.array(*[F.struct(
        F.lit(d).alias("depth"), F.lit(g).alias("target_g"), F.col(f"gap{d}").alias("gap_obs"),
        F.col(f"hit{d}_{k}").alias("hit")) for d, k, g in pairs])).alias("c")
    rows = (hits.select("curve_id", "family", "_last", cells).select("curve_id", "family", "_last", "c.*")
            .filter(F.col("gap_obs").isNotNull() & (F.col("_last") > F.col("depth"))))
    flat = F.col("gap_obs") <= 0
    rows = rows.select(
        "curve_id", "family", "depth", "target_g", "gap_obs", flat.alias("degenerate"),
        F.when(flat, F.col("depth") + 1).otherwise(F.coalesce("hit", "_last")).alias("n_f"),
        F.when(flat, F.lit(0)).otherwise(F.col("hit").isNull().cast("int")).alias("capped"))
    truth = curves.select("curve_id", F.col("step").alias("n_f"), F.col("value").alias("true_val"))
    return (rows.join(truth, ["curve_id", "n_f"], "left")
            .withColumn("gap_f", F.col("true_val") - F.lit(true_limit))
            .withColumn("achieved_g", F.when(~F.col("degenerate"), F.col("gap_f") / F.col("gap_obs"))))


def nest_horizons(horizons: DataFrame) -> DataFrame:
    """Horizons of one curve as one array (depths x fractions entries)."""
    return horizons.groupBy("curve_id").agg(F.collect_list(F.struct(
        "depth", "target_g", "n_f", "achieved_g", "capped", "true_val")).alias("targets"))


def horizon_table(horizons: DataFrame, fractions) -> DataFrame:
    """Family x fraction: the median first step that reaches it (families here
    are groups of curves, so the middle curve stands for the family)."""
    middle = grouped(horizons, ["family", "depth", "target_g"], [], {"m": ("n_f", 0.5)})
    return middle.groupBy("family", "depth").pivot("target_g", [float(g) for g in fractions]).agg(F.max("m"))


# ---- facts about whole curves ------------------------------------------------
def curve_minima(curves: DataFrame, last_step: int | None = None) -> DataFrame:
    """Per curve: number of steps, first step of the minimum, minimum, value at
    the last step (not beyond ``last_step``) and the relative rise up to it."""
    end = F.col("step") if last_step is None else F.when(F.col("step") <= last_step, F.col("step"))
    facts = curves.groupBy("curve_id").agg(
        *[F.min(k).alias(k) for k in CURVE_KEYS[1:]],
        F.max("step").alias("n_rounds"),
        F.min(F.struct("value", "step")).alias("_m"),
        F.max(F.struct(end.alias("e"), F.col("value"))).alias("_e"))
    return facts.select(
        *CURVE_KEYS, "n_rounds", F.col("_m.step").alias("argmin_round"), F.col("_m.value").alias("min_value"),
        F.col("_e.value").alias("value_at_round"), F.col("_e.e").alias("at_round"),
        F.when(F.abs("_m.value") > 1e-12, (F.col("_e.value") - F.col("_m.value")) / F.col("_m.value"))
        .alias("rise_from_min"))


def lower_envelope(curves: DataFrame) -> DataFrame:
    """Running minimum of each curve, rescaled to gap 0.7 at the start and 0 at
    the end.  The running minimum is taken inside blocks of 1,000 steps and then
    over the block minima, so no window holds a whole long curve."""
    d = curves.withColumn("_b", F.floor(F.col("step") / 1000))
    inside = Window.partitionBy("curve_id", "_b").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("curve_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (d.groupBy("curve_id", "_b").agg(F.min("value").alias("_bm"))
              .withColumn("_prev", F.min("_bm").over(before)).drop("_bm"))
    env = (d.join(blocks, ["curve_id", "_b"])
           .select(*curves.columns, F.least(F.min("value").over(inside), F.col("_prev")).alias("envelope")))
    ends = env.groupBy("curve_id").agg(F.min_by("envelope", "step").alias("_first"),
                                       F.max_by("envelope", "step").alias("_last"))
    return (env.join(ends, "curve_id")
            .withColumn("profile", F.lit(0.7) * F.try_divide(
                F.col("envelope") - F.col("_last"), F.col("_first") - F.col("_last")))
            .drop("_first", "_last"))


NEIGHBOUR_BLOCK = 100_000      # steps of a block


def with_neighbours(curves: DataFrame, back: int = 1, ahead: int = 0, block: int = NEIGHBOUR_BLOCK) -> DataFrame:
    """Adds ``before`` and ``after``: arrays of the nearest (step, value) of a curve before and after each
    row, nearest first, at most ``back`` and ``ahead`` of them.

    A curve is cut into blocks of steps.  Inside a block neighbours come from a window; each block then hands its
    first and last rows on to the next blocks, and only rows near a border use them.  A block may hold fewer rows
    than are asked for, so the rows that are handed on are collected over as many blocks; no task holds a curve."""
    d = curves.withColumn("_b", F.floor(F.col("step") / block))
    point = F.struct("step", "value")
    w = Window.partitionBy("curve_id", "_b").orderBy("step")
    near = lambda fn, n: F.array_compact(F.array(*[fn(point, i).over(w) for i in range(1, n + 1)])) if n else F.array().cast("array<struct<step:int,value:double>>")
    d = d.withColumns({"before": near(F.lag, back), "after": near(F.lead, ahead), "_first": F.row_number().over(w), "_own": point})
    d = d.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("curve_id", "_b")))
    most = max(back, ahead)
    edges = d.filter((F.col("_first") <= most) | (F.col("_first") > F.col("_size") - most)).groupBy("curve_id", "_b").agg(
        F.array_sort(F.collect_list("_own")).alias("_rows"))          # at most 2 * most rows of a block
    along = Window.partitionBy("curve_id").orderBy("_b")
    halo = {}
    if back:
        lags = F.flatten(F.array_compact(F.array(*[F.reverse(_last(F.lag("_rows", i).over(along), back)) for i in range(1, back + 1)])))
        halo["_left"] = F.slice(lags, 1, back)
    if ahead:
        leads = F.flatten(F.array_compact(F.array(*[F.slice(F.lead("_rows", i).over(along), 1, ahead) for i in range(1, ahead + 1)])))
        halo["_right"] = F.slice(leads, 1, ahead)
    d = d.join(edges.withColumns(halo).drop("_rows"), ["curve_id", "_b"])
    out = {}
    if back:
        out["before"] = F.slice(F.concat("before", "_left"), 1, back)
    if ahead:
        out["after"] = F.slice(F.concat("after", "_right"), 1, ahead)
    return d.withColumns(out).drop("_b", "_first", "_own", "_size", "_left", "_right")


def _last(rows: Column, n: int) -> Column:
    return F.slice(rows, F.greatest(F.size(rows) - n + 1, F.lit(1)), F.lit(n))


def interpolate(curves: DataFrame, grid, block: int = NEIGHBOUR_BLOCK) -> DataFrame:
    """Linear interpolation at the grid positions, the first value to the left
    and 0 to the right of the curve.  Segments and grid positions meet by (curve, block of steps), so the pieces of
    a long curve are spread; a segment that crosses borders stands in each block that it touches."""
    seg = with_neighbours(curves.select("curve_id", "step", "value"), 0, 1, block)
    nxt = F.get("after", F.lit(0))
    seg = seg.select("curve_id", "step", "value", nxt["step"].alias("nstep"), nxt["value"].alias("nvalue"))
    at_block = lambda v: F.floor(v / block)
    seg = seg.withColumn("_b", F.explode(F.sequence(at_block(F.col("step")), at_block(F.coalesce("nstep", "step")))))
    ends = curves.groupBy("curve_id").agg(F.min("step").alias("lo"), F.max("step").alias("hi"),
                                          F.min_by("value", "step").alias("first_value"))
    points = ends.select("curve_id", "lo", "hi", "first_value",
                         F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("x")).withColumn("_b", at_block(F.col("x")))
    at = points.join(seg, (points.curve_id == seg.curve_id) & (points._b == seg._b) & (seg.step <= points.x)
                     & ((points.x < seg.nstep) | (seg.nstep.isNull() & (points.x == seg.step))), "left")
    inside = F.when(F.col("nstep").isNull(), F.col("value")).otherwise(
        F.col("value") + (F.col("nvalue") - F.col("value")) * (F.col("x") - F.col("step"))
        / (F.col("nstep") - F.col("step")))
    return at.select(points.curve_id, "x", F.when(F.col("x") < F.col("lo"), F.col("first_value"))
                     .when(F.col("x") > F.col("hi"), F.lit(0.0)).otherwise(inside).alias("value"))


# ---- classes -----------------------------------------------------------------
def noise_class(noise: Column, intrinsic: Column | None = None) -> Column:
    base = F.when(intrinsic, "intrinsic").otherwise("noise-free") if intrinsic is not None else F.lit("noise-free")
    return F.when(noise == 0.0, base).otherwise(F.concat(F.lit("sigma="), noise.cast("string")))


def noise_class_order(name: Column) -> Column:
    """Numeric order of the noise classes: free, intrinsic, by level, all."""
    level = F.regexp_extract(name, "^sigma=(.*)$", 1)
    return (F.when(name == "noise-free", 0.0).when(name == "intrinsic", 1.0).when(name == "all", 1e9)
            .otherwise(F.lit(2.0) + F.try_to_number(level, F.lit("0.999999")).cast("double")))


def tercile(limit: Column) -> Column:
    """Left-closed bins; a value on the last edge falls outside."""
    a, b, c, d = TERCILE_EDGES
    return (F.when((limit >= a) & (limit < b), "low").when((limit >= b) & (limit < c), "mid")
            .when((limit >= c) & (limit < d), "high"))


def resolve_families(families: DataFrame, core=None, holdout=None, include_holdout: bool = True) -> DataFrame:
    """Core families, then hold-out families; unknown names are an error.
    ``families`` has one row per family (family, is_holdout)."""
    known = {r.family: r.is_holdout for r in families.select("family", "is_holdout").distinct().collect()}
    for names, flag in ((core, 0), (holdout, 1)):
        bad = [n for n in (names or []) if known.get(n) != flag]
        if bad:
            raise ValueError(f"not {'hold-out' if flag else 'core'} families: {bad}")
    keep = [n for n, h in known.items() if (
        (h == 0 and (core is None or n in core))
        or (h == 1 and include_holdout and (holdout is None or n in holdout)))]
    return families.filter(F.col("family").isin(*keep))
