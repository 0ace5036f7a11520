"""Ranks, picks and ordered lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.functions.arrays import finite
from tailcast.operators.panels import family_table, mean_rate, rate4
from tailcast.settings import (CONSERVATIVE_METHOD, DEFAULT_METHOD, LEAD_TOP_CORE, LEAD_TOP_HOLD,
                               LEAD_TOP_WIN, RANK_MIN_VALID)


def metric_key(metric: str, digits: int | None) -> Column:
    """Sort key of a metric; optional rounding makes numerical ties real ties,
    which the name then breaks."""
    return F.col(metric) if digits is None else F.round(metric, digits)


def assign_ranks(df: DataFrame, metric: str = "med_error", groups=("target_g",), floor: float = RANK_MIN_VALID,
                 ascending: bool = True, digits: int | None = None) -> DataFrame:
    """Rank 1..n by (metric, name) among non-oracle methods with a finite metric
    and validity at or above the floor; other rows stay with a NULL rank."""
    ok = F.coalesce(finite(F.col(metric)) & (F.col("valid_rate") >= floor), F.lit(False))
    if "is_oracle" in df.columns:
        ok = ok & (F.col("is_oracle") == 0)
    key = metric_key(metric, digits)
    d = df.withColumn("rank_eligible", ok.cast("int"))
    w = Window.partitionBy(*groups, "rank_eligible").orderBy(key.asc() if ascending else key.desc(), "method")
    return d.withColumn("rank", F.when(F.col("rank_eligible") == 1, F.row_number().over(w)))


def unranked_block(ranked: DataFrame, floor: float = RANK_MIN_VALID) -> DataFrame:
    rows = ranked.filter((F.col("rank_eligible") == 0) & (F.col("valid_rate") < floor))
    if "is_oracle" in ranked.columns:
        rows = rows.filter(F.col("is_oracle") == 0)
    return rows


def rank_accelerators(ranked: DataFrame, groups=("target_g",), digits: int | None = None) -> DataFrame:
    """Rank among the accelerators only (trivial predictors take no place)."""
    w = Window.partitionBy(*groups, "_in").orderBy(metric_key("med_error", digits), "method")
    d = ranked.withColumn("_in", ((F.col("rank_eligible") == 1) & (F.col("is_trivial") == 0)).cast("int"))
    return d.withColumn("accel_rank", F.when(F.col("_in") == 1, F.row_number().over(w))).drop("_in")


def best_per_family(cells: DataFrame, floor: float = RANK_MIN_VALID, digits: int | None = None) -> DataFrame:
    """Per (family, target): best by skill (then error) and best by error among
    the methods at the floor; empty names where nothing qualifies."""
    keys = ["family", "is_holdout", "target_g"]
    per = cells.filter(F.col("is_oracle") == 0).groupBy(*keys, "method").agg(
        mean_rate(F.col("valid_rate")).alias("valid_rate"), mean_rate(F.col("cat_rate")).alias("cat_rate"),
        F.percentile("med_error", F.lit(0.5)).alias("med_error"),
        F.percentile("med_skill", F.lit(0.5)).alias("med_skill"))
    sk, er = metric_key("med_skill", digits), metric_key("med_error", digits)
    at_floor = (F.col("valid_rate") >= floor) & F.col("med_error").isNotNull()
    pick_skill = F.when(F.col("med_skill").isNotNull(), F.struct(sk.alias("a"), er.alias("b"), F.col("method").alias("c")))
    pick_error = F.when(at_floor, F.struct(er.alias("a"), F.col("method").alias("c")))
    row = F.struct("method", "med_skill", "med_error", "valid_rate", "cat_rate")
    picks = per.groupBy(*keys).agg(
        F.min_by(row, pick_skill).alias("s"), F.min_by(row, pick_error).alias("e"),
        F.count(F.when(at_floor, 1)).alias("n_at_floor"))
    oracle = cells.filter(F.col("is_oracle") == 1).groupBy(*keys).agg(
        F.percentile("med_error", F.lit(0.5)).alias("oracle_med_error"))
    meta = cells.groupBy(*keys).agg(F.max("capped").alias("capped"))
    return (meta.join(picks, keys, "left").join(oracle, keys, "left").select(
        *keys, "capped", F.coalesce("s.method", F.lit("")).alias("best_by_skill"),
        F.col("s.med_skill").alias("best_skill"), F.col("s.med_error").alias("skill_best_med_error"),
        rate4("s.valid_rate").alias("skill_best_valid_rate"),
        F.coalesce("e.method", F.lit("")).alias("best_by_error"), F.col("e.med_error").alias("err_best_med_error"),
        rate4("e.valid_rate").alias("err_best_valid_rate"),
        F.coalesce("n_at_floor", F.lit(0)).alias("n_at_floor"), "oracle_med_error"))


def leading_methods(core: DataFrame, hold: DataFrame, target: float, digits: int | None = None) -> DataFrame:
    """Union of the best core ranks, the best hold-out ranks, the best core win
    rates and the two named fits, ordered by core then hold-out rank."""
    c = core.filter((F.col("target_g") == target) & (F.col("is_trivial") == 0))
    h = hold.filter((F.col("target_g") == target) & (F.col("is_trivial") == 0))
    top_win = (c.filter("rank_eligible = 1").orderBy(F.col("win_rate_vs_last").desc(), "method")
               .limit(LEAD_TOP_WIN).select("method"))
    named = c.filter(F.col("method").isin(DEFAULT_METHOD, CONSERVATIVE_METHOD)).select("method")
    names = (c.filter(F.col("accel_rank") <= LEAD_TOP_CORE).select("method")
             .union(h.filter(F.col("accel_rank") <= LEAD_TOP_HOLD).select("method"))
             .union(top_win).union(named).distinct())
    ranks = (names.join(c.select("method", F.col("accel_rank").alias("core_rank")), "method", "left")
             .join(h.select("method", F.col("accel_rank").alias("hold_rank")), "method", "left"))
    w = Window.orderBy(F.asc_nulls_last("core_rank"), F.asc_nulls_last("hold_rank"), "method")
    return ranks.withColumn("position", F.row_number().over(w))


def ordered_union(*lists: DataFrame) -> DataFrame:
    """Distinct union of (method, position) lists that keeps first places."""
    out = None
    for i, part in enumerate(lists):
        part = part.select("method", F.struct(F.lit(i).alias("list"), F.col("position").alias("position")).alias("_o"))
        out = part if out is None else out.unionByName(part)
    w = Window.orderBy("_o")
    return out.groupBy("method").agg(F.min("_o").alias("_o")).select("method", F.row_number().over(w).alias("position"))


def top_methods(pooled: DataFrame, n: int = 10, digits: int | None = None) -> DataFrame:
    return pooled.filter("rank_eligible = 1").orderBy(metric_key("med_error", digits), "method").limit(n)


def average_rank(df: DataFrame, keys, value: str, name: str) -> DataFrame:
    """Rank with ties averaged.  Values are counted first, so a tie of any size
    is one row, and the running count spreads over value buckets (two levels)."""
    from tailcast.functions.quantiles import bucket_of
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", bucket_of(F.col(value)))
    blocks = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_b", F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.join(blocks, [*keys, "_b"]).select(
        *keys, value, "_c", (F.col("_off") + F.coalesce(F.sum("_c").over(inside), F.lit(0))
                             + (F.col("_c") + 1) / 2.0).alias(name))
    return ranks


def side_by_side(core: DataFrame, hold: DataFrame) -> DataFrame:
    """Core row beside hold-out row per (method, target): ranked block first,
    then the accelerators below the core validity floor."""
    cols = ["med_error", "med_skill", "cat_rate", "valid_rate", "accel_rank"]
    c = core.filter("is_trivial = 0").select("method", "target_g", "rank_eligible",
                                             *[F.col(x).alias(f"core_{x}") for x in cols])
    h = hold.filter("is_trivial = 0").select("method", "target_g", *[F.col(x).alias(f"hold_{x}") for x in cols])
    j = c.join(h, ["method", "target_g"], "full_outer")
    ranked = j.filter("core_accel_rank IS NOT NULL").withColumn("block", F.lit("ranked"))
    below = j.filter("core_accel_rank IS NULL").withColumn("block", F.lit("unranked"))
    return ranked.unionByName(below).drop("rank_eligible")


def rank_shift(core: DataFrame, hold: DataFrame) -> DataFrame:
    """Hold-out rank minus core rank, NULL where either is unranked."""
    c = core.filter("is_trivial = 0").select("method", "target_g", F.col("accel_rank").alias("core_rank"))
    h = hold.filter("is_trivial = 0").select("method", "target_g", F.col("accel_rank").alias("hold_rank"))
    return c.join(h, ["method", "target_g"], "full_outer").withColumn("shift", F.col("hold_rank") - F.col("core_rank"))


def family_best(cells: DataFrame, ranked: DataFrame, named=(DEFAULT_METHOD, CONSERVATIVE_METHOD),
                digits: int | None = None) -> DataFrame:
    """Family by family: last value, the named fits and the best rank-eligible
    accelerator; capped families keep a row with zero cells."""
    keys = ["family", "is_holdout", "target_g"]
    fam = family_table(cells, (*keys, "method"))
    elig = ranked.filter("rank_eligible = 1 AND is_trivial = 0").select("is_holdout", "target_g", "method").withColumn("_ok", F.lit(1))
    j = fam.join(F.broadcast(elig), ["is_holdout", "target_g", "method"], "left")

    def of(m, col):
        return F.max(F.when(F.col("method") == m, F.col(col)))

    key = metric_key("med_error", digits)
    best = F.when((F.col("_ok") == 1) & F.col("med_error").isNotNull(), F.struct(key.alias("e"), F.col("method").alias("m")))
    out = j.groupBy(*keys).agg(
        of(named[0], "n").alias("n_cells"), of("last_value", "med_error").alias("last_error"),
        *[of(m, c).alias(f"{m}_{c}") for m in named for c in ("med_error", "win")],
        F.min_by("method", best).alias("best_method"), F.min_by("med_error", best).alias("best_error"))
    every = cells.select(*keys).distinct()
    return every.join(out, keys, "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))


def family_best_footer(best: DataFrame, named: str = DEFAULT_METHOD) -> DataFrame:
    """Per set and target: uncapped families, and those where the named method
    wins more than half / has the larger median error than the last value."""
    b = best.filter("n_cells > 0")
    return b.groupBy("is_holdout", "target_g").agg(
        F.count(F.lit(1)).alias("n_families"),
        F.count(F.when(F.col(f"{named}_win") > 0.5, 1)).alias("n_win"),
        F.count(F.when(F.col(f"{named}_med_error") > F.col("last_error"), 1)).alias("n_worse_than_last"))
