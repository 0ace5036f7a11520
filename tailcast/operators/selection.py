"""Choosing a method by trial on other runs.

A trial pairs a pilot run with a final run of the same cell.  Pairs are never
built: all pilots that chose the same method are one weight.  For a method m and
a final run f the number of trials is the number of pilots that chose m, less
one if f itself did, so every statistic is a weighted aggregate over
(run, method) rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailcast.functions.quantiles import grouped, order_statistics
from tailcast.session import settled
from tailcast.settings import (ACCELERATORS, CONSERVATIVE_METHOD, DEFAULT_METHOD, RANK_MIN_VALID, RATIO_EPS, REGISTRY_INDEX)

CELL = ("family", "is_holdout", "depth", "noise", "target_g")
RUN = "curve_id"


def pool_table(spark: SparkSession, pools: dict[str, list[str]]) -> DataFrame:
    rows = [(p, m, REGISTRY_INDEX[m]) for p, members in pools.items() for m in members]
    return spark.createDataFrame(rows, "pool string, method string, registry_index int")


def candidate_pools(spark: SparkSession, lead: DataFrame, available=ACCELERATORS, classical=()) -> DataFrame:
    """Leading methods, the two named fits, the classical variants, everything."""
    fixed = pool_table(spark, {"named": [m for m in (DEFAULT_METHOD, CONSERVATIVE_METHOD) if m in available],
                               "classical": [m for m in classical if m in available],
                               "all": [m for m in ACCELERATORS if m in available]})
    every = pool_table(spark, {"x": [m for m in ACCELERATORS if m in available]}).drop("pool")
    return fixed.unionByName(lead.select("method").join(F.broadcast(every), "method").select(
        F.lit("lead").alias("pool"), "method", "registry_index"))


def uncapped_cells(cells: DataFrame) -> DataFrame:
    """Cells whose horizon is not capped; the flag must agree across methods."""
    flags = cells.groupBy(*CELL).agg(F.min("capped").alias("lo"), F.max("capped").alias("hi"))
    if flags.filter("lo <> hi").limit(1).count():
        raise ValueError("the capped flag differs between methods of a cell")
    return flags.filter("hi = 0").select(*CELL)


def check_flags(records: DataFrame) -> DataFrame:
    """An invalid record must carry the catastrophic flag."""
    if records.filter("valid <> 1 AND catastrophic <> 1").limit(1).count():
        raise ValueError("an invalid record lacks the catastrophic flag")
    return records


def trial_records(records: DataFrame, uncapped: DataFrame, pools: DataFrame, cell=CELL, run=RUN) -> DataFrame:
    """Records of the pool members in uncapped cells, once per pool."""
    rows = records.select(*cell, run, "method", F.when(F.col("valid") == 1, F.col("error")).alias("err"),
                          (F.col("catastrophic") != 0).cast("int").alias("cat"))
    return rows.join(F.broadcast(pools), "method").join(uncapped, list(cell), "left_semi")


def run_facts(records: DataFrame, uncapped: DataFrame, cell=CELL, run=RUN) -> DataFrame:
    """Per run: errors of the default and of the last value, catastrophe of the default."""
    d, last = F.col("method") == DEFAULT_METHOD, F.col("method") == "last_value"
    err = F.when(F.col("valid") == 1, F.col("error"))
    return (records.join(uncapped, list(cell), "left_semi").groupBy(*cell, run).agg(
        F.max(F.when(d, err)).alias("e_default"), F.max(F.when(last, err)).alias("e_last"),
        F.coalesce(F.max(F.when(d, (F.col("catastrophic") != 0).cast("int"))), F.lit(1)).alias("cat_default")))


def _error_key(digits):
    return F.col("err") if digits is None else F.round("err", digits)


def _pilot_key(digits):
    return F.when(F.col("err").isNotNull(), F.struct(_error_key(digits).alias("e"), F.col("registry_index")))


def choose_one_pilot(rows: DataFrame, digits: int | None = None, cell=CELL, run=RUN) -> DataFrame:
    """Per (pool, run as pilot): the member with the lowest valid error there,
    ties by registry order; NULL when no member is valid."""
    return rows.groupBy("pool", *cell, run).agg(F.min_by("method", _pilot_key(digits)).alias("chosen"))


def cell_runs(facts: DataFrame, cell=CELL) -> DataFrame:
    """Runs per cell; ``facts`` has one row per run, so a plain count is exact."""
    return facts.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_runs"))


def _with_others_key(rows: DataFrame, runs: DataFrame, min_valid: float, digits: int | None, cell) -> DataFrame:
    """Rows with ``_others``, by which the other runs order the members.  Leaving one value out moves
    a median by at most one place, so three middle order statistics per (cell, method) give every leave-one-out
    median.  A method has the same rows in every pool, so one pool's rows are ordered."""
    half = lambda n: F.floor(n / 2)                                   # noqa: E731
    once = rows.join(F.broadcast(rows.groupBy("method").agg(F.min("pool").alias("pool"))), ["method", "pool"], "left_semi")
    mid = settled(order_statistics(once, [*cell, "method"], "err", {
        "x0": lambda n: half(n) - 1, "x1": half, "x2": lambda n: half(n) + 1}), "middles")
    r = rows.join(mid, [*cell, "method"], "left").join(runs, list(cell))
    e, k = F.col("err"), F.floor(F.col("n") / 2)
    even = (F.col("n") % 2) == 0
    full = F.when(even, (F.col("x0") + F.col("x1")) / 2.0).otherwise(F.col("x1"))
    # without one valid value: the upper middle stays if a lower one left, and so on
    left_even = F.when(e >= F.col("x1"), F.col("x0")).otherwise(F.col("x1"))
    left_odd = (F.when(e < F.col("x1"), F.col("x1") + F.col("x2")).when(e > F.col("x1"), F.col("x0") + F.col("x1"))
                .otherwise(F.col("x0") + F.col("x2")) / 2.0)
    loo = F.when(e.isNull(), full).when(F.col("n") == 1, F.lit(None)).when(even, left_even).otherwise(left_odd)
    others = F.coalesce(F.col("n"), F.lit(0)) - F.when(e.isNull(), 0).otherwise(1)
    ok = F.coalesce((F.col("n_runs") > 1) & (others / F.greatest(F.col("n_runs") - 1, F.lit(1)) >= min_valid) & loo.isNotNull(), F.lit(False))
    return r.withColumn("_others", F.when(ok, F.struct((loo if digits is None else F.round(loo, digits)).alias("m"), F.col("registry_index"))))


def choose_many_pilots(rows: DataFrame, runs: DataFrame, min_valid: float = RANK_MIN_VALID, digits: int | None = None, cell=CELL, run=RUN) -> DataFrame:
    """Per (pool, run as final): the member with the lowest median error over the
    other runs among those valid on enough of them."""
    return _with_others_key(rows, runs, min_valid, digits, cell).groupBy("pool", *cell, run).agg(F.min_by("method", "_others").alias("chosen"))


def choose_both(rows: DataFrame, runs: DataFrame, min_valid: float = RANK_MIN_VALID, digits: int | None = None, cell=CELL, run=RUN) -> DataFrame:
    """Both choices of a run in one grouping: ``own`` as one pilot, ``final`` by the other runs."""
    return _with_others_key(rows, runs, min_valid, digits, cell).groupBy("pool", *cell, run).agg(
        F.min_by("method", _pilot_key(digits)).alias("own"), F.min_by("method", "_others").alias("final"))


def trial_rows(rows: DataFrame, choices: DataFrame, cell=CELL, run=RUN) -> DataFrame:
    """(design, run, method) rows with the number of trials they stand for; ``choices`` has both choices of each run and its facts.

    One pilot: a method stands for the pilots that chose it, less the run itself.  Many pilots: one trial per final
    run of a cell of two or more.  The records meet the choices once and give the rows of both designs."""
    keys = ["pool", *cell]
    facts = ["e_default", "e_last", "cat_default"]
    counts = choices.filter("own IS NOT NULL").groupBy(*keys, F.col("own").alias("method")).agg(F.count(F.lit(1)).alias("_c"))
    sizes = choices.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("own").isNull(), 1)).alias("_none"))
    many, one = F.lit(1).cast("long"), F.lit(0).cast("long")
    is_own = F.coalesce(F.col("own") == F.col("method"), F.lit(False)).cast("int")
    is_final = F.coalesce((F.col("_n") >= 2) & (F.col("final") == F.col("method")), F.lit(False))

    def design(name, weight, cat):
        return F.struct(F.lit(name).alias("design"), cat.cast("int").alias("cat"), weight.alias("w"))

    def both(df, *designs):
        return df.select(*keys, run, "method", "err", *facts, F.explode(F.filter(F.array(*designs), lambda d: d["w"] > 0)).alias("_d")).select(
            "_d.design", *keys, run, "method", "err", "_d.cat", "_d.w", *facts)

    met = rows.select(*keys, run, "method", "err", "cat").join(choices.join(sizes, keys), [*keys, run]).join(counts, [*keys, "method"], "left")
    picked = both(met, design("one_pilot", F.coalesce("_c", one) - is_own, F.col("cat")),
                  design("many_pilots", F.when(is_final, many).otherwise(one), F.coalesce("cat", F.lit(1))))
    bare = choices.filter(F.col(run).isNotNull()).join(sizes, keys).withColumns({"method": F.lit(None).cast("string"), "err": F.lit(None).cast("double")})
    none = both(bare, design("one_pilot", F.col("_none") - F.col("own").isNull().cast("int"), F.lit(1)),
                design("many_pilots", F.when((F.col("_n") >= 2) & F.col("final").isNull(), many).otherwise(one), F.lit(1)))
    return picked.unionByName(none)


def cell_statistics(trials: DataFrame, facts: DataFrame, cell=CELL) -> DataFrame:
    """Statistics per design, pool and cell; ``trials`` has both designs and the facts of the run in one table, which is
    written once and aggregated in one pass."""
    e, d, last, w = F.col("err"), F.col("e_default"), F.col("e_last"), F.col("w")
    ok = e.isNotNull()
    order = F.element_at(F.create_map(*[x for m, i in REGISTRY_INDEX.items() for x in (F.lit(m), F.lit(i))]), F.col("method"))
    keys = ["design", "pool", *cell]
    t = trials.select(
        *keys, "method", "err", "cat", "w", "e_default", "e_last", "cat_default",
        F.when(ok & (d > RATIO_EPS), e / F.when(d > RATIO_EPS, d)).alias("_ratio"))
    t = settled(t, "trials")

    def share(cond):
        return F.sum(F.when(cond, w).otherwise(0)) / F.sum(w)

    stats = grouped(t, keys, [
        F.sum(w).alias("n_trials"), F.sum(F.when(F.col("method").isNull(), w).otherwise(0)).alias("n_no_choice"),
        share(ok).alias("chosen_valid_rate"), share(ok & (d.isNull() | (e < d))).alias("win_vs_default"),
        share(F.coalesce(F.col("method") == DEFAULT_METHOD, F.lit(False))).alias("default_chosen"),
        share(ok & (last.isNull() | (e < last))).alias("win_vs_last"),
        share(F.col("cat") != 0).alias("cat_rate_chosen"), share(F.col("cat_default") != 0).alias("cat_rate_default")],
        {"med_error_chosen": ("err", 0.5), "med_error_default": ("e_default", 0.5), "med_error_last": ("e_last", 0.5),
         "med_ratio_vs_default": ("_ratio", 0.5)}, weight="w")
    stats = stats.join(cell_runs(facts, cell), list(cell))
    per = t.filter("method IS NOT NULL").groupBy(*keys, "method").agg(F.sum("w").alias("c"))
    top = per.groupBy(*keys).agg(F.min_by(F.struct("method", "c"), F.struct((-F.col("c")).alias("c"), order.alias("o"))).alias("t"), F.sum("c").alias("s"),
                                  F.count(F.lit(1)).alias("n_distinct_chosen"))
    return stats.join(top, keys, "left").select(
        *stats.columns, F.coalesce("t.method", F.lit("")).alias("top_chosen"), (F.col("t.c") / F.col("s")).alias("top_chosen_share"),
        F.coalesce("n_distinct_chosen", F.lit(0)).alias("n_distinct_chosen"))


def selection_cells(records: DataFrame, uncapped: DataFrame, pools: DataFrame, min_valid: float = RANK_MIN_VALID,
                    digits: int | None = None, cell=CELL, run=RUN, keep=lambda name, df: df) -> DataFrame:
    """Both designs, every pool and cell.  The trial rows, the run facts and the
    choices are each read several times; ``keep(name, df)`` may write them as
    tables so that the records are joined to the pools once."""
    rows = keep("rows", trial_records(records, uncapped, pools, cell, run))
    facts = keep("facts", run_facts(records, uncapped, cell, run))
    choices = keep("choices", choose_both(rows, cell_runs(facts, cell), min_valid, digits, cell, run).join(facts, [*cell, run], "left"))
    return cell_statistics(trial_rows(rows, choices, cell, run), facts, cell)


def pooled_selection(cells: DataFrame, classes) -> DataFrame:
    """Means of rates and medians of errors over cells, per noise class and over
    all, and the families whose mean win rate exceeds one half."""
    c = cells.select("*", F.explode(F.array(classes, F.lit("all"))).alias("noise_class"))
    keys = ["is_holdout", "target_g", "noise_class", "pool", "design"]
    mean = ["chosen_valid_rate", "win_vs_default", "default_chosen", "win_vs_last", "cat_rate_chosen", "cat_rate_default"]
    med = ["med_error_chosen", "med_error_default", "med_error_last", "med_ratio_vs_default"]
    fam = c.groupBy(*keys, "family").agg(F.avg("win_vs_default").alias("wd"), F.avg("win_vs_last").alias("wl")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("families"), F.count(F.when(F.col("wd") > 0.5, 1)).alias("families_win_default_k"),
        F.count(F.when(F.col("wl") > 0.5, 1)).alias("families_win_last_k"))
    return c.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), *[F.avg(m).alias(m) for m in mean],
                                *[F.percentile(m, F.lit(0.5)).alias(m) for m in med]).join(fam, keys)


def agreement_check(pooled: DataFrame, reference: DataFrame, tolerance: float = 1e-6, cat_tolerance: float = 5e-5 + 1e-12) -> DataFrame:
    """Default and last-value medians and the default's catastrophe rate in the
    pooled selection against the pooled benchmark table."""
    ref = reference.groupBy("is_holdout", "target_g").agg(
        F.max(F.when(F.col("method") == DEFAULT_METHOD, F.col("med_error"))).alias("ref_default"),
        F.max(F.when(F.col("method") == "last_value", F.col("med_error"))).alias("ref_last"),
        F.max(F.when(F.col("method") == DEFAULT_METHOD, F.col("cat_rate"))).alias("ref_cat"), F.max("n_cells").alias("ref_cells"))
    j = pooled.filter("noise_class = 'all'").join(ref, ["is_holdout", "target_g"])
    return j.groupBy("is_holdout", "target_g").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("med_error_default") - F.col("ref_default"))).alias("max_diff_default"),
        F.max(F.abs(F.col("med_error_last") - F.col("ref_last"))).alias("max_diff_last"),
        F.max(F.abs(F.col("cat_rate_default") - F.col("ref_cat"))).alias("max_diff_cat"),
        F.max(F.abs(F.col("cells") - F.col("ref_cells"))).alias("max_diff_cells")).withColumn(
        "agree", ((F.col("max_diff_default") <= tolerance) & (F.col("max_diff_last") <= tolerance)
                  & (F.col("max_diff_cat") <= cat_tolerance) & (F.col("max_diff_cells") == 0)).cast("int"))


def require_agreement(check: DataFrame) -> DataFrame:
    if check.filter("agree = 0").limit(1).count():
        raise ValueError("the selection tables disagree with the pooled benchmark tables")
    return check


def family_selection(cells: DataFrame, pool: str, target: float) -> DataFrame:
    """Family by family, both designs side by side."""
    c = cells.filter((F.col("pool") == pool) & (F.col("target_g") == target))
    aggs = []
    for d in ("one_pilot", "many_pilots"):
        at = F.col("design") == d
        aggs += [F.avg(F.when(at, F.col(x))).alias(f"{d}_{x}") for x in ("win_vs_default", "default_chosen", "win_vs_last", "cat_rate_chosen")]
        aggs += [F.percentile(F.when(at, F.col("med_error_chosen")), F.lit(0.5)).alias(f"{d}_med_error")]
    return c.groupBy("is_holdout", "family").agg(
        F.count(F.when(F.col("design") == "one_pilot", 1)).alias("n_cells"), *aggs,
        F.avg("cat_rate_default").alias("cat_rate_default"), F.percentile("med_error_default", F.lit(0.5)).alias("med_error_default"),
        F.percentile("med_error_last", F.lit(0.5)).alias("med_error_last"))


def methods_chosen(cells: DataFrame, pool: str, target: float) -> DataFrame:
    """How often a method is the most chosen of a cell, per design, set and
    noise restriction."""
    c = cells.filter((F.col("pool") == pool) & (F.col("target_g") == target) & (F.col("top_chosen") != ""))
    sets = F.array(F.lit("both"), F.when(F.col("is_holdout") == 1, "holdout").otherwise("core"))
    scope = F.when(F.col("noise") > 0, F.array(F.lit("all cells"), F.lit("noise > 0"))).otherwise(F.array(F.lit("all cells")))
    return c.select("*", F.explode(sets).alias("regime_set")).select("*", F.explode(scope).alias("scope")).groupBy(
        "design", "regime_set", "scope", "top_chosen").agg(F.count(F.lit(1)).alias("n_cells"))


def placed(rows: DataFrame, groups: dict[str, list[str]], value: str) -> DataFrame:
    """Adds, for each named list of columns, the 0-based place of a row among the rows that agree on them, in order
    of ``value``; equal values keep one order throughout.  Rows are dealt into ranges of the value; a place is the
    place in the own range plus the counts of earlier ones, so no task orders a group."""
    dealt = settled(rows.repartitionByRange(value).withColumns({"_part": F.spark_partition_id(), "_tie": F.monotonically_increasing_id()}), "placed")
    out = dealt
    for name, keys in groups.items():
        sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
        inside = Window.partitionBy(*keys, "_part").orderBy(value, "_tie")
        out = (out.withColumn("_own", F.row_number().over(inside)).join(starts, [*keys, "_part"])
               .withColumn(name, F.col("_start") + F.col("_own") - 1).drop("_own", "_start"))
    return out.drop("_part", "_tie")


def medians_without(rows: DataFrame, keys: list[str], fold: str, value: str) -> DataFrame:
    """Median of ``value`` per group over the rows outside each fold, from one ordering of all rows.

    Without a fold, the value at rank r is the one at place r + c of the whole group, where c counts the fold's
    rows that stand before it: those whose place, less the number of own rows before them, is at most r.  A fold
    costs its own rows once, whatever the number of folds."""
    at = settled(placed(rows, {"_place": keys, "_nth": [*keys, fold]}, value), "fold-places")
    sizes = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    own = at.groupBy(*keys, fold).agg(F.count(F.lit(1)).alias("_mine"))
    # every fold of a group meets every method of it, also those without a row in the fold
    outer = [k for k in keys if k != "method"]
    folds = rows.select(*outer, fold).distinct()
    every = (folds.join(sizes, outer) if outer else folds.crossJoin(F.broadcast(sizes))).join(own, [*keys, fold], "left")
    left = F.col("_all") - F.coalesce("_mine", F.lit(0))
    wanted = every.filter(left > 0).select(*keys, fold, F.floor((left - 1) / 2).cast("long").alias("_low"), F.ceil((left - 1) / 2).cast("long").alias("_high"))
    gap = F.col("_place") - F.col("_nth")
    shift = (wanted.join(at.select(*keys, fold, "_place", "_nth"), [*keys, fold], "left").groupBy(*keys, fold, "_low", "_high")
             .agg(F.count(F.when(gap <= F.col("_low"), 1)).alias("_a"), F.count(F.when(gap <= F.col("_high"), 1)).alias("_b")))
    ends = shift.select(*keys, fold, F.explode(F.array(F.struct(F.lit(0).alias("_end"), (F.col("_low") + F.col("_a")).alias("_place")),
                                                        F.struct(F.lit(1).alias("_end"), (F.col("_high") + F.col("_b")).alias("_place")))).alias("_e")).select(*keys, fold, "_e.*")
    found = ends.join(at.select(*keys, "_place", F.col(value).alias("_v")), [*keys, "_place"])
    a, b = F.max(F.when(F.col("_end") == 0, F.col("_v"))), F.max(F.when(F.col("_end") == 1, F.col("_v")))
    return found.groupBy(*keys, fold).agg(F.when(a == b, a).otherwise(a + (b - a) / 2).alias("score"))


def recorded_folds(records: DataFrame, pools: DataFrame, fold: str, within, default: str = DEFAULT_METHOD,
                   digits: int | None = None) -> DataFrame:
    """Leave-one-out choice on recorded curves (cells before the minimum): for
    every fold the pool member with the lowest median skill against the last
    value on the other folds of the same ``within`` group, and its score on the
    fold.  An invalid record counts as +inf.  Rows are ordered once; the cost does not grow with the number of folds."""
    inf = F.lit(float("inf"))
    rows = settled(records.filter("post_min_target = 0 AND is_trivial = 0").select(
        *within, fold, "method", F.when(F.col("valid") == 1, F.col("skill_vs_last")).otherwise(inf).alias("s")), "fold-rows")
    test = grouped(rows, [*within, fold, "method"], [], {"test_score": ("s", 0.5)})
    score = medians_without(rows, [*within, "method"], fold, "s")
    key = F.struct((F.col("score") if digits is None else F.round("score", digits)).alias("s"), F.col("registry_index"))
    pick = score.join(F.broadcast(pools), "method").groupBy("pool", *within, fold).agg(F.min_by("method", key).alias("chosen"))
    chosen = pick.join(test.withColumnsRenamed({"method": "chosen", "test_score": "chosen_score"}), [*within, fold, "chosen"], "left")
    base_line = test.filter(F.col("method") == default).select(*within, fold, F.col("test_score").alias("default_score"))
    return chosen.join(base_line, [*within, fold], "left")


def fold_summary(folds: DataFrame) -> DataFrame:
    c, d = F.col("chosen_score"), F.col("default_score")
    folds = settled(folds.select("pool", "chosen", "chosen_score", "default_score"), "folds")
    methods = folds.groupBy("pool", "chosen").agg(F.count(F.lit(1)).alias("n")).groupBy("pool").agg(F.count("chosen").alias("n_methods_chosen"))
    return grouped(folds, ["pool"], [
        F.count(F.lit(1)).alias("n_folds"), F.count(F.when(c < d, 1)).alias("below"), F.count(F.when(c == d, 1)).alias("equal"),
        F.count(F.when(c > d, 1)).alias("above"), F.count(F.when(c < 1.0, 1)).alias("beats_last")],
        {"med_chosen": ("chosen_score", 0.5), "med_default": ("default_score", 0.5)}).join(methods, "pool")
