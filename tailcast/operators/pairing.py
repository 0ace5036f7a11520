"""Joins of records and cells with each other."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailcast.functions.quantiles import same
from tailcast.operators.panels import GAP_CELL, exclude_capped, family_table
from tailcast.session import for_every_task, settled

RECORD_KEYS = ("curve_id", "depth", "noise", "target_g")


def chosen_records(choices: DataFrame, records: DataFrame, keys) -> DataFrame:
    """Records of the method chosen per cell.  A cell without records of its
    chosen method is an error: every method is evaluated on every cell."""
    return records_of_choices(choices, records, [*keys, "method"])


def records_of_choices(choices: DataFrame, records: DataFrame, on) -> DataFrame:
    """``choices`` with their records, each choice at least once (a left join).  The few choices go to the records, which
    keep their place; choices without a record are added from the keys that the records have."""
    on = list(on)
    few = for_every_task(choices)
    if few is None:
        return choices.join(records, on, "left")
    bare = choices.join(records.select(*on).distinct(), on, "left_anti")
    met = records.join(few, on)
    return met.unionByName(bare, allowMissingColumns=True).select(
        *on, *[c for c in choices.columns if c not in on], *[c for c in records.columns if c not in on])


def require_complete(joined: DataFrame, flag: str = "valid") -> DataFrame:
    missing = joined.filter(F.col(flag).isNull()).limit(1).count()
    if missing:
        raise ValueError("a chosen method has no records on some cell")
    return joined


def pair(records: DataFrame, a: str, b: str, keys=RECORD_KEYS, carry=()) -> DataFrame:
    """Two methods on the same record key, side by side.  One conditional
    aggregation instead of a self join: both methods' rows meet in one shuffle
    that partial aggregation has already halved."""
    rows = records.filter(F.col("method").isin(a, b))

    def of(m, col):
        return F.max(F.when(F.col("method") == m, F.col(col)))

    return (rows.groupBy(*keys, *carry)
            .agg(*[of(m, c).alias(f"{c}_{side}") for m, side in ((a, "a"), (b, "b")) for c in ("error", "valid", "E_last")],
                 F.count_distinct("method").alias("_n"))
            .filter("_n = 2").drop("_n"))


def paired_comparison(records: DataFrame, a: str, b: str, by) -> DataFrame:
    p = pair(exclude_capped(records), a, b, carry=tuple(k for k in by if k not in RECORD_KEYS))
    both = (F.col("valid_a") == 1) & (F.col("valid_b") == 1)
    return p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count(F.when(both, 1)).alias("n_both_valid"),
        F.avg(F.coalesce(both & (F.col("error_b") < F.col("error_a")), F.lit(False)).cast("double")).alias("lower_error_frac"))


def cell_medians(records: DataFrame, a: str, b: str, cell=GAP_CELL) -> DataFrame:
    """Cell-median errors of two methods and their relative change."""
    from tailcast.functions.quantiles import grouped
    rows = records.filter(F.col("method").isin(a, b)).withColumns({
        "_a": F.when((F.col("method") == a) & (F.col("valid") == 1), F.col("error")),
        "_b": F.when((F.col("method") == b) & (F.col("valid") == 1), F.col("error"))})
    return grouped(rows, cell, [], {"med_a": ("_a", 0.5), "med_b": ("_b", 0.5)}).withColumn(
        "rel_change", F.try_divide(F.col("med_b") - F.col("med_a"), F.col("med_a")))


def head_to_head(cells: DataFrame, named: str) -> DataFrame:
    """Families and cells where the named method has the strictly lower median
    error than each other method, both present."""
    def count(rows, keys, name):
        ref = rows.filter(F.col("method") == named).select(*keys, F.col("med_error").alias("_ref"))
        return (rows.filter((F.col("method") != named) & F.col("med_error").isNotNull())
                .join(ref.filter("_ref IS NOT NULL"), keys)
                .groupBy("is_holdout", "target_g", "method")
                .agg(F.count(F.when(F.col("_ref") < F.col("med_error"), 1)).alias(f"{name}_lower"),
                     F.count(F.lit(1)).alias(f"{name}_n")))
    fam = family_table(cells, ("family", "is_holdout", "target_g", "method"))
    a = count(fam, ["family", "is_holdout", "target_g"], "families")
    b = count(exclude_capped(cells), list(GAP_CELL), "cells")
    return a.join(b, ["is_holdout", "target_g", "method"], "full_outer")


RANGES = 4096                  # key ranges of a level
LEVELS = 2                     # levels of ranges before rows are compared
KNOWN_RANGES = 200_000         # differing ranges of which a copy may go to every task


def _marked(side: DataFrame, keys, columns) -> DataFrame:
    """Keys, compared columns, the range of each level and a digest of the row.  NULLs are hashed as such:
    the hash functions alone would pass over them."""
    plain = [x for c in (*keys, *columns) for x in (F.col(c).isNull(), F.col(c))]
    spot = F.xxhash64(*[x for c in keys for x in (F.col(c).isNull(), F.col(c))])
    levels = {f"_r{i}": F.pmod(F.shiftright(spot, 12 * i), F.lit(RANGES)).cast("int") for i in range(LEVELS)}
    return side.select(*keys, *columns).withColumns(levels | {"_h": F.xxhash64(*plain), "_g": F.xxhash64(F.lit(1), *plain)})


def _digests(side: DataFrame, by) -> DataFrame:
    """Rows, combined digest and digest sum of each range: partial aggregates, a few numbers per range and task."""
    return side.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("_h").alias("x"), F.sum(F.col("_g").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"))


def differing_ranges(left: DataFrame, right: DataFrame, keys, columns):
    """(marked left, marked right, ranges that differ, rows in equal ranges, levels used).

    Both sides are digested by key range; where digests agree the rows do, and they are never shuffled.  Differing ranges
    are divided once more, so only rows of the smallest differing ranges are left to compare."""
    a, b = _marked(left, keys, columns), _marked(right, keys, columns)
    open_, equal, by = None, 0, []
    for level in range(LEVELS):
        by = [f"_r{i}" for i in range(level + 1)]
        inside = lambda side: side if open_ is None else side.join(F.broadcast(open_), by[:-1], "left_semi")
        both = settled(_digests(inside(a), by).alias("l").join(_digests(inside(b), by).alias("r"), same("l", "r", by), "full_outer").select(
            *[F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in by], F.col("l.n").alias("n"),
            (F.col("l.n").eqNullSafe(F.col("r.n")) & F.col("l.x").eqNullSafe(F.col("r.x")) & F.col("l.s").eqNullSafe(F.col("r.s"))).alias("same")), "ranges")
        rows = both.agg(F.coalesce(F.sum(F.when(F.col("same"), F.col("n"))), F.lit(0)), F.count(F.when(~F.col("same"), 1))).first()
        equal += rows[0]
        open_ = both.filter(~F.col("same")).select(*by)
        if rows[1] == 0 or rows[1] > KNOWN_RANGES:
            break
    small = rows[1] <= KNOWN_RANGES
    return a, b, F.broadcast(open_) if small else open_, equal, by


def _compared(left: DataFrame, right: DataFrame, keys, columns):
    """Rows of differing ranges side by side, and the number of rows in equal ranges."""
    a, b, open_, equal, by = differing_ranges(left, right, keys, columns)
    side = lambda rows, tag: rows.join(open_, by, "left_semi").select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in columns], F.lit(1).alias(f"_{tag}"))
    joined = side(a, "a").alias("l").join(side(b, "b").alias("r"), same("l", "r", keys), "full_outer")
    return joined.select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], *[f"l.a_{c}" for c in columns], *[f"r.b_{c}" for c in columns], "l._a", "r._b"), equal


def compare_tables(left: DataFrame, right: DataFrame, keys, columns) -> DataFrame:
    """Keyed, null-safe comparison: keys on one side only and mismatches per column.  Key ranges whose digests agree are
    only counted.  Keys are unique on each side; NULL is a key like any other."""
    j, equal = _compared(left, right, keys, columns)
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.agg((F.count(F.when(both, 1)) + F.lit(equal)).alias("n_both"), F.count(F.when(F.col("_b").isNull(), 1)).alias("only_left"),
                 F.count(F.when(F.col("_a").isNull(), 1)).alias("only_right"),
                 *[F.count(F.when(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), 1)).alias(f"diff_{c}") for c in columns])


def keyed_diff(left: DataFrame, right: DataFrame, keys, columns) -> DataFrame:
    """One row per compared column: keys on both sides and on one only, keys whose values differ, and the
    first such key with both values."""
    j, equal = _compared(left, right, keys, columns)
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])
    j = settled(j.withColumn("_key", key), "compared")
    counts = [(F.count(F.when(both, 1)) + F.lit(equal)).alias("n_both"), F.count(F.when(F.col("_b").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("_a").isNull(), 1)).alias("only_right")]
    differs = {c: both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in columns}
    wide = j.agg(*counts, *[x for c in columns for x in (
        F.count(F.when(differs[c], 1)).alias(f"n_{c}"), F.min(F.when(differs[c], F.struct("_key", F.col(f"a_{c}").cast("string").alias("a"), F.col(f"b_{c}").cast("string").alias("b")))).alias(f"e_{c}"))])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n_differ"), F.col(f"e_{c}._key").alias("first_key"),
                               F.col(f"e_{c}.a").alias("left_value"), F.col(f"e_{c}.b").alias("right_value")) for c in columns])
    return wide.select("n_both", "only_left", "only_right", F.inline(items))


def mismatch_sample(left: DataFrame, right: DataFrame, keys, columns, n: int = 5) -> DataFrame:
    """The first ``n`` keys on which a column differs, both values side by side."""
    j, _ = _compared(left, right, keys, columns)
    differs = reduce(lambda x, y: x | y, [~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in columns])
    return j.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull() & differs).drop("_a", "_b").orderBy(*keys).limit(n)


def leading_summary(lead: DataFrame, core: DataFrame, hold: DataFrame, spread: DataFrame,
                    recorded: DataFrame, target: float) -> DataFrame:
    """Leading methods side by side: core, hold-out, sensitivity to the assumed
    limit (NULL = independent of it) and wins on the recorded curves."""
    cols = ["med_error", "win_rate_vs_last", "cat_rate", "valid_rate"]

    def at(df, tag):
        return df.filter(F.col("target_g") == target).select("method", *[F.col(c).alias(f"{tag}_{c}") for c in cols])
    rec = recorded.groupBy("method").agg(
        F.sum(F.when(F.col("post_min_target") == 0, F.col("win_vs_last"))).alias("pre_wins"),
        F.count(F.when(F.col("post_min_target") == 0, 1)).alias("pre_n"),
        F.sum(F.when(F.col("post_min_target") == 1, F.col("win_vs_last"))).alias("post_wins"),
        F.count(F.when(F.col("post_min_target") == 1, 1)).alias("post_n"))
    return (lead.join(at(core, "core"), "method", "left").join(at(hold, "hold"), "method", "left")
            .join(spread.select("method", "spread_pct"), "method", "left").join(rec, "method", "left"))
