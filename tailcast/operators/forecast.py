"""The forecast job: windows and targets in, one row per (window, target, method) out."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailcast.functions import blocks
from tailcast.operators.curves import summarise
from tailcast.operators.methods import expressions, levels, lookup, shift_spread, shifted_members, valid_or_null
from tailcast.settings import REGISTRY_INDEX, WIN_SHIFTS

REFERENCE_COLUMNS = ("L_true", "L_hat", "last_v", "mean_v", "min_v", "max_v", "assumed_mode")
SHIFTS = sorted({max(0, s) for s in WIN_SHIFTS})
FEWEST_SHIFTED = 3             # points that a shifted window needs


def _cut(rows: DataFrame, shift: int) -> DataFrame:
    """The window without its first points; the whole one stays in ``_xs`` and ``_ys``."""
    keep = F.greatest(F.size("_xs") - shift, F.lit(0))
    rows = rows.withColumns({n: F.slice(f"_{n}", shift + 1, keep) if shift else F.col(f"_{n}") for n in ("xs", "ys")})
    if not shift:
        return rows.withColumns({n: F.col(f"_0{n}") for n in ("last_v", "mean_v", "min_v", "max_v")})
    return summarise(rows)


def forecast(windows: DataFrame, methods, keep=()) -> DataFrame:
    """Estimates of ``methods`` for every target of every window: one row per (window, target, method)."""
    return unpacked(packed(windows, methods, keep), methods)


def packed(windows: DataFrame, methods, keep=(), more=None) -> DataFrame:
    """The same with one row per (window, target) and the estimates as an array ``ests`` in the order of ``methods``: what a
    stage writes, since all other columns of a record follow from the window's.  ``more`` names further values per target and method:
    arrays per window with all methods of the first target, then of the second and so on; each target keeps its own part.

    ``windows`` carries ``xs``, ``ys``, the window summaries and ``targets``, an
    array of structs with at least ``n_f`` and ``true_val``.  Parameters are
    computed once per window, before the targets are exploded; the whole job is
    a chain of projections without a shuffle.  The arrays are never empty; the
    outer generators keep the optimizer from inferring a "not empty" filter,
    which would be pushed below and compute every estimate twice.

    Built-in plain methods are computed in one Arrow function per window, whose array holds every target's estimates and
    the spreads that composites ask for; the plan does not grow with them.  Methods that were registered are Columns.
    Composites are expressions on their members' estimates in the same row, level by level.  Members whose
    spread is asked for and that are registered Columns are also computed on the shifted windows, as further
    projections of the row."""
    ranked = levels(methods)
    moved = shifted_members(ranked)
    plain = ranked[0] if ranked else []
    inside = [s.name for s in plain if s.name in REGISTRY_INDEX and s.name in blocks.NAMES]
    more = dict(more or {})
    if not set(moved) <= set(inside):
        if more:
            raise ValueError("values beside the estimates need members that are computed in blocks")
        return _packed_with_shifts(windows, methods, ranked, moved, keep)
    made = {s.name: expressions(s) for s in plain if s.name not in inside}
    fitted = windows.withColumns({f"_p_{n}": p for n, (p, _) in made.items() if p is not None})
    arrays = dict(more)
    if inside:
        run = blocks.estimates(inside, moved, [max(0, s) for s in WIN_SHIFTS], FEWEST_SHIFTED)
        arrays["_block"] = run("xs", "ys", F.col("L_hat").cast("double"), F.col("targets.n_f"))
    fitted = fitted.withColumns(arrays)
    rows = fitted.select("*", F.posexplode_outer("targets").alias("_at", "t")).drop("targets", *([] if made else ["xs", "ys"]))
    start = F.col("_at") * (len(inside) + len(moved))
    values = {n: F.get("_block", start + i) for i, n in enumerate(inside)} | {n: e for n, (_, e) in made.items()}
    if len(ranked) > 1:
        rows = rows.withColumns({f"_v_{n}": e for n, e in values.items()} | {
            f"_s_{n}": F.get("_block", start + len(inside) + i) for i, n in enumerate(moved)})
        for layer in ranked[1:]:
            rows = rows.withColumns({f"_v_{s.name}": s.combine(_members(s, (lambda m: F.col(f"_s_{m}")) if s.spreads else None)).cast("double") for s in layer})
        values = {s.name: F.col(f"_v_{s.name}") for layer in ranked for s in layer}
    rows = rows.withColumns({n: F.slice(n, F.col("_at") * len(methods) + 1, len(methods)) for n in more})
    return _packed(windows, rows, methods, values, keep, list(more))


def _members(s, spread=None):
    return F.array(*[F.struct(valid_or_null(F.col(f"_v_{m}")).alias("v"), (spread(m) if spread else F.lit(None).cast("double")).alias("spread")) for m in s.members])


def _with_shifts(windows: DataFrame, methods, ranked, moved, keep) -> DataFrame:
    return unpacked(_packed_with_shifts(windows, methods, ranked, moved, keep), methods)


def _packed_with_shifts(windows: DataFrame, methods, ranked, moved, keep) -> DataFrame:
    """The same with the members in ``moved`` evaluated at every shift; ``_v_m`` is a method's value on the
    whole window and ``_v{shift}_m`` on a shifted one."""
    summaries = ("last_v", "mean_v", "min_v", "max_v")
    rows = windows.withColumns({f"_{n}": F.col(n) for n in ("xs", "ys")} | {f"_0{n}": F.col(n) for n in summaries})
    made = {s.name: expressions(s) for s in ranked[0]}
    names = lambda shift: [n for n in made if shift == 0 or n in moved]
    for shift in reversed(SHIFTS):
        rows = _cut(rows, shift).withColumns({f"_p{shift}_{n}": made[n][0] for n in names(shift) if made[n][0] is not None})
    rows = rows.select("*", F.explode_outer("targets").alias("t")).drop("targets")
    for shift in reversed(SHIFTS):
        at = "" if shift == 0 else str(shift)
        rows = _cut(rows, shift).withColumns({f"_p_{n}": F.col(f"_p{shift}_{n}") for n in names(shift) if made[n][0] is not None})
        rows = rows.withColumns({f"_v{at}_{n}": made[n][1] for n in names(shift)})
        for layer in ranked[1:] if shift else ():
            inner = [s for s in layer if s.name in moved]
            if any(s.spreads for s in inner):
                raise ValueError("a composite that weighs spreads cannot be weighed by its own spread")
            rows = rows.withColumns({f"_v{at}_{s.name}": s.combine(F.array(*[F.struct(valid_or_null(F.col(f"_v{at}_{m}")).alias("v"), F.lit(None).cast("double").alias("spread"))
                                                                             for m in s.members])).cast("double") for s in inner})

    def spread(m):
        enough = lambda shift: (F.size("_xs") - shift) >= FEWEST_SHIFTED
        return shift_spread({s: F.when(enough(s), valid_or_null(F.col(f"_v{s or ''}_{m}"))) for s in SHIFTS})

    for layer in ranked[1:]:
        rows = rows.withColumns({f"_v_{s.name}": s.combine(_members(s, spread if s.spreads else None)).cast("double") for s in layer})
    return _packed(windows, rows, methods, {m: F.col(f"_v_{m}") for m in methods}, keep, [])


def _packed(windows: DataFrame, rows: DataFrame, methods, values, keep, more) -> DataFrame:
    """One row per (window, target)."""
    rows = rows.withColumn("ests", F.array(*[values[lookup(n).name] for n in methods]))
    target_columns = [f.name for f in windows.schema["targets"].dataType.elementType.fields]
    drop = {"xs", "ys", "targets", *target_columns}
    base = [c for c in windows.columns if c not in drop or c in keep]
    return rows.select(*base, *[F.col(f"t.{c}").alias(c) for c in target_columns], "ests", *more)


def unpacked(rows: DataFrame, methods, more=()) -> DataFrame:
    """One row per (window, target, method) from ``packed`` ones."""
    rest = [c for c in rows.columns if c not in ("ests", *more)]
    names = F.array(*[F.lit(lookup(n).name) for n in methods])
    long = rows.select(*rest, *more, F.posexplode_outer("ests").alias("_m", "estimate_raw"))
    return long.select(*rest, F.get(names, F.col("_m")).alias("method"), "estimate_raw", *[F.get(n, F.col("_m")).alias(n) for n in more])


def with_step_targets(packed_windows: DataFrame) -> DataFrame:
    """Keep the targets beyond the depth: depth < target <= length of the curve."""
    return packed_windows.withColumn(
        "targets", F.filter("targets", lambda t: t["n_f"] > F.col("depth"))).filter(F.size("targets") > 0)


def with_gap_targets(packed_windows: DataFrame) -> DataFrame:
    """Keep the horizons that belong to the window's depth."""
    return packed_windows.withColumn("targets", F.transform(
        F.filter("targets", lambda t: t["depth"] == F.col("depth")),
        lambda t: F.struct(t["target_g"].alias("target_g"), t["n_f"].alias("n_f"),
                           t["achieved_g"].alias("achieved_g"), t["capped"].alias("capped"),
                           t["true_val"].alias("true_val")))).filter(F.size("targets") > 0)
