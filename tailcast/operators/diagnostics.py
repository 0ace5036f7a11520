"""Stability diagnostics: spread of an estimate under perturbed or shifted windows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailcast.functions import blocks
from tailcast.operators import curves as C
from tailcast.operators.forecast import forecast, packed
from tailcast.operators.scoring import is_valid
from tailcast.settings import PERTURB_SCALE, PERTURB_TRIALS, REGISTRY_INDEX, WIN_SHIFTS

# n_f alone does not name a target: two horizons may end on the same step
WINDOW_KEYS = ("curve_id", "depth", "noise", "n_f", "method")
GAP_KEYS = ("curve_id", "depth", "noise", "target_g", "n_f", "method")


def _iqr(v, weight=None):
    hi, lo = (F.percentile(v, F.lit(p)) if weight is None else F.percentile(v, F.lit(p), weight) for p in (0.75, 0.25))
    return hi - lo


def _in_blocks(methods) -> bool:
    return all(m in REGISTRY_INDEX and (m in blocks.NAMES or m in blocks.TRIVIAL) for m in methods)


def _of_target(windows: DataFrame, keys) -> list[str]:
    of_target = [f.name for f in windows.schema["targets"].dataType.elementType.fields if f.name in keys]
    if "n_f" not in of_target:
        raise ValueError("the keys of a spread name its target step n_f")
    return of_target


def _run(run, copies, of_target):
    return run("xs", copies, F.col("L_hat").cast("double"), F.col("L_true").cast("double"), "targets.n_f", *[
        F.col(f"targets.{k}").cast("array<double>") for k in of_target if k != "n_f"])


def _spreads(windows: DataFrame, copies, run, methods, keys, name: str) -> DataFrame:
    """One row per (window, target, method) with the spread that ``run`` computes; the copies of a window never leave its
    row, so nothing is shuffled.  Targets of a window that agree on the keys are one group, whose values count as often."""
    of_target = _of_target(windows, keys)
    rows = windows.withColumn("_copies", copies)
    rows = rows.withColumn("_block", _run(run, "_copies", of_target))
    rows = rows.withColumn("_t", F.array_distinct(F.arrays_zip(*[F.col(f"targets.{k}").alias(k) for k in of_target])))
    base = [k for k in keys if k not in of_target and k != "method"]
    n = len(methods)
    found = F.arrays_zip(F.array(*[F.lit(m) for m in methods]).alias("method"), F.slice("_block", F.col("_at") * n + 1, n).alias(name))
    long = rows.select(*base, "_block", F.posexplode_outer("_t").alias("_at", "t")).select(*base, *[F.col(f"t.{k}").alias(k) for k in of_target], F.inline_outer(found))
    return long.select(*keys, name)


def perturb_iqr(windows: DataFrame, methods, trials: int = PERTURB_TRIALS, scale: float = PERTURB_SCALE,
                fewest: int = 2, keys=WINDOW_KEYS) -> DataFrame:
    """IQR of the valid estimates over perturbed copies of each window; NULL
    below ``fewest`` valid ones.  A group is one method on one window: at most
    ``trials`` rows.  Built-in plain methods are computed on all copies in one Arrow function per window."""
    if _in_blocks(methods):
        return _spreads(windows, C.perturbed_values(trials, scale), blocks.spreads(methods, fewest), list(methods), keys, "perturb_iqr")
    est = forecast(C.perturbed(windows, trials, scale), methods)
    v = F.when(is_valid(F.col("estimate_raw")), F.col("estimate_raw"))
    return est.groupBy(*keys).agg(
        F.when(F.count(v) >= fewest, _iqr(v)).alias("perturb_iqr"))


def shift_iqr(windows: DataFrame, methods, shifts=WIN_SHIFTS, unstable: float | None = None,
              min_points: int = 3, keys=WINDOW_KEYS) -> DataFrame:
    """IQR over window starts.  Shifts below 0 leave the window as it is, so the
    unshifted estimate is computed once and counted with its multiplicity.
    ``unstable`` is the value below two valid estimates (NULL or +inf)."""
    starts = [max(0, s) for s in shifts]
    if _in_blocks(methods):
        rows = windows.filter(F.size("ys") - min(starts) >= min_points)
        return _spreads(rows, F.col("ys"), blocks.spreads(methods, 2, unstable, starts, min_points), list(methods), keys, "shift_iqr")
    weights = {s: starts.count(s) for s in sorted(set(starts))}
    est = forecast(C.shifted(windows, tuple(weights), min_points), methods)
    weight = F.lit(0)
    for s, n in weights.items():
        weight = F.when(F.col("shift") == s, F.lit(n)).otherwise(weight)
    v = F.when(is_valid(F.col("estimate_raw")), F.col("estimate_raw"))
    # rows without a valid estimate keep weight 0 and never enter the percentile
    w = F.when(v.isNotNull(), weight).otherwise(F.lit(0))
    value = F.coalesce(v, F.lit(0.0))
    return est.groupBy(*keys).agg(
        F.when(F.sum(w) >= 2, _iqr(value, w)).otherwise(F.lit(unstable).cast("double")).alias("shift_iqr"))


def with_spreads(records: DataFrame, windows: DataFrame, methods, keys=GAP_KEYS) -> DataFrame:
    """Records with both spreads of their method on their window.  The spreads are one array per window until they are
    exploded, so the planner takes them for a small table and would collect them all on the driver to broadcast
    them; the hint keeps both joins shuffled."""
    for spread in (perturb_iqr(windows, methods, keys=keys), shift_iqr(windows, methods, keys=keys)):
        records = records.join(spread.hint("merge"), list(keys), "left")
    return records


SPREADS = ("perturb_iqr", "shift_iqr")


def packed_with_spreads(windows: DataFrame, methods, keys=GAP_KEYS, trials: int = PERTURB_TRIALS, scale: float = PERTURB_SCALE,
                        shifts=WIN_SHIFTS, min_points: int = 3) -> DataFrame:
    """Estimates and both spreads of every (window, target) as arrays over ``methods`` (see ``forecast.packed``): what
    ``with_spreads`` joins to the records, computed where the window is.  No record is shuffled."""
    methods = list(methods)
    if not _in_blocks(methods):
        raise ValueError("spreads beside the estimates need built-in plain methods")
    of_target, starts = _of_target(windows, keys), [max(0, s) for s in shifts]
    rows = windows.withColumn("_copies", C.perturbed_values(trials, scale))
    return packed(rows, methods, more={
        "perturb_iqr": _run(blocks.spreads(methods, 2, every=True), "_copies", of_target),
        "shift_iqr": _run(blocks.spreads(methods, 2, None, starts, min_points, every=True), "ys", of_target)}).drop("_copies")
