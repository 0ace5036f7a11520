"""Six window features.  Each is an expression on the window arrays, so a
feature table costs one projection over the windows."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailcast.functions import blocks, fits
from tailcast.functions.arrays import deltas, finite, let, mean, ols, total
from tailcast.operators.curves import with_neighbours
from tailcast.session import settled
from tailcast.settings import FEATURES


def base_level(limit: Column, smallest: Column) -> Column:
    """max(0, min(assumed limit, half the window minimum)), 0 for a window that
    touches zero."""
    return F.when(smallest <= 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(limit, F.lit(0.5) * smallest)))


def _variance(arr: Column) -> Column:
    return let(mean(arr), lambda m: total(F.transform(arr, lambda v: (v - m) * (v - m))) / F.size(arr))


def log_log_slope() -> Column:
    above = F.filter(F.arrays_zip("xs", "ys"), lambda p: p["ys"] > F.col("L0"))
    return F.when(F.size(above) >= 3, ols(
        F.transform(above, lambda p: F.ln(F.greatest(p["xs"], F.lit(1.0)))),
        F.transform(above, lambda p: F.ln(p["ys"] - F.col("L0"))))["slope"])


def curvature_index() -> Column:
    return F.when(F.size("ys") >= 3, let(deltas(deltas(F.col("ys"))), lambda d: mean(
        F.transform(d, lambda v: F.abs(v)))) / (F.col("max_v") - F.col("min_v") + 1e-15))


def oscillation_index() -> Column:
    def changes(d):
        return total(F.transform(F.zip_with(F.slice(d, 1, F.size(d) - 1), F.slice(d, 2, F.size(d) - 1),
                                            lambda a, b: a * b), lambda v: F.when(v < 0, 1.0).otherwise(0.0)))
    return F.when(F.size("ys") >= 3, let(deltas(F.col("ys")), changes) / F.greatest(F.size("ys") - 2, F.lit(1)))


def noise_variance() -> Column:
    return F.when(F.size("ys") >= 4, let(deltas(deltas(F.col("ys"))), _variance))


def ratio_variation() -> Column:
    ratios = F.zip_with(F.slice("ys", 2, F.greatest(F.size("ys") - 1, F.lit(0))),
                        F.slice("ys", 1, F.greatest(F.size("ys") - 1, F.lit(0))),
                        lambda b, a: b / F.greatest(F.abs(a), F.lit(1e-15)))
    return F.when(F.size("ys") >= 4, let(ratios, lambda r: F.sqrt(_variance(r)) / (F.abs(mean(r)) + 1e-15)))


def features(windows: DataFrame) -> DataFrame:
    """Add the six features (NULL where a window is too short).  They are computed on blocks of windows in Arrow functions;
    ``column_features`` are the same as Columns."""
    w = windows.withColumn("L0", base_level(F.col("L_hat"), F.col("min_v")))
    w = w.withColumns({"_pl": fits.fixed_limit_parameters("power", (0.0, 5.0))(F.col("xs"), F.col("ys"), F.col("L0")),
                       "_shape": blocks.shapes()(F.col("xs"), F.col("ys"), F.col("L0"), F.col("mean_v"), F.col("max_v") - F.col("min_v"))})
    found = {n: F.get("_shape", F.lit(i)) for i, n in enumerate(blocks.SHAPE)}
    r2 = _explained(found.pop("spread"))
    return w.withColumns({n: r2 if n == "richardson_r2" else found[n] for n in COLUMNS}).drop("_pl", "_shape", "L0")


COLUMNS = ("log_log_slope", "curvature_idx", "oscillation_idx", "noise_var", "richardson_r2", "diff_ratio_cv")


def _explained(spread: Column) -> Column:
    r2 = F.lit(1.0) - F.get("_pl", F.lit(3)) / (spread + 1e-20)
    return F.least(F.greatest(r2, F.lit(-10.0)), F.lit(1.0))


def column_features(windows: DataFrame) -> DataFrame:
    w = windows.withColumn("L0", base_level(F.col("L_hat"), F.col("min_v")))
    w = w.withColumn("_pl", fits.fixed_limit_parameters("power", (0.0, 5.0))(F.col("xs"), F.col("ys"), F.col("L0")))
    spread = total(F.transform("ys", lambda v: (v - F.col("mean_v")) * (v - F.col("mean_v"))))
    made = (log_log_slope(), curvature_index(), oscillation_index(), noise_variance(), _explained(spread), ratio_variation())
    return w.withColumns(dict(zip(COLUMNS, made))).drop("_pl", "L0")


def cell_features(feats: DataFrame, cell=("family", "depth", "noise")) -> DataFrame:
    return feats.groupBy(*cell).agg(*[F.avg(f).alias(f) for f in FEATURES])


def previous_values(curves: DataFrame) -> DataFrame:
    """Differences, ratios and sign changes per step, with the two values before
    (long form, for curves that are not cut into windows)."""
    d = with_neighbours(curves.select("curve_id", "step", "value"), 2)
    prev, last = F.get("before", F.lit(0))["value"], F.get("before", F.lit(1))["value"]
    d = d.select("curve_id", "step", "value", prev.alias("prev"), (F.col("value") - prev).alias("diff"), (prev - last).alias("prev_diff"))
    return d.select("curve_id", "step", "value", "diff", F.when(F.col("prev").isNotNull(), F.col("value") / F.greatest(F.abs("prev"), F.lit(1e-15))).alias("ratio"),
                    (F.col("diff") - F.col("prev_diff")).alias("second_diff"),
                    F.coalesce(F.col("diff") * F.col("prev_diff") < 0, F.lit(False)).cast("int").alias("sign_change"))


PIVOTS = 64                    # centroids that divide the others into balls
INDEX_ROWS = 100_000           # centroids of which a copy may go to every task
SLACK = 1e-9                   # bounds are relaxed by this share, so rounding cannot exclude the nearest


def _distance(used, a, b) -> Column:
    sq = F.lit(0.0)
    for f in FEATURES:
        sq = sq + F.when(used[f], (a(f) - b(f)) * (a(f) - b(f))).otherwise(0.0)
    return F.sqrt(sq)


def centroid_index(centroids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Balls around pivots: members (pivot, reach, family, features) with their distance from the pivot, and
    one row with all pivots and the radius of each ball.  Pivots are PIVOTS centroids drawn by hash; all distances are
    over the features that are finite in every centroid."""
    usable = centroids.agg(*[F.min(finite(F.col(f)).cast("int")).alias(f"_u_{f}") for f in FEATURES])
    base = settled(centroids.select("family", *[F.col(f).cast("double").alias(f) for f in FEATURES]).crossJoin(F.broadcast(usable)), "centroids")
    pivots = (base.select(F.struct("family", *FEATURES).alias("p")).distinct().orderBy(F.xxhash64("p.family"), "p.family", "p").limit(PIVOTS)
              .agg(F.array_sort(F.collect_list("p")).alias("_pivots")))
    used = {f: F.col(f"_u_{f}") == 1 for f in FEATURES}
    near = F.array_min(F.transform("_pivots", lambda p, i: F.struct(_distance(used, F.col, lambda f: p[f]).alias("d"), i.alias("i"))))
    members = settled(base.crossJoin(F.broadcast(pivots)).withColumn("_n", near).select(
        F.col("_n.i").alias("pivot"), F.col("_n.d").alias("reach"), "family", *FEATURES), "ball-members")
    balls = members.groupBy("pivot").agg(F.max("reach").alias("radius"))
    radii = balls.agg(F.map_from_entries(F.collect_list(F.struct("pivot", "radius"))).alias("_radii"))
    return members, pivots.crossJoin(F.broadcast(radii)).crossJoin(F.broadcast(usable))


def nearest_family(cells: DataFrame, centroids: DataFrame) -> DataFrame:
    """Nearest family centroid by Euclidean distance over the features that are
    finite in the row and in every centroid; first family wins a tie.

    Centroids lie in balls around pivots.  A row first measures the pivots; the nearest bounds the answer, and
    by the triangle inequality only balls, and in them only members, that can come as near are looked at.  (A
    distance over fewer features is at most the full one, so the bounds hold for rows with gaps.)  Members go to
    every task up to INDEX_ROWS, beyond that rows and members meet by pivot."""
    members, pivots = centroid_index(centroids)
    keys = [c for c in cells.columns if c not in FEATURES]
    rows = settled(cells.withColumn("_row", F.monotonically_increasing_id()), "nearest-rows")
    used = {f: (F.col(f"_u_{f}") == 1) & finite(F.col(f)) for f in FEATURES}
    any_used = reduce(lambda x, y: x | y, used.values())
    away = F.transform("_pivots", lambda p, i: F.struct(i.alias("pivot"), _distance(used, F.col, lambda f: p[f]).alias("d")))
    seen = rows.crossJoin(F.broadcast(pivots)).filter(any_used).withColumn("_away", away)
    seen = seen.withColumn("_most", F.array_min(F.transform("_away", lambda a: a["d"])) * (1 + SLACK))
    reachable = F.filter("_away", lambda a: F.col("_radii")[a["pivot"]].isNotNull() & (a["d"] * (1 - SLACK) - F.col("_radii")[a["pivot"]] <= F.col("_most")))
    seen = seen.select("_row", *FEATURES, *[f"_u_{f}" for f in FEATURES], "_most", F.explode(reachable).alias("_a"))
    inner = members.select(F.col("pivot").alias("_pivot"), "reach", F.col("family").alias("_family"), *[F.col(f).alias(f"_c_{f}") for f in FEATURES])
    inner = F.broadcast(inner) if members.count() <= INDEX_ROWS else inner
    found = seen.join(inner, (F.col("_a.pivot") == F.col("_pivot")) & (F.col("_a.d") * (1 - SLACK) - F.col("reach") <= F.col("_most")))
    d = _distance(used, F.col, lambda f: F.col(f"_c_{f}"))
    best = found.groupBy("_row").agg(F.min(F.struct(d.alias("d"), F.col("_family").alias("family"))).alias("_n"))
    return rows.join(best, "_row", "left").select(*keys, F.coalesce("_n.family", F.lit("unknown")).alias("nearest"), F.col("_n.d").alias("distance"))


def standardise(cells: DataFrame, by: DataFrame) -> DataFrame:
    """z-scores of the features with the mean and sample deviation of ``by``."""
    stats = by.agg(*[F.avg(f).alias(f"_m_{f}") for f in FEATURES], *[F.stddev_samp(f).alias(f"_s_{f}") for f in FEATURES])
    return cells.crossJoin(F.broadcast(stats)).withColumns({
        f: F.try_divide(F.col(f) - F.col(f"_m_{f}"), F.col(f"_s_{f}")) for f in FEATURES}).drop(
        *[f"_m_{f}" for f in FEATURES], *[f"_s_{f}" for f in FEATURES])
