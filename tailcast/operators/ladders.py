"""Order ladders: every order of a family from one parameter sweep.

The long table has one row per (window, target, ladder, order).  Transformations
take the order as a parameter; the multi-parameter fits run in Arrow batches."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailcast.functions import blocks, fits

# fixed values: ladder -> orders
LADDERS = {
    "shanks": range(1, 11), "wynn_eps": range(1, 9), "wynn_rho": range(1, 8), "levin_t": range(1, 9), "levin_u": range(1, 9),
    "levin_v": range(1, 9), "brezinski": range(1, 7), "anderson": range(1, 7), "neville": range(1, 9),
}
# fixed values: orders of the rational ladder, and the exponents of the one-term ladder
PADE_ORDERS = [(p, q) for p in range(1, 6) for q in range(1, 6)] + [(5, 6), (7, 8), (9, 10)]
FIXED_EXPONENTS = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
# order of a ladder that equals a registered method
REGISTERED = {**{("shanks", k): f"shanks_{k}" for k in (1, 2, 3, 4)}, **{("wynn_eps", k): f"wynn_eps_{k}" for k in (1, 2, 3)},
              **{("wynn_rho", k): f"wynn_rho_{k}" for k in (1, 2, 3)}, **{("anderson", k): f"anderson_{k}" for k in (1, 2, 3)},
              **{(f"levin_{v}", k): f"levin_{v}{k}" for v in "tuv" for k in (1, 2)},
              **{("brezinski", k): f"brezinski_theta{k}" for k in (1, 2)}, **{("neville", k): f"neville_{k}" for k in (2, 3, 4)}}


def ladder_estimates(windows: DataFrame, ladders=LADDERS) -> DataFrame:
    """Estimates of every order for every target, from one Arrow function per window."""
    entries = [(name, int(k)) for name, orders in ladders.items() for k in orders]
    w = windows.withColumn("_block", blocks.estimates(entries)("xs", "ys", F.lit(0.0), F.col("targets.n_f")))
    rows = w.select("*", F.posexplode_outer("targets").alias("_at", "t"))
    start = F.col("_at") * len(entries)
    rows = rows.withColumn("_all", F.array(*[F.struct(F.lit(name).alias("ladder"), F.lit(k).alias("order"), F.get("_block", start + i).alias("estimate_raw"))
                                             for i, (name, k) in enumerate(entries)]))
    keep = [c for c in windows.columns if c not in ("xs", "ys", "targets")]
    fields = [f.name for f in windows.schema["targets"].dataType.elementType.fields]
    return rows.select(*keep, *[F.col(f"t.{c}").alias(c) for c in fields], F.inline_outer("_all")).withColumn(
        "method", F.concat_ws(":", "ladder", F.col("order").cast("string")))


def fit_ladder(windows: DataFrame) -> DataFrame:
    """Rational ladder (orders p and q) and one-term ladder with fixed exponents; parameters once per window."""
    pars = {f"_p_{p}_{q}": fits.pade_parameters((p, q))(F.col("xs"), F.col("ys")) for p, q in PADE_ORDERS}
    pars.update({f"_f_{i}": fits.power_line(F.col("ys"), F.col("xs"), a) for i, a in enumerate(FIXED_EXPONENTS)})
    rows = windows.withColumns(pars).select("*", F.explode_outer("targets").alias("t"))
    t = F.col("t.n_f")
    def item(ladder, estimate, p=None, q=None, exponent=None):
        name = f"{ladder}:{exponent}" if p is None else f"{ladder}:{p}/{q}"
        return F.struct(F.lit(ladder).alias("ladder"), F.lit(p).cast("int").alias("p"), F.lit(q).cast("int").alias("q"),
                        F.lit(exponent).cast("double").alias("exponent"), F.lit(name).alias("method"), estimate.alias("estimate_raw"))

    items = [item("pade", fits.at_pade((p, q), F.col(f"_p_{p}_{q}"), F.col("xs"), t), p, q) for p, q in PADE_ORDERS]
    items += [item("fixed_power", F.col(f"_f_{i}.intercept") + F.col(f"_f_{i}.slope") * fits.inverse_power(t.cast("double"), a), exponent=a)
              for i, a in enumerate(FIXED_EXPONENTS)]
    keep = [c for c in windows.columns if c not in ("xs", "ys", "targets")]
    fields = [f.name for f in windows.schema["targets"].dataType.elementType.fields]
    return rows.withColumn("_all", F.array(*items)).select(*keep, *[F.col(f"t.{c}").alias(c) for c in fields], F.inline_outer("_all"))
