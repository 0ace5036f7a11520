"""Sensitivity sweeps: the same study under other assumed limits or window lengths."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailcast.functions.quantiles import grouped
from tailcast.operators.curves import assumed_limit, check_mode, summarise
from tailcast.operators.panels import TAGS, exclude_capped, rate4, rounded
from tailcast.operators.rules import cascade, rule_panels


def across_modes(windows: DataFrame, modes) -> DataFrame:
    """Each window under each assumed-limit mode (a handful of modes)."""
    for m in modes:
        check_mode(m)
    options = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), assumed_limit(m, F.col("min_v"), F.col("L_true")).alias("limit"))
                                  for m in modes])).alias("_m")
    return windows.drop("assumed_mode", "L_hat").select("*", options).select(
        "*", F.col("_m.mode").alias("assumed_mode"), F.col("_m.limit").alias("L_hat")).drop("_m")


def across_lengths(windows: DataFrame, lengths) -> DataFrame:
    """Each window cut to its last ``n`` steps for every length; the windows must
    have been built with the largest length."""
    rows = windows.select("*", F.explode(F.array(*[F.lit(int(n)) for n in lengths])).alias("window_len"))
    keep = F.filter(F.arrays_zip("xs", "ys"), lambda p: p["xs"] >= F.col("depth") - F.col("window_len") + 1)
    rows = rows.withColumn("_k", keep).withColumns({
        "xs": F.transform("_k", lambda p: p["xs"]), "ys": F.transform("_k", lambda p: p["ys"])}).drop("_k")
    rows = summarise(rows)
    return rows.withColumn("L_hat", F.when(F.col("assumed_mode") == "winmin", F.greatest(F.lit(0.0), F.lit(0.9) * F.col("min_v")))
                           .otherwise(F.col("L_hat")))


def cascade_sweep(records: DataFrame, decisions: DataFrame, sweep: str, extra=()) -> DataFrame:
    """Rule panel of the cascade per sweep value, every window a cell of its own.

    ``decisions``: (curve_id, depth, noise, sweep, chosen) per window."""
    keys = ("curve_id", "depth", "noise", "target_g", sweep)
    by = [sweep + "_by", "g", "sigma", "regime_set", *extra]
    base = exclude_capped(records).filter("method = 'last_value'").select(*keys, "family", "is_holdout")
    flags = base.join(decisions, ["curve_id", "depth", "noise", sweep]).select(
        *keys, F.col(sweep).alias(sweep + "_by"), F.col("target_g").alias("g"), F.col("noise").alias("sigma"),
        F.when(F.col("is_holdout") == 1, "holdout").otherwise("core").alias("regime_set"), *extra,
        F.lit("rational_fit").alias("alternative"), (F.col("chosen") == "rational_fit").cast("int").alias("fired"))
    recs = records.withColumn("run_", F.lit(0))
    out = rule_panels(flags, recs, keys=keys, run="run_", by=(*by, "alternative"))
    return out.drop("alternative").withColumnsRenamed({sweep + "_by": sweep, "g": "target_g", "sigma": "noise"})


def decisions(features: DataFrame, sweep: str) -> DataFrame:
    return features.select("curve_id", "depth", "noise", sweep, cascade().alias("chosen"))


def consumer_table(records: DataFrame, keys=("assumed_mode", "method", "target_g")) -> DataFrame:
    """Rates and medians of the methods that read the assumed limit, per mode,
    pooled over noise and for each noise level."""
    rows = exclude_capped(records).select("*", F.explode(F.array(F.col("noise").cast("string"), F.lit("all"))).alias("noise_level"))
    rows = rows.withColumn("regime_set", F.when(F.col("is_holdout") == 1, "holdout").otherwise("core"))
    out = grouped(rows, [*keys, "noise_level", "regime_set"], [
        F.count(F.lit(1)).alias("n"), rate4(F.avg(F.col("valid").cast("double"))).alias("valid_rate"),
        rate4(F.avg(F.col("catastrophic").cast("double"))).alias("cat_rate"),
        *[F.avg(F.col(f"win_vs_{t}").cast("double")).alias(f"win_rate_vs_{t}") for t in TAGS]],
        {"med_error": ("error", 0.5), "med_skill": ("skill", 0.5)})
    return rounded(out, [f"win_rate_vs_{t}" for t in TAGS])
