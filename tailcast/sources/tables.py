"""Scans: curves derived from transaction tables, wide curve files, record tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOLDOUT_FAMILIES = ("MIDDLE EAST",)

RECORD_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in
     ("curve_id", "family", "assumed_mode", "method", "method_family", "method_type")]
    + [T.StructField(c, T.IntegerType()) for c in
       ("is_holdout", "depth", "n_f", "capped", "is_trivial", "is_oracle", "valid", "valid_strict",
        "catastrophic", "win_vs_assumed", "win_vs_last", "win_vs_wmean", "win_vs_wmin")]
    + [T.StructField("run", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in
       ("noise", "L_true", "L_hat", "target_g", "achieved_g", "true_val", "curr_val", "window_max",
        "prediction_raw", "estimate", "error", "E_last", "ref_error", "skill", "improve_ratio",
        "skill_vs_assumed", "skill_vs_last", "skill_vs_wmean", "skill_vs_wmin")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prefix_sums(df: DataFrame, key: list[str], block: Column, order: list[str],
                measures: list[str], names: list[str], counter: str) -> DataFrame:
    """Running totals of ``measures`` per key in two levels: totals per (key,
    block), a running total over the few blocks of a key, then a running total
    inside each block.  No window partition ever holds more than one block, so
    a key with a third of all rows is spread over its blocks."""
    d = df.withColumn("_block", block)
    per_block = d.groupBy(*key, "_block").agg(
        *[F.sum(m).alias(f"_b_{m}") for m in measures], F.count(F.lit(1)).alias("_b_rows"))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *key, "_block",
        *[F.coalesce(F.sum(f"_b_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        F.coalesce(F.sum("_b_rows").over(before), F.lit(0)).alias("_o_rows"))
    inside = Window.partitionBy(*key, "_block").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (d.join(offsets, [*key, "_block"])
            .select(*[c for c in df.columns],
                    *[(F.col(f"_o_{m}") + F.sum(m).over(upto)).alias(n) for m, n in zip(measures, names)],
                    (F.col("_o_rows") + F.row_number().over(inside)).cast("int").alias(counter)))


def supplier_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> region.  Nation and region are 25 and 5 rows by definition of
    the schema, so that side is broadcast; the supplier side grows and is not."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return (table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
            .join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("run"), F.col("r_name").alias("family"),
                    F.col("r_name").isin(*HOLDOUT_FAMILIES).cast("int").alias("is_holdout")))


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier and day: quantity, squared quantity, rows.  Partial sums on
    the map side shrink the scan before anything is shuffled; from here a
    supplier has at most one row per calendar day."""
    return (table(spark, sf_dir, "lineitem")
            .select(F.col("l_suppkey").alias("run"), F.to_date("l_shipdate").alias("day"),
                    F.col("l_quantity").alias("qty"))
            .filter(F.col("run").isNotNull() & F.col("day").isNotNull() & F.col("qty").isNotNull())
            .groupBy("run", "day")
            .agg(F.sum("qty").alias("q"), F.sum(F.col("qty") * F.col("qty")).alias("q2"),
                 F.count(F.lit(1)).alias("n")))


def supplier_curves(spark: SparkSession, sf_dir: str, kind: str = "se", days: DataFrame | None = None) -> DataFrame:
    """One curve per supplier, one step per shipping day.

    ``mean``: running mean quantity (scaled by 50); ``se``: its standard error,
    which decays towards 0 like n^-1/2 and starts at step 2."""
    if kind not in ("se", "mean"):
        raise ValueError(f"unknown curve kind {kind!r}")
    running = prefix_sums(supplier_days(spark, sf_dir) if days is None else days, ["run"], F.year("day"), ["day"],
                          ["q", "q2", "n"], ["rq", "rq2", "rn"], "step")
    mean = F.col("rq") / F.col("rn")
    if kind == "mean":
        value = F.col("rq") / (F.lit(50.0) * F.col("rn"))
    else:
        value = (F.sqrt(F.greatest(F.col("rq2") / F.col("rn") - mean * mean, F.lit(0.0)))
                 / (F.lit(50.0) * F.sqrt(F.col("rn").cast("double"))))
        running = running.filter(F.col("step") >= 2)
    return (running.join(supplier_families(spark, sf_dir), "run")
            .select(F.format_string("s%d", "run").alias("curve_id"), "family", "is_holdout",
                    "run", "step", value.alias("value")))


def event_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running mean of ``events.value`` per user in time order (ties by event id)."""
    ev = (table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
          .filter(F.col("value").isNotNull() & F.col("ts").isNotNull()))
    running = prefix_sums(ev, ["user_id"], F.to_date("ts"), ["ts", "event_id"],
                          ["value"], ["total"], "step")
    return running.select(
        F.format_string("u%d", "user_id").alias("curve_id"), F.lit("events").alias("family"),
        F.lit(0).alias("is_holdout"), F.col("user_id").alias("run"), "step",
        (F.col("total") / F.col("step")).alias("value"))


def read_wide_curves(spark: SparkSession, path: str, index: str = "round") -> DataFrame:
    """Wide curve file (an index column, one column per curve) -> long curves.
    The header names the curves; every value is read as a double."""
    header = spark.read.option("header", True).csv(path).columns
    if index not in header:
        raise ValueError(f"{path}: no column {index!r}")
    names = [c for c in header if c != index]
    schema = T.StructType([T.StructField(c, T.IntegerType() if c == index else T.DoubleType())
                           for c in header])
    wide = spark.read.schema(schema).option("header", True).csv(path)
    return unpivot_curves(wide, index, names)


def unpivot_curves(wide: DataFrame, index: str, names: list[str]) -> DataFrame:
    long = wide.unpivot([index], names, "curve_id", "value").filter(F.col("value").isNotNull())
    return long.select("curve_id", F.col("curve_id").alias("family"), F.lit(0).alias("is_holdout"),
                       F.lit(0).cast("bigint").alias("run"), F.col(index).cast("int").alias("step"),
                       "value")


def require_columns(df: DataFrame, names, what: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df


def read_records(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """Record scan: the schema is fixed, only the asked columns are read."""
    have = spark.read.parquet(path)
    require_columns(have, RECORD_SCHEMA.fieldNames() if columns is None else columns, path)
    df = spark.read.schema(RECORD_SCHEMA).parquet(path)
    return df if columns is None else df.select(*columns)
