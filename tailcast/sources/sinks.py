"""Result sinks: ordered tables, the excluded-set artifact, extracts, blocks, provenance."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.session import checkpoint_root
from tailcast.settings import RANK_MIN_VALID

SCHEMA = "excluded-set/1"
CRITERION = "mean cell validity below the floor on uncapped core cells"
ARTIFACT = ("schema string, criterion string, rank_min_valid double, dangerous_methods array<string>, "
            "table array<struct<method string, is_trivial int, eligible int, valid_rate double, cat_rate double, "
            "med_error double, n_cells bigint, dangerous int>>")


def scratch(spark: SparkSession, name: str, key: str) -> str:
    """A folder of this application under the shared checkpoint folder."""
    tag = "".join(ch if ch.isalnum() else "_" for ch in key)[-40:]
    return f"{checkpoint_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{tag}"


def write_result(df: DataFrame, path: str, columns, order, partition_by=()) -> str:
    """Fixed column order; rows sorted inside range partitions, so the sort is
    distributed and the files are in order."""
    out = df.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def csv_round_trip(spark: SparkSession, df: DataFrame, keys, values, key: str) -> DataFrame:
    """Write doubles as text, read them back with a fixed schema and count the
    values that are not bit-identical."""
    path = scratch(spark, "round-trip", key)
    part = df.select(*keys, *values)
    part.write.mode("overwrite").option("header", True).csv(path)
    back = spark.read.schema(part.schema).option("header", True).csv(path)
    from tailcast.operators.pairing import compare_tables
    return compare_tables(part, back, keys, values)


def write_excluded(table: DataFrame, path: str) -> str:
    """The excluded set as one JSON document (accelerators only; at most one row
    per registered method, so a single file is right)."""
    rows = table.filter("eligible = 1")
    if rows.filter("is_trivial = 1 AND dangerous = 1").limit(1).count():
        raise ValueError("only accelerators can be excluded")
    entry = F.struct("method", "is_trivial", "eligible", "valid_rate", "cat_rate", "med_error", "n_cells", "dangerous")
    doc = rows.agg(F.array_sort(F.collect_list(F.when(F.col("dangerous") == 1, F.col("method")))).alias("dangerous_methods"),
                   F.array_sort(F.collect_list(entry)).alias("table")).select(
        F.lit(SCHEMA).alias("schema"), F.lit(CRITERION).alias("criterion"), F.lit(RANK_MIN_VALID).alias("rank_min_valid"),
        "dangerous_methods", "table")
    doc.coalesce(1).write.mode("overwrite").json(path)
    return path


def load_excluded(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """The excluded-set table; a missing or differently shaped artifact raises."""
    empty = "method string, valid_rate double, n_cells bigint, dangerous int"
    try:
        doc = spark.read.schema(ARTIFACT).json(path)
    except Exception as exc:
        if not required:
            return spark.createDataFrame([], empty)
        raise FileNotFoundError(f"no excluded-set artifact at {path}") from exc
    if doc.filter(F.col("schema").eqNullSafe(SCHEMA)).limit(1).count() == 0:
        raise ValueError(f"{path}: unexpected schema, expected {SCHEMA}")
    return doc.select(F.inline("table")).select("method", "valid_rate", "n_cells", "dangerous")


def write_extract(records: DataFrame, cells: DataFrame, target: float, path: str) -> str:
    """Compressed extract of the records in the uncapped cells of one target."""
    keys = ["family", "depth", "noise", "target_g"]
    keep = cells.filter((F.col("capped") == 0) & (F.col("target_g") == target)).select(*keys).distinct()
    cols = [*keys, "curve_id", "method", "valid", "error", "catastrophic"]
    (records.filter(F.col("target_g") == target).join(keep, keys, "left_semi").select(*cols)
     .repartitionByRange("family", "depth", "noise", "curve_id").sortWithinPartitions("family", "depth", "noise", "curve_id", "method")
     .write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path))
    return path


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("family string, depth int, noise double, target_g double, curve_id string, method string, "
                             "valid int, error double, catastrophic int").option("header", True).csv(path)


def write_blocks(records: DataFrame, path: str) -> str:
    """One directory per (depth, noise).  Range partitions follow the data, so a
    block is written by as many tasks as its size asks for."""
    records.repartitionByRange("depth", "noise", "curve_id").write.mode("overwrite").partitionBy("depth", "noise").parquet(path)
    return path


def read_blocks(spark: SparkSession, path: str, depth: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if depth is None else df.filter(F.col("depth") == depth)


def digest(columns) -> Column:
    """Order-free content digest: sum of a hash of every row."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, 8), 16, 10)
    return F.sum(h.cast("long"))


def provenance(records: DataFrame, columns, cell) -> DataFrame:
    """Row count, digest, cells, methods and runs of a derived table."""
    return records.agg(F.count(F.lit(1)).alias("n_rows"), digest(columns).alias("digest"),
                       F.count_distinct(*cell).alias("n_cells"), F.count_distinct("method").alias("n_methods"),
                       F.count_distinct("curve_id").alias("n_runs"), F.sum("valid").alias("n_valid"))


def record_facts(records: DataFrame) -> DataFrame:
    """Named facts as strings (section, fact, value, file, filter, formula)."""
    def when(flt, value):
        return F.sum(F.when(F.expr(flt), value).otherwise(0)) if flt else F.sum(value)
    facts = [
        ("size", "records", F.count(F.lit(1)), None, "count(*)"),
        ("size", "curves", F.count_distinct("curve_id"), None, "count distinct curve_id"),
        ("validity", "invalid accelerator records", when("is_trivial = 0 AND valid = 0", F.lit(1)), "is_trivial = 0 AND valid = 0", "count(*)"),
        ("validity", "capped records", when("capped = 1", F.lit(1)), "capped = 1", "count(*)"),
        ("catastrophe", "catastrophic records of the default", when("method = 'rational_fit'", F.col("catastrophic")), "method = 'rational_fit'", "sum(catastrophic)"),
        ("wins", "wins of the default against the last value", when("method = 'rational_fit' AND capped = 0", F.col("win_vs_last")),
         "method = 'rational_fit' AND capped = 0", "sum(win_vs_last)"),
    ]
    one = records.agg(*[value.cast("string").alias(f"v{i}") for i, (_, _, value, _, _) in enumerate(facts)])
    rows = F.explode(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(fact).alias("fact"), F.col(f"v{i}").alias("value"), F.lit("records").alias("file"),
                                        F.lit(flt or "all rows").alias("filter"), F.lit(formula).alias("formula")) for i, (section, fact, _, flt, formula) in enumerate(facts)])).alias("f")
    return one.select(rows).select("f.*")
