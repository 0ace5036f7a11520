"""Session settings and materialised stages."""
from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast import settings

_stages: dict[tuple[str, str], DataFrame] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (SparkSession.builder.master(f"local[{cores}]").appName("tailcast")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "12g")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")     # call sites of thousands of expressions
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Only under a local master a
    temporary folder takes its place; executors of a cluster would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tailcast-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _stamp(spark: SparkSession, key: str) -> str:
    """What a stage depends on besides its name: the settings, and names, sizes and times of the files
    in the folder that the key begins with."""
    constants = sorted((k, repr(v)) for k, v in vars(settings).items() if k.isupper())
    session = [spark.conf.get(k) for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled")]
    folder = spark._jvm.org.apache.hadoop.fs.Path(key.split("|")[0])
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in system.listStatus(folder)) if system.exists(folder) else []
    return repr((constants, session, files))


def stage(spark: SparkSession, name: str, key: str, build) -> DataFrame:
    """Write ``build()`` once per application as a Parquet table in the shared
    folder and read it back.  The table, not a cached block, is the boundary
    between jobs, so losing an executor costs one task and not the lineage."""
    app = spark.sparkContext.applicationId
    token = f"{name}-{hashlib.md5((key + _stamp(spark, key)).encode()).hexdigest()[:12]}"
    known = _stages.get((app, token))
    if known is not None:
        return known
    path = f"{checkpoint_root(spark).rstrip('/')}/{app}/{token}"
    build().write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    _stages[(app, token)] = table
    return table


def settled(df: DataFrame, name: str) -> DataFrame:
    """An intermediate table that several parts of one plan read: written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FEW_ROWS = 200_000             # rows of a table of which a copy may go to every task


def for_every_task(df: DataFrame, most: int = FEW_ROWS) -> DataFrame | None:
    """The table marked for broadcasting where it has few rows, counted first; else nothing."""
    return F.broadcast(df) if df.count() <= most else None
