"""Registry of named queries: name -> callable(spark, sf_dir) -> DataFrame."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for presentation; NaN never leaves a query."""
    fixed = {f.name: F.round(f.name, digits) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(fixed) if fixed else df


def query(name: str, digits: int = 6):
    def register(fn):
        def run(spark, sf_dir):
            return tidy(fn(spark, sf_dir), digits)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return register


def load() -> dict:
    from tailcast.plans import queries_analysis, queries_curves, queries_selection  # noqa: F401
    return QUERIES
