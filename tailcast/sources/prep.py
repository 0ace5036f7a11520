"""Tabular preparation for the boosting-curve source."""
from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailcast.functions.quantiles import grouped


def tabular(df: DataFrame, categories, numbers) -> DataFrame:
    """Integer codes for categories (alphabetical, NULL = -1) and exact medians
    for missing numbers.  Codes come from the distinct values, not from a sort of
    the rows."""
    model = StringIndexer(inputCols=list(categories), outputCols=[f"{c}_code" for c in categories],
                          stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
    sizes = [len(labels) for labels in model.labelsArray]
    out = model.transform(df)
    out = out.withColumns({f"{c}_code": F.when(F.col(f"{c}_code") >= n, -1).otherwise(F.col(f"{c}_code")).cast("int")
                           for c, n in zip(categories, sizes)})
    if not numbers:
        return out
    mids = grouped(df, [], [F.count(F.lit(1)).alias("_n")], {f"_m_{c}": (c, 0.5) for c in numbers}).drop("_n")
    return out.crossJoin(F.broadcast(mids)).withColumns({c: F.coalesce(c, f"_m_{c}") for c in numbers}).drop(*[f"_m_{c}" for c in numbers])


def hash_position(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def stratified_split(df: DataFrame, label: str, key: Column, share: float) -> DataFrame:
    """Exact share per label: rows at or below the label's quantile of a hash of
    the key train, the rest validate.  No label is sorted in one task."""
    d = df.withColumn("_h", hash_position(key).cast("double"))
    cut = grouped(d, [label], [F.count(F.lit(1)).alias("_n")], {"_cut": ("_h", share)})
    return (d.join(cut.drop("_n"), label)
            .withColumn("is_train", (F.col("_h") <= F.col("_cut")).cast("int")).drop("_h", "_cut"))


def boosting_curve(df: DataFrame, key: str, numbers, categories, label: str, rounds: int = 500) -> DataFrame:
    """Validation log loss after every boosting round, one row per round.  The
    staged trees of the fitted ensemble are scored in one pass over the
    validation rows."""
    data = tabular(df, categories, numbers)
    split = stratified_split(data, label, F.col(key), 0.8)
    assembled = VectorAssembler(inputCols=[*numbers, *[f"{c}_code" for c in categories]], outputCol="features").transform(split)
    train, val = assembled.filter("is_train = 1"), assembled.filter("is_train = 0")
    model = GBTClassifier(labelCol=label, maxDepth=6, maxIter=rounds, stepSize=0.05, seed=42, maxBins=64).fit(train)
    losses = model.evaluateEachIteration(val)
    return df.sparkSession.createDataFrame([(i + 1, float(v)) for i, v in enumerate(losses)], "step int, value double")
