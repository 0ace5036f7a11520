"""Predict the family of a cell from its features."""
from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.operators.features import cell_features
from tailcast.settings import FEATURES

PROTOCOLS = ("grouped_by_depth", "grouped_by_noise", "stratified_5fold")


def classifier_table(feats: DataFrame, cell=("family", "depth", "noise")) -> DataFrame:
    """Cell features, complete rows only."""
    return cell_features(feats, cell).na.drop(subset=list(FEATURES))


def folds(table: DataFrame, protocol: str, k: int = 5) -> DataFrame:
    """Add ``fold`` (1..n): one group value per fold, or k stratified folds."""
    if protocol not in PROTOCOLS:
        raise ValueError(f"unknown protocol {protocol!r}")
    if protocol == "stratified_5fold":
        key = F.md5(F.concat_ws("|", F.col("family"), F.col("depth").cast("string"), F.col("noise").cast("string")))
        smallest = table.groupBy("family").agg(F.count(F.lit(1)).alias("n")).agg(
            F.greatest(F.lit(2), F.least(F.lit(k), F.min("n"))).alias("_k"))
        w = Window.partitionBy("family").orderBy(key, "depth", "noise")
        return table.crossJoin(F.broadcast(smallest)).withColumn(
            "fold", (F.row_number().over(w) % F.col("_k") + 1).cast("int")).drop("_k")
    group = "depth" if protocol == "grouped_by_depth" else "noise"
    values = table.select(group).distinct().withColumn("fold", F.row_number().over(Window.orderBy(group)))
    return table.join(F.broadcast(values), group)


def fold_note(n: int, protocol: str) -> str:
    if n < 2:
        return f"only {n} group value(s): the protocol cannot hold out a group"
    return f"only {n} group values: {n} folds" if n < 3 else f"{n} folds"


def predictions(table: DataFrame, protocol: str) -> DataFrame | None:
    """Out-of-fold predictions; the driver holds the fold numbers, Spark the rows."""
    table = folds(table, protocol)
    numbers = [r.fold for r in table.select("fold").distinct().orderBy("fold").collect()]
    if len(numbers) < 2:
        return None
    labels = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(table)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labels.transform(table))
    names = F.array(*[F.lit(x) for x in labels.labels])
    tree = DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=3, seed=42)
    out = None
    for i in numbers:
        model = tree.fit(data.filter(F.col("fold") != i))
        part = model.transform(data.filter(F.col("fold") == i)).select(
            F.lit(protocol).alias("protocol"), "family", "depth", "noise", F.get(names, F.col("prediction").cast("int")).alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out


def confusion(preds: DataFrame) -> DataFrame:
    """Accuracy per family and overall with the most frequent confusion."""
    hit = (F.col("family") == F.col("predicted")).cast("int")
    rows = preds.withColumn("hit", hit)
    per = rows.groupBy("protocol", "family").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("hit").alias("n_correct"))
    wrong = rows.filter("hit = 0").groupBy("protocol", "family", "predicted").agg(F.count(F.lit(1)).alias("c"))
    top = wrong.groupBy("protocol", "family").agg(F.min_by("predicted", F.struct((-F.col("c")).alias("c"), F.col("predicted"))).alias("top_confusion"))
    per = per.join(top, ["protocol", "family"], "left").withColumn("top_confusion", F.coalesce("top_confusion", F.lit("none")))
    total = rows.groupBy("protocol").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("hit").alias("n_correct")).select(
        "protocol", F.lit("__OVERALL__").alias("family"), "n_samples", "n_correct", F.lit("-").alias("top_confusion"))
    both = per.unionByName(total)
    return both.withColumn("accuracy", F.round(F.col("n_correct") / F.col("n_samples"), 3))
