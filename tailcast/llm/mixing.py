"""Mixing sources to target weights by hash-seeded Poisson replication."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, stage

TEMPERATURE = 0.5              # default target weights: rows of a source to this power
PIECE = 8.0                    # largest rate inverted at once; a Poisson sum of smaller ones makes the rest
TERMS = 64                     # steps of the distribution function; beyond them it is 1 in double precision


def draw(key: Column, number: Column | int, seed: int) -> Column:
    """A uniform number in [0, 1) from the key, the draw's number and the seed: 52 bits of an MD5."""
    number = number if isinstance(number, Column) else F.lit(number)
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), number.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def repetition_rates(docs: DataFrame, source: str = "source", weights: dict | None = None, rows_out: int | None = None) -> DataFrame:
    """Per source: rows, rate (mean copies per row), pieces, and the distribution function of one piece.
    ``weights`` gives targets by source (absent: 0); without them a source weighs rows ** TEMPERATURE.
    ``rows_out`` is the expected size of the mixture, by default that of the input."""
    counts = stage(docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("rows")), "mix-counts")
    if weights is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(TEMPERATURE))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = counts.withColumn("weight", weight)
    total = weighed.agg(F.sum("weight").alias("w"), F.sum("rows").alias("n")).first()
    out = float(rows_out if rows_out is not None else (total["n"] or 0))
    rate = F.col("weight") / F.lit(total["w"] or 1.0) * out / F.col("rows")
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")
    start = F.struct(F.exp(-F.col("piece")).alias("p"), F.array(F.exp(-F.col("piece"))).alias("cdf"))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, lambda s, i: F.struct(
        (s["p"] * F.col("piece") / i).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * F.col("piece") / i)).alias("cdf")), lambda s: s["cdf"])
    return stage(weighed.withColumn("rate", rate).withColumn("pieces", pieces).withColumn("piece", F.col("rate") / F.col("pieces"))
                 .select("source", "rows", "rate", "pieces", grown.alias("cdf")), "mix-rates")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict | None = None, rows_out: int | None = None,
        seed: int = 17, extra: bool = True) -> DataFrame:
    """``docs`` with each row repeated by a Poisson count whose mean is its source's rate, in a global
    shuffle: rows are dealt to partitions and ordered inside them by a hash of key, copy and seed.

    The count inverts the distribution function at a uniform number hashed from the key, so it depends
    on nothing but key, seed and rate, and rows that repeat a key repeat its count; a null key is hashed
    as an empty one, a null source is a source of its own, a source without weight vanishes.  All columns
    are kept; with ``extra`` also ``copy`` (from 0) and ``shuffle_key`` follow, replacing columns so
    named.  An empty table gives no rows.  Rates are broadcast up to BROADCAST_ROWS sources, else joined."""
    rates = repetition_rates(docs, source, weights, rows_out)
    side = small(rates, BROADCAST_ROWS // 10).select(F.col("source").alias("__mix_source"), F.col("pieces").alias("__mix_pieces"), F.col("cdf").alias("__mix_cdf"))
    k = F.col(f"`{key}`")
    count = F.aggregate(F.sequence(F.lit(1), F.col("__mix_pieces")), F.lit(0),
                        lambda n, i: n + F.size(F.filter("__mix_cdf", lambda c: c <= F.col("__mix_u")[i - 1])))
    draws = F.transform(F.sequence(F.lit(1), F.col("__mix_pieces")), lambda i: draw(k, i, seed))
    rows = (docs.join(side, F.col(f"`{source}`").eqNullSafe(F.col("__mix_source"))).withColumn("__mix_u", draws).withColumn("__mix_n", count)
            .where("__mix_n > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(0), F.col("__mix_n") - 1))))
    text = F.concat_ws(":", F.coalesce(k.cast("string"), F.lit("")), F.col("__mix_copy").cast("string"), F.lit(f"place-{seed}"))
    rows = rows.withColumn("__mix_place", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"))
    spread = rows.repartition("__mix_place").sortWithinPartitions("__mix_place")
    own = [F.col(f"`{c}`") for c in docs.columns if not (extra and c in ("copy", "shuffle_key"))]
    return spread.select(*own, *([F.col("__mix_copy").alias("copy"), F.col("__mix_place").alias("shuffle_key")] if extra else []))


def poisson_count(u: float, rate: float) -> int:
    """The same inversion for one number, for tests."""
    p = c = math.exp(-rate)
    n = 0
    while c <= u and n < TERMS:
        n += 1
        p = p * rate / n
        c += p
    return n
