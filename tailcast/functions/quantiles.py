"""Exact quantiles per group, of any size.

Groups are counted first.  Groups of at most ``GROUP_ROWS`` rows are finished in one
aggregation buffer (if no group is larger, in the same pass as the other statistics); of larger ones only the ranges that hold the wanted ranks are looked at: a histogram with
map-side partial counts names a bucket, the bucket's own range is divided again, and
what is left are the distinct values of one small part.  Each group goes the way its own size
asks for; both give the same numbers.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.session import settled

GROUP_ROWS = 100_000           # rows of a group that one aggregation buffer may hold
PARTS = 4096                   # equal parts of a histogram bucket
BUCKETS_PER_OCTAVE = 64


def quantile(value, p: float) -> Column:
    return F.percentile(value, F.lit(p))


def median(value) -> Column:
    return F.percentile(value, F.lit(0.5))


def bucket_of(v: Column) -> Column:
    """Order-preserving integer bucket of a double (infinities included)."""
    size = F.lit(100_000) + F.floor(F.lit(BUCKETS_PER_OCTAVE) * F.log2(F.abs(v)))
    big = F.lit(10_000_000)
    return (F.when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.when(v > 0, big).otherwise(-big))
            .when(v > 0, size).otherwise(-size)).cast("long")


def same(a: str, b: str, keys) -> Column:
    """Null-safe equality on the group keys (NULL is a group as well)."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))


def _spread_values(df: DataFrame, keys, value: str, ranks, weight: str | None) -> DataFrame:
    """Values at 0-based ranks of each group's sorted values.  ``ranks`` maps a
    name to a function of the group size.  Rows count ``weight`` times.

    The buckets that hold a wanted rank are written first: where they are few, the planner sees that and the rows are
    picked in place instead of all being shuffled to them."""
    keys = list(keys)
    w = F.lit(1) if weight is None else F.col(weight)
    rows = (df.select(*keys, F.col(value).cast("double").alias("_v"), w.cast("long").alias("_w"))
            .filter(F.col("_v").isNotNull() & (F.col("_w") > 0)).withColumn("_b", bucket_of(F.col("_v"))))
    counts = rows.groupBy(*keys, "_b").agg(F.sum("_w").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    hist = counts.select(*keys, "_b", "_n", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"),
                         F.sum("_n").over(whole).alias("_total"))
    at = {name: rank(F.col("_total")) for name, rank in ranks.items()}

    def holds(rank, start, size):
        return (F.col(start) <= rank) & (rank < F.col(start) + F.col(size))

    wanted = settled(hist.filter(reduce(lambda x, y: x | y, [holds(r, "_before", "_n") for r in at.values()])), "buckets")
    inner = (rows.alias("r").join(wanted.alias("w"), same("r", "w", keys) & (F.col("r._b") == F.col("w._b")))
             .select(*[F.col(f"r.{k}").alias(k) for k in keys], F.col("r._b").alias("_b"), "_v", "_w", "_before", "_total"))
    inner = settled(inner, "picked")
    # second level: equal parts of the range that the bucket really has
    ranges = inner.groupBy(*keys, "_b").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    inner = (inner.alias("r").join(ranges.alias("w"), same("r", "w", keys) & (F.col("r._b") == F.col("w._b")))
             .select("r.*", "w._low", "w._high"))
    share = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
    inner = inner.withColumn("_p", F.when((F.col("_high") > F.col("_low")) & (F.abs("_v") < float("inf")), F.floor(share * PARTS)).otherwise(0).cast("int"))
    parts = inner.groupBy(*keys, "_b", "_p").agg(F.sum("_w").alias("_n"), F.max("_before").alias("_before"), F.max("_total").alias("_total"))
    earlier = Window.partitionBy(*keys, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    parts = parts.filter(reduce(lambda x, y: x | y, [holds(r, "_before", "_n") for r in at.values()]))
    picked = (inner.drop("_before", "_total").alias("r").join(parts.alias("w"), same("r", "w", keys) & (F.col("r._b") == F.col("w._b")) & (F.col("r._p") == F.col("w._p")))
              .groupBy(*[F.col(f"r.{k}").alias(k) for k in keys], F.col("r._b").alias("_b"), F.col("r._p").alias("_p"), "_v", "_before", "_total")
              .agg(F.sum("_w").alias("_c")))
    inside = Window.partitionBy(*keys, "_b", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = picked.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    return placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *[
        F.max(F.when(holds(r, "_at", "_c"), F.col("_v"))).alias(n) for n, r in at.items()])


def spread_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float], weight: str | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation) of ``value`` per group; ``probs``
    maps output name -> probability.  Tasks hold distinct values of one part."""
    ranks = {}
    for name, p in probs.items():
        ranks[f"_lo_{name}"] = lambda n, p=p: F.floor(F.lit(float(p)) * (n - 1))
        ranks[f"_hi_{name}"] = lambda n, p=p: F.ceil(F.lit(float(p)) * (n - 1))
    found = _spread_values(df, keys, value, ranks, weight)
    out = []
    for name, p in probs.items():
        a, b = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        out.append(F.when(a == b, a).otherwise(a + (b - a) * (pos - F.floor(pos))).alias(name))
    return found.select(*keys, *out)


def _sized(df: DataFrame, keys, n: DataFrame) -> DataFrame:
    """Rows with the size of their group; ``n`` has one row per group."""
    if not keys:
        return df.crossJoin(F.broadcast(n.select("_rows")))
    return (df.alias("r").join(n.select(*keys, "_rows").alias("w"), same("r", "w", keys)).select("r.*", "w._rows"))


def _joined(a: DataFrame, b: DataFrame, keys, names, how: str = "left") -> DataFrame:
    if not keys:
        return a.crossJoin(F.broadcast(b.select(*names)))
    return a.alias("a").join(b.alias("b"), same("a", "b", keys), how).select("a.*", *[F.col(f"b.{n}") for n in names])


def _largest(df: DataFrame, keys) -> int:
    """Rows of the largest group: a count that reads no column but the keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def order_statistics(df: DataFrame, keys, value: str, ranks) -> DataFrame:
    """Values at given ranks per group plus the group size ``n``; ``ranks`` maps
    a name to a function of the group size (0-based)."""
    keys = list(keys)
    rows = df.select(*keys, value).filter(F.col(value).isNotNull())
    if _largest(df, keys) <= GROUP_ROWS:
        g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_s")).withColumn("n", F.size("_s").cast("long"))
        return g.select(*keys, "n", *[F.get("_s", r(F.col("n")).cast("int")).alias(name) for name, r in ranks.items()])
    sized = _sized(rows, keys, settled(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), "groups"))
    g = sized.filter(F.col("_rows") <= GROUP_ROWS).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_s")).withColumn("n", F.size("_s").cast("long"))
    small = g.select(*keys, "n", *[F.get("_s", r(F.col("n")).cast("int")).alias(name) for name, r in ranks.items()])
    large = _spread_values(sized.filter(F.col("_rows") > GROUP_ROWS), keys, value, ranks, None).withColumnRenamed("_total", "n")
    return small.unionByName(large.select(small.columns))


def grouped(df: DataFrame, keys, aggs: list[Column], quantiles: dict[str, tuple[str, float]], weight: str | None = None) -> DataFrame:
    """``groupBy(keys)`` with plain aggregates and exact quantiles
    (output name -> (column, probability)), rows counted ``weight`` times."""
    keys = list(keys)
    by_column: dict[str, dict[str, float]] = {}
    for name, (col, p) in quantiles.items():
        by_column.setdefault(col, {})[name] = p
    freq = [] if weight is None else [F.col(weight).cast("long")]
    arrays = [F.percentile(col, F.array(*[F.lit(float(p)) for p in probs.values()]), *freq).alias(f"_q_{i}") for i, (col, probs) in enumerate(by_column.items())]
    picks = {n: F.get(f"_q_{i}", F.lit(j)) for i, probs in enumerate(by_column.values()) for j, n in enumerate(probs)}
    rows = F.count(F.lit(1)).alias("_rows")
    if not by_column or _largest(df, keys) <= GROUP_ROWS:
        one = df.groupBy(*keys).agg(rows, *aggs, *arrays)
        return one.withColumns(picks).drop("_rows", *[f"_q_{i}" for i in range(len(arrays))])
    base = settled(df.groupBy(*keys).agg(rows, *aggs), "groups")      # few groups: rows learn their group's size in place
    extra = [weight] if weight and weight not in by_column else []
    used = df.select(*[F.col(k) for k in keys], *[F.col(c).cast("double").alias(c) for c in by_column if c not in keys], *extra)
    sized = _sized(used, keys, base)
    small = sized.filter(F.col("_rows") <= GROUP_ROWS).groupBy(*keys).agg(*arrays).select(*keys, *[c.alias(n) for n, c in picks.items()])
    # large groups: all columns go through one histogram, as rows that name their column
    long = sized.filter(F.col("_rows") > GROUP_ROWS).select(*keys, *([F.col(weight).alias("_weight")] if weight else []), F.explode(F.array(*[
        F.struct(F.lit(i).alias("_col"), F.col(c).alias("_value")) for i, c in enumerate(by_column)])).alias("_x")).select(*keys, *(["_weight"] if weight else []), "_x.*")
    probs = sorted({p for wanted in by_column.values() for p in wanted.values()})
    found = spread_quantiles(long, [*keys, "_col"], "_value", {f"_p{j}": p for j, p in enumerate(probs)}, "_weight" if weight else None)
    large = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_col") == i, F.col(f"_p{probs.index(p)}"))).alias(n)
                                       for i, wanted in enumerate(by_column.values()) for n, p in wanted.items()])
    if not keys:
        both = small.unionByName(large.select(small.columns)).agg(*[F.max(n).alias(n) for n in quantiles])
        return base.crossJoin(F.broadcast(both)).drop("_rows")
    return _joined(base, small.unionByName(large.select(small.columns)), keys, list(quantiles)).drop("_rows")
