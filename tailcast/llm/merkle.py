"""Merkle manifest of a dataset: leaf coordinates by bitmap rank, levels reduced in keyed slot arrays.

Per group, the keys present are one compressed bitmap: 64-bit words, of which only those with a bit set exist,
merged by OR with map-side combining.  Word counts add up to a directory, so a leaf's place is the directory's
entry plus the bits below its own: leaves are never sorted.  A block of 256 neighbouring places is a slot array
that one task reduces by eight levels; block roots are the leaves of the next round."""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stage

ARITY = 2
LEVELS = 8                     # levels that a block reduces
BLOCK = ARITY ** LEVELS
WORDS = 1024                   # words of a container of the bitmap
NULL_WORD = -(1 << 62)         # below every word of a 64-bit key

STEPS = "array<struct<`left`:string,`right`:string>>"
_STEP = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def field(value: Column) -> Column:
    """A value in a leaf: ``-`` if null, else its UTF-8 length, a colon and itself."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _running(rows: DataFrame, group: str, order: list[str], n: str, label: str) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over earlier rows of the group.  Rows are dealt into ranges; a range
    adds up its own and starts from the sums of earlier ranges, so no task holds a group."""
    dealt = stage(rows.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()), label)
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(group, "part").agg(F.sum(n).alias("s")).withColumn("start", F.coalesce(F.sum("s").over(earlier), F.lit(0))).drop("s")
    inside = Window.partitionBy(group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("own", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(starts, [group, "part"])
            .withColumn("before", F.col("start") + F.col("own")).drop("part", "start", "own"))


def bitmap(rows: DataFrame) -> DataFrame:
    """Words of each group's key bitmap: (g, word, bits, rows)."""
    return rows.groupBy("g", "word").agg(F.coalesce(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 as int))")), F.lit(0).cast("long")).alias("bits"), F.count(F.lit(1)).alias("n"))


def directory(words: DataFrame) -> DataFrame:
    """Adds ``base``: rows of the group in earlier words.  Containers of WORDS words are added up by ranges, words inside them by themselves."""
    words = words.withColumn("container", F.expr(f"word div {WORDS}") - F.expr(f"if(word % {WORDS} < 0, 1, 0)"))
    tops = _running(words.groupBy("g", "container").agg(F.sum("n").alias("m")), "g", ["container"], "m", "merkle-containers").select("g", "container", "before")
    inside = Window.partitionBy("g", "container").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    return (words.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(tops, ["g", "container"])
            .select("g", "word", "bits", "n", (F.col("before") + F.col("own")).alias("base")))


def with_places(rows: DataFrame) -> DataFrame:
    """Adds ``place`` to (g, k, leaf, row, ...): 0, 1, 2, ... per group by key, null first, equal keys by leaf.

    A word whose rows are as many as its bits has no repeated key: its leaves take their rank.  Only the
    rows of other words are put in order, by ranges, and numbered from the directory's entry."""
    rows = rows.withColumn("word", F.coalesce(F.expr("shiftright(k, 6)"), F.lit(NULL_WORD)))
    known = stage(rows.join(directory(stage(bitmap(rows), "merkle-bitmap")), ["g", "word"]), "merkle-ranked")
    single = F.col("n") == F.bit_count("bits")
    rank = F.bit_count(F.expr("bits & ~shiftleft(-1L, cast(k & 63 as int))"))
    plain = known.where(single).withColumn("place", F.col("base") + rank)
    again = stage(_running(known.where(~single).withColumn("one", F.lit(1)), "g", ["word", "k", "leaf", "row"], "one", "merkle-repeated"), "merkle-numbered")
    firsts = again.groupBy("g", "word").agg(F.min("before").alias("lowest"))
    tied = again.join(firsts, ["g", "word"]).withColumn("place", F.col("base") + F.col("before") - F.col("lowest"))
    return plain.unionByName(tied.select(plain.columns)).drop("word", "bits", "n", "base", "row")


def _digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels(slots: list[str], total: int) -> list[list[str]]:
    """A block's slot arrays from the bottom up, while its group has several nodes and the block levels left."""
    found = [slots]
    while total > 1 and len(found) <= LEVELS:
        below = found[-1]
        found.append([_digest(below[i:i + ARITY]) for i in range(0, len(below), ARITY)])
        total = -(-total // ARITY)
    return found


def _slots(table: pa.Table) -> tuple[list[str], list[int], int]:
    places = table.column("place").to_pylist()
    low = min(places) // BLOCK * BLOCK
    slots = [""] * len(places)
    for place, digest in zip(places, table.column("leaf").to_pylist()):
        slots[place - low] = digest
    return slots, [p - low for p in places], table.column("total")[0].as_py()


def _reduce(table: pa.Table) -> pa.Table:
    slots, _, total = _slots(table)
    return pa.table({"g": table.column("g")[:1], "place": pa.array([table.column("place")[0].as_py() // BLOCK], pa.int64()),
                     "leaf": [levels(slots, total)[-1][0]], "total": pa.array([-(-total // BLOCK)], pa.int64())})


def _descend(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Each node's steps: what stands left and right of it at every level of its block, then the block's own steps."""
    slots, own, total = _slots(nodes)
    arrays, rest = levels(slots, total)[:-1], above.column("steps")[0].as_py()
    steps = []
    for at in own:
        path = []
        for level in arrays:
            low = at // ARITY * ARITY
            path.append({"left": "".join(level[low:at]), "right": "".join(level[at + 1:low + ARITY])})
            at //= ARITY
        steps.append(path + rest)
    out = {name: nodes.column(name) for name in nodes.column_names if name not in ("total", "block")}
    out["steps"] = pa.array(steps, _STEP)
    for name in ("subroot", "root"):
        if name in above.column_names:
            out[name] = pa.array([above.column(name)[0].as_py()] * len(slots), pa.string())
    return pa.table(out)


def _block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {BLOCK}"))


def _climb(leaves: DataFrame, most: int) -> list[DataFrame]:
    """Nodes (g, place, leaf, total) of every round; the last has one per group."""
    rounds, nodes = [leaves], leaves.select("g", "place", "leaf", "total")
    while most > 1:
        nodes = stage(_block(nodes).groupBy("g", "block").applyInArrow(_reduce, "g string, place bigint, leaf string, total bigint"), "merkle-round")
        rounds.append(nodes)
        most = -(-most // BLOCK)
    return rounds


def _paths(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """Steps of the lowest round's nodes, from ``top``: (g, place, steps, ...) of the highest round's."""
    paths = top
    for nodes in reversed(rounds[:-1]):
        cells = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name != "total")
        more = ", ".join(f"{c} string" for c in ("subroot", "root") if c in paths.columns)
        paths = (_block(nodes).groupBy("g", "block").cogroup(paths.drop("leaf").groupBy("g", "place"))
                 .applyInArrow(_descend, f"{cells}, steps {STEPS}" + (f", {more}" if more else "")))
    return paths


def manifest(docs: DataFrame, columns=("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: key, group, place (among the group's leaves), leaf, subroot, root, steps, and the
    ``carry`` columns computed from the document.  ``steps`` lead from the leaf to the root: each has
    the digests left and right of the node, and the next node is the hash of left, node and right.

    A leaf hashes ``columns``.  The key is an integer column; null keys come first, rows of equal keys are ordered by
    leaf, and equal leaves take neighbouring places.  A null group is a group of its own and comes
    first.  Null and empty texts differ.  Other columns are not read; an empty table gives no rows.

    Documents are read once; afterwards rows are as wide as their digests and ``carry``."""
    own = [F.col(group).alias("own_group")]
    named = [c.alias("carry_" + n) for n, c in (carry or {}).items()]
    rows = stage(docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(key).cast("long").alias("k"), leaf_of([F.col(c) for c in columns]).alias("leaf"),
                             F.monotonically_increasing_id().alias("row"), *own, *named), "merkle-leaves")
    totals = stage(rows.groupBy("g").agg(F.count(F.lit(1)).alias("total")), "merkle-groups")
    most, groups = totals.agg(F.coalesce(F.max("total"), F.lit(0)), F.count(F.lit(1))).first()
    leaves = stage(with_places(rows).join(totals, "g"), "merkle-placed")
    discard(rows)
    rounds = _climb(leaves, most)
    subroots = rounds[-1].select("g", F.col("leaf").alias("subroot"))
    numbered = _running(subroots.withColumns({"all": F.lit(""), "one": F.lit(1)}), "all", ["g"], "one", "merkle-subroots")
    tops = stage(numbered.select(F.lit("").alias("g"), F.col("before").cast("long").alias("place"), F.col("subroot").alias("leaf"), F.lit(groups).cast("long").alias("total"), F.col("g").alias("name")), "merkle-tops")
    heights = _climb(tops, groups)
    root = heights[-1].select("g", "place", F.expr(f"cast(array() as {STEPS})").alias("steps"), F.col("leaf").alias("root"), *[c for c in ("name", "leaf") if len(heights) == 1 and c in tops.columns])
    above = stage(_paths(heights, root).select(F.col("name").alias("g"), F.lit(0).cast("long").alias("place"), "steps", F.col("leaf").alias("subroot"), "root"), "merkle-roots")
    found = _paths(rounds, above) if len(rounds) > 1 else leaves.drop("total").join(above.drop("place"), "g")
    return found.select(F.col("k").alias(key), *([F.col("own_group").alias(group)] if group != key else []), "place", "leaf", "subroot", "root", "steps", *[F.col("carry_" + n).alias(n) for n in carry or {}])


def proof_of(steps: Column) -> Column:
    """Hash of all siblings from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its steps."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))
