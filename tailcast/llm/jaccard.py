"""Exact Jaccard join of word n-gram sets: rare-first prefixes, length, positional and suffix filters,
one verification per pair, and connected components of the links.

How large groups of near copies stay linear: equal sets become one node first; then each token of a
prefix proposes one partner to all its holders (the holder with the fewest rare n-grams before it, which is the
text the others were edited from); only tokens still held by several components are joined in full,
and there the holders outside the largest component meet the others."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, small, stage, text_of

CELLS = 32                     # parts of the hash range whose counts the suffix filter compares
HOT_HERE, HOT_CHUNK = 2, 2_000_000   # an n-gram is reported as frequent if so many different sets of a chunk hold it
HOT_TABLE = 1_000_000          # most frequent n-grams that the order knows; it decides speed, never results
SEEN = 250_000                 # nodes a task remembers so as to emit copies once
WORDS = 250_000                # word hashes a worker remembers
RECENT = 256                   # sets a worker remembers while it compares pairs
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, and a 128-bit digest of that set."""

    def __init__(self, n: int, seed: int = 0):
        self.n, self.seed, self.words = n, seed, {}
        powers = [pow(0x100000001B3, k + 1, 1 << 64) | 1 for k in range(n)]
        self.powers = [np.uint64(p) for p in powers]

    def _hash(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        if len(known) > WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def grams(self, data: bytes) -> np.ndarray:
        words = data.translate(_FOLD).split()
        if not words:
            return np.empty(0, np.uint64)
        h = self._hash(words)
        width = min(self.n, len(words))
        out = np.full(len(h) - width + 1, np.uint64(width), np.uint64)
        for k in range(width):
            out = out * _MIX + h[k:len(h) - width + 1 + k] * self.powers[k]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)

    def digest(self, grams: np.ndarray) -> bytes:
        return xxhash.xxh3_128_digest(grams.tobytes(), self.seed)


def prefix_lengths(size: int, num: int, den: int) -> tuple[int, int]:
    """Tokens a set shows when it is the longer of a pair, and when it is the shorter."""
    return size - -(-num * size // den) + 1, size - -(-2 * num * size // (num + den)) + 1


def _repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur at least HOT_HERE times (twice or more), and how often; ``values`` are sorted in place."""
    values.sort()
    same = np.concatenate([[False], values[1:] == values[:-1], [False]])
    first, last = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
    often = last - first + 1 >= HOT_HERE
    return values[first[often]].view(np.int64), (last - first + 1)[often].astype(np.int64)


def _lists(parts: dict[int, tuple[np.ndarray, np.ndarray]], rows: int) -> pa.ListArray:
    """Lists of (g, c) for the rows named in ``parts``, null for all others; numbers never become Python objects."""
    lengths = np.zeros(rows + 1, np.int32)
    for i, (g, _) in parts.items():
        lengths[i + 1] = len(g)
    flat = [pa.array(np.concatenate([np.empty(0, np.int64), *[parts[i][k] for i in sorted(parts)]])) for k in (0, 1)]
    empty = np.array([i not in parts for i in range(rows)] + [False])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32), mask=empty), pa.StructArray.from_arrays(flat, names=["g", "c"]))


def _sets(docs: DataFrame, key: str, text: str, n: int, seed: int) -> DataFrame:
    """Per document: key, size, digest and cell counts of its set; a batch's last row lists frequent n-grams."""
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("size", T.LongType()), T.StructField("digest", T.BinaryType()),
                           T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("hot", T.ArrayType(T.StructType([T.StructField("g", T.LongType()), T.StructField("c", T.LongType())])))])

    def run(batches):
        shingler = Shingler(n, seed)
        for batch in batches:
            sizes, digests, cells, hot, held, waiting, here = [], [], [], {}, [], 0, set()
            for data in batch.column(1).cast(pa.binary()):
                g = shingler.grams(data.as_py())
                sizes.append(len(g))
                digests.append(shingler.digest(g) if len(g) else None)
                cells.append(np.bincount((g >> np.uint64(59)).astype(np.int64), minlength=CELLS).astype(np.int32))
                if digests[-1] not in here:
                    here.add(digests[-1])
                    held.append(g)
                    waiting += len(g)
                if held and (waiting >= HOT_CHUNK or len(sizes) == batch.num_rows):
                    values = np.concatenate(held)
                    held, waiting, here = [], 0, set()
                    hot[len(sizes) - 1] = _repeated(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(cells, pa.list_(pa.int32())), _lists(hot, len(sizes))],
                                             names=schema.names)

    return docs.select(F.col(key).alias("k"), text_of(text).alias("t")).mapInArrow(run, schema)


def _postings(docs: DataFrame, text: str, n: int, seed: int, num: int, den: int, hot) -> DataFrame:
    """(token, node, size, at) for the prefix of every set, rare n-grams first; ``at`` is the place in that order."""
    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("at", T.IntegerType())])

    def run(batches):
        grams, counts = hot.value
        shingler, seen = Shingler(n, seed), set()
        for batch in batches:
            parts: list[tuple] = []
            for data in batch.column(0).cast(pa.binary()):
                g = shingler.grams(data.as_py())
                if not len(g):
                    continue
                node = int.from_bytes(shingler.digest(g)[:8], "little", signed=True)
                if node in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(node)
                long = prefix_lengths(len(g), num, den)[0]
                prefix = g[:long]
                if len(grams):
                    place = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
                    frequent = grams[place] == g
                    prefix = g[~frequent][:long]
                    if len(prefix) < long:
                        rest, often = g[frequent], counts[place[frequent]]
                        prefix = np.concatenate([prefix, rest[np.lexsort((rest, often))][:long - len(prefix)]])
                parts.append((prefix.view(np.int64), node, len(g)))
            if not parts:
                continue
            lengths = [len(p[0]) for p in parts]
            spread = lambda i, t: np.repeat(np.array([p[i] for p in parts], t), lengths)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([p[0] for p in parts]), spread(1, np.int64), spread(2, np.int32),
                                                                    np.concatenate([np.arange(m, dtype=np.int32) for m in lengths]))], names=schema.names)

    return docs.select(text_of(text).alias("t")).mapInArrow(run, schema)


def _compare(n: int, seed: int, num: int, den: int):
    """Batches of (a, b, text of a, text of b) to the pairs that reach the threshold.  A text whose set is not the
    node it stands for (keys may repeat) proves nothing.  Partners come sorted, so recent sets are kept."""
    def run(batches):
        shingler, recent = Shingler(n, seed), {}

        def grams(node: int, data: bytes):
            known = recent.get(node)
            if known is None:
                g = shingler.grams(data)
                if int.from_bytes(shingler.digest(g)[:8], "little", signed=True) != node:
                    return None
                if len(recent) >= RECENT:
                    recent.clear()
                known = recent[node] = g
            return known

        for batch in batches:
            left, right = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            linked = []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                y, x = grams(b, right[i].as_py()), grams(a, left[i].as_py())
                if x is None or y is None:
                    linked.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, n: int, seed: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes that reach the threshold.  The suffix filter comes first: sets whose counts
    over the parts of the hash range differ by more than |x| + |y| - 2 * overlap cannot overlap enough.
    The texts of what is left travel to their pairs; they are picked by a broadcast of keys up to a
    checked number, beyond it by a shuffled join."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("cells").alias(f"cells_{s}"), F.col("k").alias(f"k_{s}"))
    need = F.ceil(F.lit(num) * (F.col("size_a") + F.col("size_b")) / F.lit(num + den))
    gap = F.aggregate(F.zip_with("cells_a", "cells_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    near = stage(pairs.join(side("a"), "a").join(side("b"), "b").where(gap <= F.col("size_a") + F.col("size_b") - 2 * need).select("a", "b", "k_a", "k_b"), "jaccard-near")
    ids = stage(near.select(F.explode(F.array("k_a", "k_b")).alias("k")).distinct(), "jaccard-ids")
    texts = docs.select(F.col(key).alias("k"), text_of(text).alias("t")).join(small(ids), "k", "left_semi")
    both = near.join(texts.select(F.col("k").alias("k_a"), F.col("t").alias("t_a")), "k_a").join(texts.select(F.col("k").alias("k_b"), F.col("t").alias("t_b")), "k_b")
    return both.select("a", "b", "t_a", "t_b").mapInArrow(_compare(n, seed, num, den), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b).  In a round each node points to its smallest
    neighbour if that is smaller, and edges move to where their ends point; ends that already agree
    vanish.  A round at least halves what can still move, and each one is written to the shared folder."""
    open_ = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while open_.count():
        both = open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "parents")
        jump = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = stage(up.join(jump, "up").select("node", F.col("top").alias("up")), "parents")
        if roots is None:
            roots = up.select("node", F.col("up").alias("root"))
        else:
            moved = up.select(F.col("node").alias("root"), "up")
            roots = stage(roots.join(moved, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        left, right = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        open_ = stage(open_.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return roots if roots is not None else open_.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    return df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key reachable through links, its own
    included).  Documents link if the Jaccard similarity of their sets of word n-grams is at least num / den.

    Words are runs of other characters than 0x20 and 0x09-0x0D, with A-Z folded.  A text with fewer words
    than n has its word sequence as its only member; a text without words, or null, has an empty set and
    links with nothing.  A key names one document: rows that repeat it are linked through it.  Rows with a null key
    link with nothing and have a null component.  Other columns are not read; an empty table gives no rows."""
    spark = docs.sparkSession
    seed = 0
    while True:
        sets = stage(_sets(docs, key, text, n, seed), "jaccard-documents")
        classes = stage(sets.where("size > 0 and k is not null").groupBy("digest").agg(F.min("k").alias("k"), F.first("size").alias("size"), F.first("cells").alias("cells"))
                        .withColumn("node", _node()), "jaccard-classes")
        if not classes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1):
            break
        seed += 1                                      # two sets share 64 bits of their digests: take others
    nodes = classes.select("node", "k", "size", "cells")
    named = sets.where("size > 0 and k is not null").select("k", _node().alias("node"))
    first = named.groupBy("k").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("k", "a")
    same_key = named.join(first, "k").where("node <> a").select("a", F.col("node").alias("b"))

    often = stage(sets.where("hot is not null").select(F.explode("hot").alias("h")).groupBy("h.g").agg(F.sum("h.c").alias("c")), "jaccard-frequent")
    reached = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)          # one row per count
    cutoff = (often.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(reached))
              .where(F.col("upto") <= HOT_TABLE).agg(F.min("c").alias("c")).first()["c"])
    top = often.where(F.col("c") >= F.lit(cutoff)).select("g", "c").toArrow()                # at most HOT_TABLE rows
    grams, order = top["g"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy().astype(np.int64)
    by_gram = np.argsort(grams)
    hot = spark.sparkContext.broadcast((grams[by_gram], order[by_gram]))
    postings = stage(_postings(docs.where(F.col(key).isNotNull()), text, n, seed, num, den, hot), "jaccard-postings")
    tokens = postings.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("token")
    shared = stage(postings.join(tokens, "token").distinct(), "jaccard-shared")
    discard(postings)

    fits = lambda x, y: F.lit(den) * F.least(x, y) >= F.lit(num) * F.greatest(x, y)
    verify = lambda pairs: _verified(pairs, nodes, docs, key, text, n, seed, num, den)
    # rare n-grams come first, so the holder that has the token earliest has the fewest of its own
    hub = shared.groupBy("token").agg(F.min(F.struct("at", "node", "size")).alias("hub"))
    hubs = shared.join(hub, "token").where((F.col("hub.node") != F.col("node")) & fits(F.col("hub.size"), F.col("size"))).select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
    roots = components(verify(hubs.distinct()).unionByName(same_key))

    held = stage(_rooted(shared, roots), "jaccard-held")
    discard(shared)
    by_token = held.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count(F.lit(1)).alias("roots"))
    minor = held.join(by_token.where("roots > 1"), "token").where(F.col("root") != F.col("major")).drop("major", "roots")
    left = minor.select("token", *[F.col(c).alias(f"l_{c}") for c in ("node", "root", "size", "at")])
    right = held.select("token", *[F.col(c).alias(f"r_{c}") for c in ("node", "root", "size", "at")])
    short = lambda s: F.col(f"{s}_size") - F.ceil(F.lit(2 * num) * F.col(f"{s}_size") / F.lit(num + den)) + 1
    shows = (((F.col("l_size") <= F.col("r_size")) & (F.col("l_at") < short("l"))) | ((F.col("r_size") <= F.col("l_size")) & (F.col("r_at") < short("r"))))
    need = F.ceil(F.lit(num) * (F.col("l_size") + F.col("r_size")) / F.lit(num + den))
    reaches = F.least(F.col("l_size") - F.col("l_at"), F.col("r_size") - F.col("r_at")) >= need
    rest = (left.join(right, "token").where((F.col("l_root") != F.col("r_root")) & fits(F.col("l_size"), F.col("r_size")) & shows & reaches)
            .select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b")).distinct())
    late = verify(rest)
    ends = late.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
    merged = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("final"))

    placed = _rooted(sets.where("k is not null").select("k", "size", F.coalesce(_node(), F.lit(0)).alias("node")), roots).join(merged, "root", "left")
    placed = stage(placed.select("k", "size", F.coalesce("final", "root").alias("root")), "jaccard-placed")
    least = placed.where("size > 0").groupBy("root").agg(F.min("k").alias("component_id"))
    linked = placed.where("size > 0").join(least, "root").select("k", "size", "component_id")
    alone = placed.where("size = 0").select("k", "size", F.col("k").alias("component_id"))
    nameless = sets.where("k is null").select("k", "size", F.col("k").alias("component_id"))
    return linked.unionByName(alone).unionByName(nameless).select(F.col("k").alias(key), F.col("size").alias("n_shingles"), "component_id")


def _node() -> Column:
    """The first eight bytes of the digest as a number, low byte first."""
    h = F.hex("digest")
    byte = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("long")
    total = byte(7)
    for i in range(6, -1, -1):
        total = F.shiftleft(total, 8).bitwiseOR(byte(i))
    return total


def without_near_copies(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each group left: the one with the smallest key.  Of rows that
    repeat a key one stays; rows without a key stay.  All columns are kept."""
    found = stage(near_duplicates(docs, n, num, den, key, text), "near-copies")
    dropped = stage(found.where(F.col("component_id") != F.col(key)).select(F.col(key).alias("__gone")).distinct(), "near-dropped")
    repeated = stage(found.groupBy(F.col(key).alias("__gone")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and __gone is not null").select("__gone"), "near-repeated")
    at = F.col(f"`{key}`")
    kept = docs.join(small(dropped), at == F.col("__gone"), "left_anti")
    if not repeated.head(1):
        return kept
    single = kept.join(small(repeated), at == F.col("__gone"), "left_anti")
    several = kept.join(small(repeated), at == F.col("__gone"), "left_semi")
    return single.unionByName(several.dropDuplicates([key]))
