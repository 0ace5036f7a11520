"""Substring deduplication by content-defined chunks: a gear rolling hash cuts texts where their own bytes say so, so an
insertion shifts no later cut, and chunks are compared by digest."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, small, stage, text_of

BITS = 5                       # a place is a cut with probability 2 ** -BITS: about 32 bytes between cuts
MIN_BYTES, MAX_BYTES = 8, 512  # closer cuts are one; a stretch without cuts is divided
MIN_WORDS = 30                 # shorter passages often hold no whole chunk of their own; of this many words 9 in 10 do
GEAR_SEED = 20_240_101


def _gear() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(GEAR_SEED)).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


GEAR = _gear()


def cuts(data: bytes) -> np.ndarray:
    """Ends of the chunks of ``data``.  The gear hash h = 2 * h + gear[byte] in 32 bits depends on the last 32
    bytes alone; all of them are computed at once by doubling.  Which cuts stand is decided from the
    cuts just before, so equal passages are cut alike whatever precedes them."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    h = GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < 32 and width < n:
        older = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += older
        width *= 2
    at = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1
    if len(at):
        at = at[np.diff(at, prepend=-MIN_BYTES) >= MIN_BYTES]
    at = np.concatenate([[0], at[at < n], [n]]).astype(np.int64)
    gaps = np.diff(at)
    if gaps.max() > MAX_BYTES:
        parts = -(-gaps // MAX_BYTES)
        start = np.repeat(at[:-1], parts)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.append((start + step * MAX_BYTES)[1:], n)
    return at[1:]


_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def chunks(data: bytes) -> tuple[list[int], list[int], np.ndarray]:
    """(64-bit digests, ends, words that begin inside) of the chunks."""
    at = cuts(data)
    ends = at.tolist()
    hashed, start = [], 0
    for end in ends:
        hashed.append(int.from_bytes(hashlib.blake2b(data[start:end], digest_size=8).digest(), "little", signed=True))
        start = end
    blank = _BLANK[np.frombuffer(data, np.uint8)]
    begins = ~blank
    begins[1:] &= blank[:-1]
    return hashed, ends, np.diff(np.cumsum(begins)[at - 1], prepend=0) if ends else at


def windows(data: bytes, places: list, size: int) -> list[tuple[int, int, int, int]]:
    """(64-bit digest, start, stop, number of the first word) of every window of ``size`` whole words that holds one of
    ``places``, which are (number of the first word that begins in a chunk, how many do)."""
    blank = np.concatenate([[True], _BLANK[np.frombuffer(data, np.uint8)], [True]])
    begin, end = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    wanted: set[int] = set()
    for first, count in places:
        lo, hi = (first, first + count - 1) if count else (first - 1, first - 1)
        wanted.update(range(max(0, hi - size + 1), min(lo, len(begin) - size) + 1))
    out = []
    for w in sorted(wanted):
        start, stop = int(begin[w]), int(end[w + size - 1])
        out.append((int.from_bytes(hashlib.blake2b(data[start:stop], digest_size=8).digest(), "little", signed=True), start, stop, w))
    return out


_PLACES = ("row", "k", "digest", "start", "stop", "word", "words")


def _places(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("row", T.LongType()), T.StructField("k", kind), T.StructField("digest", T.LongType()),
                         *[T.StructField(c, T.IntegerType()) for c in _PLACES[3:]]])


def _batch(batch, counts: list, columns: list):
    take = pa.array(np.repeat(np.arange(batch.num_rows), counts), pa.int64())
    kinds = (pa.int64(), *[pa.int32()] * 4)
    return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=list(_PLACES))


def chunk_table(texts: DataFrame) -> DataFrame:
    """(row, k, digest, start, stop, word, words) of every chunk of (row, k, t); places are UTF-8 bytes, ``word``
    is the number of the first word that begins in the chunk.  Empty texts have none."""
    def run(batches):
        for batch in batches:
            digests, stops, starts, words, before, counts = [], [], [], [], [], []
            for data in batch.column(2).cast(pa.binary()):
                d, e, w = chunks(data.as_py())
                digests += d
                stops += e
                starts += [0, *e[:-1]] if e else []
                words += w.tolist()
                before += (np.cumsum(w) - w).tolist()
                counts.append(len(d))
            yield _batch(batch, counts, [digests, starts, stops, before, words])

    return texts.mapInArrow(run, _places(texts.schema["k"].dataType))


def window_table(texts: DataFrame, size: int) -> DataFrame:
    """The same columns for the windows of ``size`` words around the places of (row, k, t, places)."""
    def run(batches):
        for batch in batches:
            found = [windows(t.as_py(), [(p["word"], p["words"]) for p in places.as_py()], size) for t, places in zip(batch.column(2).cast(pa.binary()), batch.column(3))]
            every = [x for f in found for x in f]
            columns = [list(c) for c in zip(*every)] or [[]] * 4
            yield _batch(batch, [len(f) for f in found], [*columns, [size] * len(every)])

    return texts.mapInArrow(run, _places(texts.schema["k"].dataType))


def _owned(places: DataFrame, label: str) -> DataFrame:
    """Those places whose digest two keys have, with the smallest key and whether it is their own."""
    twice = stage(places.groupBy("digest").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first <> last").select("digest", "first"), label)
    return places.join(twice, "digest").withColumn("own", F.col("first").eqNullSafe(F.col("k")))


def _joined(places: DataFrame, group: list[str], name: str) -> DataFrame:
    """Number, within ``group``, of the run of adjacent or overlapping places that each belongs to."""
    order = Window.partitionBy(*group).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (places.withColumn("__apart", (F.col("start") > F.coalesce(reach, F.lit(-1))).cast("int"))
            .withColumn(name, F.sum("__apart").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__apart"))


def _stretches(places: DataFrame) -> DataFrame:
    held = Window.partitionBy("row", "stretch")
    return _joined(places, ["row"], "stretch").withColumn("whole", F.max(F.col("word") + F.col("words")).over(held) - F.min("word").over(held))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated passage: key, start and stop (UTF-8 bytes), n_chunks, n_words, first_doc (smallest key
    that has one of its parts) and is_first (all its parts occur in this document first, so that
    here the passage would stay).  Documents without repeated passages of ``min_words`` words have no row.

    Repeated chunks are those whose digests occur in two documents or more; a stretch is a run of adjacent ones.
    Chunks at the edges of a passage differ with what stands around it, so a stretch below ``min_words`` words
    says nothing yet: all occurrences of its chunks are read again, and windows of ``min_words`` whole words
    around them that two documents have are part of the stretch.  A passage of ``min_words`` words or more is
    found if one common chunk lies whole inside.  Where parts that are here first meet parts that are not, a
    stretch is divided, so a part is cut only where an earlier document has it; those of a stretch that stay have
    no row if they are below ``min_words`` together.  A digest has 64 bits: a chance collision makes one chunk, far below
    ``min_words``.  A key names one document; rows with a null key are compared with the others but not
    with each other.  Null and empty texts have no chunks.  Other columns are not read; an empty table gives no rows.

    Chunks are cut once and written.  Digests are counted with map-side combination; only repeated ones
    are joined with their occurrences, where hot digests are split; texts are joined by row, once.  Stages that no later step reads are removed."""
    texts = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), text_of(text).alias("t")), "chunk-texts")
    found = stage(chunk_table(texts), "chunks")
    repeats = stage(_owned(found, "chunk-repeats"), "chunk-places")
    discard(found)
    short = stage(_stretches(repeats).where(F.col("whole") < min_words).select("digest").distinct(), "chunk-short")
    around = repeats.join(short, "digest", "left_semi").groupBy("row").agg(F.collect_list(F.struct("word", "words")).alias("places"))
    near = stage(window_table(texts.join(around, "row").select("row", "k", "t", "places"), max(1, min_words)), "chunk-windows")
    discard(texts)
    parts = repeats.withColumn("n", F.lit(1)).unionByName(_owned(near, "window-repeats").withColumn("n", F.lit(0)))
    numbered = _joined(_stretches(parts).where(F.col("whole") >= min_words), ["row", "stretch", "own"], "run")
    runs = numbered.groupBy("row", "stretch", "own", "run").agg(
        F.first("k").alias(key), F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n_chunks"),
        (F.max(F.col("word") + F.col("words")) - F.min("word")).cast("long").alias("n_words"), F.min("first").alias("first_doc"))
    stays = F.sum("n_words").over(Window.partitionBy("row", "stretch", "own"))
    return runs.withColumn("stays", stays).where(~F.col("own") | (F.col("stays") >= min_words)).select(key, "start", "stop", "n_chunks", "n_words", "first_doc", F.col("own").alias("is_first"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with each repeated passage cut out of every text but the first that has it; all columns stay.
    Cuts lie between whole characters only, as a place inside one moves to its end."""
    spans = (repeated_passages(docs, key, text, min_words).where(~F.col("is_first")).groupBy(F.col(key).alias("__cut_key"))
             .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__cut")))
    spans = small(stage(spans, "chunk-cuts"))
    joined = docs.join(spans, F.col(f"`{key}`") == F.col("__cut_key"), "left").drop("__cut_key")
    at, cut = docs.columns.index(text), len(docs.columns)

    def run(batches):
        for batch in batches:
            new = [_without(t.as_py(), s.as_py()) for t, s in zip(batch.column(at), batch.column(cut))]
            columns = [c for i, c in enumerate(batch.columns) if i != cut]
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:cut])

    return joined.mapInArrow(run, docs.schema)


def _without(text: str | None, spans: list | None) -> str | None:
    if text is None or not spans:
        return text
    data, kept, at = text.encode(), [], 0
    for s in spans:
        start, stop = s["start"], s["stop"]
        while start < len(data) and data[start] & 0xC0 == 0x80:
            start += 1
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop += 1
        kept.append(data[at:max(at, start)])
        at = max(at, stop)
    return (b"".join(kept) + data[at:]).decode()
