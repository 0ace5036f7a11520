"""Quality rules: repetition and size rules, and Jensen-Shannon distance of a document's
character-class and common-word histograms from its language's reference."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, stage

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and a to in is was it for on are as with his they at be this from have or by one had not but what all were we when your can said there use an each which she do how their if will that he you".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "fr": "le la de et les des en un une du que qui dans pour pas sur au par est il ce se ne plus avec son sa ou mais nous comme être aux elle".split(),
    "es": "el la de que y en un ser se no haber por con su para como estar tener lo todo pero más hacer o este otro ese si me ya ver porque dar cuando muy sin los las del una es".split(),
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "symbol", "beyond", "other")
WINDOW = 8                     # words of a window that counts as repeated
MIN_WORDS, MAX_REPEATED = 20, 30
GUARD_WORDS = 50               # shorter documents are not judged by distance
PRIOR_WORDS, PRIOR_CHARS = 1_000, 6_000   # words and characters for which the shipped histograms count in a reference
MAX_DISTANCE, ALLOWANCE = 0.22, 1.0    # limit of both distances: MAX_DISTANCE + ALLOWANCE / sqrt(n_words), as short texts stray further by chance

# Rough shares of the character classes in prose, and of the listed words among all words.
PRIOR_CLASSES = {"lower": 0.78, "upper": 0.03, "digit": 0.005, "space": 0.15, "line": 0.005, "stop": 0.02, "symbol": 0.0005, "beyond": 0.0085, "other": 0.001}
PRIOR_LISTED = 0.4


def prior_common(lang: str | None) -> list[float]:
    """Counts of the vocabulary in PRIOR_WORDS words: the words of a language by falling frequency; the mean of
    all languages where there is no list."""
    lists = [COMMON_WORDS[lang]] if lang in COMMON_WORDS else list(COMMON_WORDS.values())
    counts = dict.fromkeys(VOCABULARY, 0.0)
    for words in lists:
        words = list(dict.fromkeys(words))
        total = sum(1 / (i + 2) for i in range(len(words)))
        for i, w in enumerate(words):
            counts[w] += PRIOR_WORDS * PRIOR_LISTED / (i + 2) / total / len(lists)
    return [counts[w] for w in VOCABULARY]


_INDEX = {w.encode(): i for i, w in enumerate(VOCABULARY)}
_EDGES = b".,;:!?\"'()[]"


def _class_table() -> np.ndarray:
    """Class of each UTF-8 byte; bytes that continue a character get a class of their own, dropped later."""
    table = np.full(256, CLASSES.index("other"), np.int64)
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"),
                        ("space", " \t\r\x0b\x0c"), ("line", "\n"), ("stop", ".,;:!?'\"-()"), ("symbol", "#*$%&|<>")):
        table[list(chars.encode())] = CLASSES.index(name)
    table[0xC0:] = CLASSES.index("beyond")
    table[0x80:0xC0] = len(CLASSES)
    return table


_CLASS = _class_table()


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur more than once.  Windows get exact numbers by pairing the
    numbers of their halves, so ``window`` is a power of two."""
    n, width = len(ids), 1
    if n <= window:
        return 0
    while width < window:
        pairs = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        found, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(found) == len(pairs):
            return 0
        width *= 2
    starts = counts[ids] > 1
    steps = np.zeros(n + 1, np.int64)
    steps[:len(starts)] += starts
    steps[window:window + len(starts)] -= starts
    return int((np.cumsum(steps)[:n] > 0).sum())


def measure(data: bytes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class counts, common-word counts) of UTF-8 bytes."""
    words = data.split()                               # bytes.split() parts at 0x20 and 0x09-0x0D, nothing else
    classes = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1)[:len(CLASSES)]
    blank = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    counts = np.bincount(ids, minlength=len(place)) if place else ()
    common: dict[int, int] = {}
    for word, n in zip(place, counts):
        i = _INDEX.get(word.strip(_EDGES).lower())     # bytes.lower() folds A-Z only
        if i is not None:
            common[i] = common.get(i, 0) + int(n)
    return (len(words), int(classes.sum()) - blank, int(classes[CLASSES.index("symbol")]), len(lines) - len(set(lines)),
            repeated_words(ids), classes.tolist(), [{"i": i, "n": n} for i, n in sorted(common.items())])


FEATURES = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
            ("classes", pa.list_(pa.int64())), ("common", pa.list_(pa.struct([("i", pa.int32()), ("n", pa.int64())]))))
_SPARK = (*[T.LongType()] * 5, T.ArrayType(T.LongType()), T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("n", T.LongType())])))
MARK = "__quality_"
SLICE = 256                    # rows measured before they leave as Arrow: their counts are Python objects until then


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus the measures, named with a prefix that cannot clash."""
    schema = T.StructType(docs.schema.fields + [T.StructField(MARK + n, t) for (n, _), t in zip(FEATURES, _SPARK)])
    at = docs.columns.index(text)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                rows = [measure(v.as_py() or b"") for v in batch.column(at).cast(pa.binary())]
                new = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(FEATURES)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[MARK + n for n, _ in FEATURES]])

    return docs.mapInArrow(run, schema)


def reference(features: DataFrame, lang: Column) -> DataFrame:
    """Per language: class counts, common-word counts by vocabulary place, and words, over all rows given, on top of the shipped histograms."""
    f = lambda n: F.col(MARK + n)
    tall = features.select(lang.alias("lang"), F.explode(F.concat(
        F.transform(f("classes"), lambda n, i: F.struct((-1 - i).alias("i"), n.alias("n"))), f("common").cast("array<struct<i:int,n:bigint>>"),
        F.array(F.struct(F.lit(len(VOCABULARY)).alias("i"), f("n_words").alias("n"))))).alias("s"))
    sums = tall.groupBy("lang", "s.i").agg(F.sum("s.n").alias("n"))
    lookup = F.map_from_entries(F.collect_list(F.struct("i", "n")))    # at most classes + vocabulary + 1 entries
    at = lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("double")
    numbers = lambda values: F.array(*[F.lit(v) for v in values])
    prior = numbers(prior_common(None))
    for name in COMMON_WORDS:
        prior = F.when(F.col("lang") == name, numbers(prior_common(name))).otherwise(prior)
    table = sums.groupBy("lang").agg(lookup.alias("m")).withColumn("prior", prior)
    return table.select("lang", F.array(*[at(F.lit(-1 - i)) + PRIOR_CHARS * PRIOR_CLASSES[c] for i, c in enumerate(CLASSES)]).alias("ref_classes"),
                        F.transform("prior", lambda p, i: at(i) + p).alias("ref_common"), (at(F.lit(len(VOCABULARY))) + PRIOR_WORDS).alias("ref_words"))


def _half(p: Column, q: Column) -> Column:
    """Terms of both divergences from the mean, for one cell."""
    side = lambda a, b: F.when(a > 0, a * F.log(2 * a / (a + b))).otherwise(F.lit(0.0))
    return side(p, q) + side(q, p)


def _distance(total: Column) -> Column:
    return F.sqrt(F.greatest(total, F.lit(0.0)) / (2 * F.log(F.lit(2.0))))


def judged(features: DataFrame, refs: DataFrame, lang: Column) -> DataFrame:
    """Adds base_failed, kept and both distances (under the prefix) to measured rows.  A row's own counts are taken
    out of the reference first, so no document is compared with itself."""
    f = lambda n: F.col(MARK + n)
    sum_of = lambda a, g: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + g(x))
    rows = features.withColumn(MARK + "lang", lang).join(small(refs, 10_000).withColumnsRenamed({c: MARK + c for c in refs.columns}), MARK + "lang", "left")
    chars, ref_chars = sum_of(f("classes"), lambda n: n.cast("double")), sum_of(f("ref_classes"), lambda n: n)
    cells = F.arrays_zip(f("classes").alias("n"), f("ref_classes").alias("r"))
    by_class = sum_of(cells, lambda z: _half(z["n"] / F.greatest(chars, F.lit(1.0)), (z["r"] - z["n"]) / (ref_chars - chars)))
    words, ref_words = F.greatest(f("n_words"), F.lit(1)).cast("double"), f("ref_words") - f("n_words")
    q = lambda z: (f("ref_common")[z["i"]] - z["n"]) / ref_words
    listed = sum_of(f("common"), lambda z: z["n"].cast("double"))
    p_rest = 1 - listed / words
    q_all, q_seen = (sum_of(f("ref_common"), lambda n: n) - listed) / ref_words, sum_of(f("common"), q)
    # common words that the document lacks have p = 0: each adds q * log 2
    by_word = sum_of(f("common"), lambda z: _half(z["n"] / words, q(z))) + (q_all - q_seen) * F.log(F.lit(2.0)) + _half(p_rest, 1 - q_all)
    base = (f("n_words") < MIN_WORDS) | (100 * f("n_repeat_words") > MAX_REPEATED * f("n_words"))
    guard = f("n_words") >= GUARD_WORDS
    rows = rows.withColumns({MARK + "class_distance": F.when(guard, _distance(by_class)), MARK + "word_distance": F.when(guard, _distance(by_word)), MARK + "base_failed": base})
    far = F.greatest(f("class_distance"), f("word_distance")) > MAX_DISTANCE + ALLOWANCE / F.sqrt(words)
    return rows.withColumn(MARK + "kept", ~f("base_failed") & ~F.coalesce(far, F.lit(False)))


def _lang(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: key, the measures, both distances, base_failed and kept.

    Words are runs of other characters than 0x20 and 0x09-0x0D.  A reference is the histograms of all other
    documents of the language on top of shipped ones, which stand for PRIOR_WORDS words; so rare languages have a
    reference too and no rule depends on the size of the table.  Documents under GUARD_WORDS words
    are judged by the base rules alone.  A null text counts as empty and
    fails; a null language is a language of its own.  Keys are only carried, so null or repeated ones
    are kept row by row; other columns are not read.  Texts are read once and not shuffled."""
    rows = stage(with_features(docs.select(F.col(key).alias("k"), F.col(text).alias("t"), _lang(lang).alias("lang")), "t").drop("t"), "quality")
    refs = stage(reference(rows, F.col("lang")), "quality-reference")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"]
    return judged(rows, refs, F.col("lang")).select(F.col("k").alias(key), *[F.col(MARK + n).alias(n) for n in names])


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns unchanged.  Texts are measured twice
    (once for the references) instead of being shuffled to a verdict."""
    refs = stage(reference(with_features(docs.select(F.col(text).alias("t"), _lang(lang).alias("lang")), "t"), F.col("lang")), "quality-reference")
    return judged(with_features(docs, text), refs, _lang(lang)).where(F.col(MARK + "kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
