"""Small tables with what real ones hold: nulls, empty and long texts, ties, repeated rows, clashing columns."""
import random

from pyspark.sql import types as T

CLASH = ("shard", "slot", "row", "k", "node", "token", "size", "first", "copy", "digest", "t", "key", "host", "template", "kept")
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in CLASH])
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())] + [T.StructField(c, T.StringType()) for c in CLASH])
WORDS = [f"w{i}" for i in range(400)] + "the of and to in is it that for on".split() * 20


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(words))


def rows():
    long = prose(1, 60_000)
    near = prose(2, 120)
    return [(1, prose(3, 80), "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (4, long, "en", "a", len(long)), (5, near, "de", "a", 1),
            (6, near + " one more", "de", None, 1), (7, near, None, "a", 1), (7, near, None, "a", 1), (8, "  \t\n ", "fr", "c", 5), (None, near, "en", "a", 1),
            (None, None, None, None, None), (9, "token: abcdef0123 " * 3, "en", "b", 1), (10, "é" * 1000, "fr", "b", 1000), (11, "three short words", "en", "a", 1), (12, "three short words", "en", "a", 1)]


def documents(spark, given=None):
    return spark.createDataFrame([(*r, *CLASH) for r in (rows() if given is None else given)], DOCUMENTS)


def pages(spark, given):
    return spark.createDataFrame([(*r, *CLASH) for r in given], PAGES)
