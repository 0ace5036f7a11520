"""Benchmark decontamination: a BM25 inverted index of test items, searched with every training passage by
block-max WAND, and a check of question and answer overlap on what it retrieves."""
from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import stage, text_of

K1, B = 1.2, 0.75              # the usual parameters of BM25
THRESHOLD = 0.6                # share of an item's own score that a passage must reach
OVERLAP = 0.7                  # share of the question's and of the answer's word triples that must be in it
BLOCK = 16                     # postings under one block maximum
LEAST_WINDOW = 64              # an item is looked for in windows of twice its words, at least twice this many
INDEX_POSTINGS = 1_000_000     # postings of one broadcast index; more items make more indexes and passes

_words = re.compile(r"\w+").findall


def parts(text: str | None) -> tuple[str, str]:
    """Question and answer of an item that comes as one text: the answer is its last sentence or line, or
    the last third of its words if there is but one."""
    text = (text or "").strip()
    at = max([m.end() for m in re.finditer(r"[.!?](?=\s)|\n", text)], default=0)
    if 0 < at < len(text):
        return text[:at], text[at:]
    words = text.split()
    cut = max(1, len(words) - max(1, len(words) // 3))
    return " ".join(words[:cut]), " ".join(words[cut:])


def _grams(words: list[str], n: int) -> set[tuple]:
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def _share(part: set[tuple], words: list[str]) -> float:
    """Share of a part's word triples (or of what is shorter) that a passage has; an empty part is covered."""
    return len(part & _grams(words, len(next(iter(part))))) / len(part) if part else 1.0


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text", question: str | None = None, answer: str | None = None) -> DataFrame:
    """(item, question, answer, length, terms): words of both parts, and counts of the terms, which are pairs of
    adjacent words, as single words of a test item are common everywhere.  Items with under two words have
    no term and are never found.  With ``question`` and ``answer`` those columns are used, else ``text`` is parted."""
    schema = T.StructType([T.StructField("item", items.schema[item].dataType), T.StructField("question", T.ArrayType(T.StringType())), T.StructField("answer", T.ArrayType(T.StringType())),
                           T.StructField("length", T.IntegerType()), T.StructField("terms", T.MapType(T.StringType(), T.IntegerType()))])

    def run(batches):
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(1), batch.column(2)):
                q, x = parts(a.as_py()) if question is None else (a.as_py() or "", b.as_py() or "")
                q, x = _words(q.lower()), _words(x.lower())
                words, counts = q + x, {}
                for pair in zip(words, words[1:]):
                    counts[" ".join(pair)] = counts.get(" ".join(pair), 0) + 1
                rows.append((q, x, len(words), list(counts.items())))
            columns = list(zip(*rows)) or [[], [], [], []]
            kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=schema.names)

    return items.select(F.col(item), F.col(question or text), F.col(answer or text).alias("__answer")).mapInArrow(run, schema)


class Index:
    """Postings of one part of the items.  Weights are shares of an item's own score, so that one
    threshold fits all items.  df, n_items and mean_length come from all items."""

    def __init__(self, rows: list, df: dict[str, int], n_items: int, mean_length: float):
        self.items, self.question, self.answer, self.width, own_terms = [], [], [], [], []
        postings: dict[str, list[tuple[int, float]]] = {}
        self.longest = 0
        for row in rows:
            if not row["terms"]:
                continue
            number = len(self.items)
            self.items.append(row["item"])
            self.question.append(_grams(row["question"], 3))
            self.answer.append(_grams(row["answer"], 3))
            self.longest = max(self.longest, row["length"])
            self.width.append(2 * max(LEAST_WINDOW, row["length"]))
            norm = K1 * (1 - B + B * row["length"] / mean_length)
            weights = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in row["terms"].items()}
            own = sum(weights.values())
            own_terms.append({t: w / own for t, w in weights.items()})
            for t, w in own_terms[-1].items():
                postings.setdefault(t, []).append((number, w))
        words = sorted({w for t in postings for w in t.split(" ")})
        self.word = {w: i for i, w in enumerate(words)}
        coded = sorted((self.code(t), t) for t in postings)
        self.codes = np.array([c for c, _ in coded], np.int64)
        self.lists = [([i for i, _ in postings[t]], [w for _, w in postings[t]]) for _, t in coded]
        place = {t: i for i, (_, t) in enumerate(coded)}
        self.own = [{place[t]: w for t, w in terms.items()} for terms in own_terms]
        self.blocks = [[max(w[k:k + BLOCK]) for k in range(0, len(w), BLOCK)] for _, w in self.lists]
        self.bound = np.array([max(w) for _, w in self.lists] or [0.0])

    def code(self, term: str) -> int:
        a, b = term.split(" ")
        return self.word[a] * len(self.word) + self.word[b]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) with score >= threshold for a passage with these terms, item by item: the pivot is the
        first item whose terms' bounds reach the threshold; if the maxima of the blocks it is in do not,
        the cursors jump past the nearest block end."""
        at = [0] * len(terms)
        lists, blocks, bound = [self.lists[t] for t in terms], [self.blocks[t] for t in terms], [float(self.bound[t]) for t in terms]
        alive, found = list(range(len(terms))), []
        slack = threshold - 1e-9
        while alive:
            alive.sort(key=lambda k: lists[k][0][at[k]])
            total, pivot = 0.0, -1
            for place, k in enumerate(alive):
                total += bound[k]
                if total >= slack:
                    pivot = place
                    break
            if pivot < 0:
                break
            item = lists[alive[pivot]][0][at[alive[pivot]]]
            while pivot + 1 < len(alive) and lists[alive[pivot + 1]][0][at[alive[pivot + 1]]] == item:
                pivot += 1
            high, nearest = 0.0, None
            for k in alive[:pivot + 1]:                # block maxima around the pivot item
                b = bisect_left(lists[k][0], item, at[k]) // BLOCK
                if b < len(blocks[k]):
                    high += blocks[k][b]
                    end = lists[k][0][min(len(lists[k][0]), (b + 1) * BLOCK) - 1]
                    nearest = end if nearest is None else min(nearest, end)
            if high >= slack:
                target = item
                if lists[alive[0]][0][at[alive[0]]] == item:
                    score = sum(lists[k][1][at[k]] for k in alive[:pivot + 1])
                    if score >= slack:
                        found.append((item, score))
                    target = item + 1
            else:
                following = lists[alive[pivot + 1]][0][at[alive[pivot + 1]]] if pivot + 1 < len(alive) else None
                target = max(item + 1, min(x for x in (nearest + 1 if nearest is not None else None, following) if x is not None)) if nearest is not None or following is not None else item + 1
            for k in alive[:pivot + 1]:
                at[k] = bisect_left(lists[k][0], target, at[k])
            alive = [k for k in alive if at[k] < len(lists[k][0])]
        return found

    def confirm(self, item: int, words: list[str], where: np.ndarray, term: np.ndarray, threshold: float) -> tuple | None:
        """(score, question overlap, answer overlap, windows) of an item in a text.  Its windows are as wide as its
        own length asks, each half over the last, so nothing depends on the other items."""
        own, width = self.own[item], self.width[item]
        step = width // 2
        last = -(-max(1, len(words) - step) // step) - 1
        mine = np.isin(term, np.fromiter(own, np.int64, len(own)))
        seen: dict[int, set[int]] = {}
        for at, t in zip(where[mine].tolist(), term[mine].tolist()):
            for k in (at // step - 1, at // step):
                if 0 <= k <= last and at + 1 < k * step + width:        # both words of the pair are in the window
                    seen.setdefault(k, set()).add(t)
        best, n = None, 0
        for k, terms in sorted(seen.items()):
            score = sum(own[t] for t in sorted(terms))
            if score < threshold - 1e-9:
                continue
            passage = words[k * step:k * step + width]
            q, a = _share(self.question[item], passage), _share(self.answer[item], passage)
            if best is None or (min(q, a), score) > (min(best[1], best[2]), best[0]):
                best = (score, q, a)
            n += 1
        return best and (*best, n)

    def leaks(self, text: str, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple]:
        """(item, score, question overlap, answer overlap, windows, confirmed) of every item that a passage retrieves.

        Passages are twice as wide as the widest window and overlap by half, so every window of every item lies
        whole in one: what a passage retrieves is then confirmed in the item's own windows."""
        words = _words(text.lower())
        if len(words) < 2 or not len(self.codes):
            return []
        ids = np.fromiter(map(self.word.get, words, [-1] * len(words)), np.int64, len(words))
        both = (ids[:-1] >= 0) & (ids[1:] >= 0)
        where = np.flatnonzero(both)
        codes = ids[where] * len(self.word) + ids[where + 1]
        term = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[term] == codes
        where, term = where[hit], term[hit]
        if not len(where):
            return []
        width = 4 * max(LEAST_WINDOW, self.longest)
        starts = np.arange(0, max(1, len(words) - width // 2), width // 2)
        sums = np.concatenate([[0.0], np.cumsum(self.bound[term])])
        first, last = np.searchsorted(where, starts), np.searchsorted(where, starts + width - 1)
        retrieved: set[int] = set()
        for k in np.flatnonzero(sums[last] - sums[first] >= threshold - 1e-9):
            retrieved.update(item for item, _ in self.search(np.unique(term[first[k]:last[k]]).tolist(), threshold))
        found = [(i, self.confirm(i, words, where, term, threshold)) for i in sorted(retrieved)]
        return [(self.items[i], *f, f[1] >= overlap and f[2] >= overlap) for i, f in found if f]


def indexes(spark: SparkSession, terms: DataFrame):
    """Broadcast indexes that together hold all items, each with a bounded number of postings."""
    terms = stage(terms, "items")
    sizes = terms.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), F.sum(F.size("terms")).alias("postings")).first()
    if not sizes["n"]:
        return
    shards = max(1, -(-int(sizes["postings"] or 0) // INDEX_POSTINGS))
    frequency = stage(terms.select(F.explode(F.map_keys("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "item-terms")
    sharded = terms.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    for shard in range(shards):
        part = sharded.where(F.col("shard") == shard)
        rows = part.select("item", "question", "answer", "length", "terms").collect()      # at most about INDEX_POSTINGS postings
        known = {r["term"]: r["df"] for r in frequency.join(part.select(F.explode(F.map_keys("terms")).alias("term")).distinct(), "term").collect()}
        yield spark.sparkContext.broadcast(Index(sorted(rows, key=lambda r: str(r["item"])), known, sizes["n"], sizes["mean"] or 1.0))


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
               question: str | None = None, answer: str | None = None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per document row and retrieved item: key, item, score (best passage, as a share of the item's
    own score), question_overlap, answer_overlap, n_passages, contaminated.

    A text is cut into passages, each half over the last; every passage queries the index.  A retrieved item is
    scored and confirmed in windows of twice its own words, so a result does not depend on what other
    items the benchmark has.  Null and empty texts retrieve nothing;
    null or repeated keys are carried row by row; items with equal texts are all found.  Other columns
    are not read.  Documents are not shuffled: the index travels to them."""
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("item", items.schema[item].dataType), *[T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap")],
                           T.StructField("n_passages", T.IntegerType()), T.StructField("contaminated", T.BooleanType())])
    item_kind = to_arrow_type(items.schema[item].dataType)
    out = None
    for index in indexes(docs.sparkSession, item_terms(items, item, item_text, question, answer)):
        def run(batches, index=index):
            for batch in batches:
                take, rows = [], []
                for i, t in enumerate(batch.column(1)):
                    for row in index.value.leaks(t.as_py(), threshold, overlap):
                        take.append(i)
                        rows.append(row)
                if rows:
                    kinds = (item_kind, pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=schema.names)

        part = docs.select(F.col(key).alias("k"), text_of(text).alias("t")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("k", key).withColumnRenamed("item", item)


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` without a confirmed leak, all columns unchanged, in one pass per index."""
    at = docs.columns.index(text)
    for index in indexes(docs.sparkSession, item_terms(items, **names)):
        def run(batches, index=index):
            for batch in batches:
                clean = [not any(row[-1] for row in index.value.leaks(t.as_py() or "")) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
