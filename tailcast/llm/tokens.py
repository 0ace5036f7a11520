"""Edit-aware token counts: a tree of pre-token segments per document, re-encoded only where edits touch it."""
from __future__ import annotations

import base64
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text into pre-tokens for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
AHEAD = 3                      # a pre-token depends on no more characters after its end
LEAF = 64                      # pre-tokens of a leaf
CACHE = 400_000                # pre-tokens whose counts a worker remembers
SLICE = 256                    # documents whose trees a worker holds at a time

_counters: dict[str, "Counter"] = {}


class Counter:
    """Tokens per pre-token, remembered; the memory is emptied when full, which costs only time."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("pretoken", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall
        self.match = regex.compile(PATTERN).match
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        found = list(map(self.known.get, pieces))
        if None in found:
            if len(self.known) > CACHE:
                self.known.clear()
            for i, n in enumerate(found):
                if n is None:
                    piece = pieces[i]
                    n = self.known.get(piece)
                    if n is None:
                        n = len(self.encoding.encode_ordinary(piece))
                        if len(piece) <= 64:
                            self.known[piece] = n
                    found[i] = n
        return found


def counter(path: str = VOCABULARY_FILE) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


class PretokenTree:
    """Leaves hold runs of pre-tokens; every inner node holds the characters and tokens below it, so a
    place is found and a sum is updated in a number of steps that grows with the logarithm of the leaves."""

    def __init__(self, text: str, count: Counter, stored: tuple | None = None):
        self.count, self.encoded = count, 0
        if stored is None:
            pieces = count.split(text)
            numbers = count.counts(pieces)
            self.encoded = len(pieces)
        else:                                          # lengths and counts of pre-tokens, as ``stored`` gives them
            stops = list(accumulate(stored[0]))
            pieces, numbers = list(map(text.__getitem__, map(slice, [0, *stops], stops))), list(stored[1])
        self._grow(pieces, numbers)

    def stored(self) -> tuple[list[int], list[int]]:
        return list(map(len, chain(*self.leaves))), list(chain(*self.numbers))

    def _grow(self, pieces: list[str], numbers: list[int]) -> None:
        n = max(1, -(-len(pieces) // LEAF))
        self.size = 1 << (n - 1).bit_length()
        empty = [[] for _ in range(self.size - n)]
        self.leaves = [pieces[i * LEAF:(i + 1) * LEAF] for i in range(n)] + empty
        self.numbers = [numbers[i * LEAF:(i + 1) * LEAF] for i in range(n)] + [[] for _ in empty]
        self.chars, self.tokens = self._sums(np.fromiter(map(len, pieces), np.int64, len(pieces))), self._sums(np.array(numbers, np.int64))

    def _sums(self, values: np.ndarray) -> list[int]:
        """Sums of all nodes: the root is 1, the children of i are 2 * i and 2 * i + 1."""
        level = np.zeros(self.size, np.int64)
        if len(values):
            found = np.add.reduceat(values, np.arange(0, len(values), LEAF))
            level[:len(found)] = found
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
        return [0, *chain.from_iterable(x.tolist() for x in reversed(levels))]

    def _sum(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pretokens(self) -> int:
        return sum(map(len, self.leaves))

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, characters before it) of the leaf that holds a character."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if place - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters [start, stop).  Scanning restarts at the last pre-token that cannot have seen the
        edit and ends where a new boundary after the edit meets an old one: the rest splits as before."""
        total = self.n_chars
        start = min(max(start, 0), total)
        stop = min(max(stop, start), total)
        if start == stop and not new:
            return
        first, before = self.find(max(0, min(start - AHEAD, total - 1)))
        keep, at = 0, before
        for piece in self.leaves[first]:
            if at + len(piece) + AHEAD > start:
                break
            at += len(piece)
            keep += 1
        restart = at                                   # pre-tokens of the first leaf before this stay
        last = self.find(max(0, min(stop, total - 1)))[0] if total else 0
        last = max(last, first)
        while True:
            region = "".join(["".join(self.leaves[first][keep:]) if first == i else "".join(self.leaves[i]) for i in range(first, last + 1)])
            tail = "" if last + 1 == self.size else self._peek(last + 1)
            fresh = region[:start - restart] + new + region[stop - restart:]
            shift = len(new) - (stop - start)
            done = self._scan(fresh, tail, restart, stop, shift, first, keep, last)
            if done is not None:
                break
            last = min(self.size - 1, 2 * last - first + 1)
        pieces, kept_from = done
        old = [(i, j) for i in range(first, last + 1) for j in range(len(self.leaves[i])) if i > first or j >= keep]
        numbers = self.count.counts(pieces)
        self.encoded += len(pieces)
        rest = old[kept_from:]
        pieces = self.leaves[first][:keep] + pieces + [self.leaves[i][j] for i, j in rest]
        numbers = self.numbers[first][:keep] + numbers + [self.numbers[i][j] for i, j in rest]
        self._lay(first, last, pieces, numbers)

    def _peek(self, leaf: int) -> str:
        """Enough characters after a region for its last pre-tokens to split as they do in the whole text."""
        out = ""
        while leaf < self.size and len(out) < AHEAD + 1:
            out += "".join(self.leaves[leaf])
            leaf += 1
        return out[:AHEAD + 1]

    def _scan(self, fresh, tail, restart, stop, shift, first, keep, last):
        """Pre-tokens of the changed region and the number of old ones they replace, or None if the
        region must grow because no boundary was met inside it."""
        bounds, at, seen = {}, restart, 0
        for piece in chain(self.leaves[first][keep:], *self.leaves[first + 1:last + 1]):
            bounds[at] = seen
            seen += 1
            at += len(piece)
        bounds[at] = seen
        whole, place, pieces = fresh + tail, 0, []
        final = last + 1 == self.size
        while place < len(fresh):
            old = restart + place - shift
            if old >= stop and old in bounds:
                return pieces, bounds[old]
            m = self.count.match(whole, place)
            if m.end() > len(fresh) or (not final and m.end() + AHEAD > len(whole)):
                return None
            pieces.append(m.group())
            place = m.end()
        return (pieces, seen) if at >= stop else None

    def _lay(self, first: int, last: int, pieces: list[str], numbers: list[int]) -> None:
        leaves = last - first + 1
        each = -(-len(pieces) // leaves) if pieces else 1
        if each > 4 * LEAF:                            # the leaves have outgrown the tree
            self._grow([*chain(*self.leaves[:first]), *pieces, *chain(*self.leaves[last + 1:])],
                       [*chain(*self.numbers[:first]), *numbers, *chain(*self.numbers[last + 1:])])
            return
        for k in range(leaves):
            self.leaves[first + k], self.numbers[first + k] = pieces[k * each:(k + 1) * each], numbers[k * each:(k + 1) * each]
            i = self.size + first + k
            self.chars[i], self.tokens[i] = sum(map(len, self.leaves[first + k])), sum(self.numbers[first + k])
        low, high = self.size + first, self.size + last
        while low > 1:
            low, high = low // 2, high // 2
            for i in range(low, high + 1):
                self._sum(i)


TREE = T.StructType([T.StructField("text", T.StringType()), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("numbers", T.ArrayType(T.IntegerType()))])
EDITS = "array<struct<start:int,stop:int,text:string>>"
COUNTS = (("n_tokens", pa.int64()), ("n_pretokens", pa.int64()), ("n_edits", pa.int64()), ("n_tokens_edited", pa.int64()), ("n_chars_edited", pa.int64()), ("n_reencoded", pa.int64()))


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def plant_trees(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY_FILE) -> DataFrame:
    """key and ``tree``: text, and length and tokens of each pre-token.  A tree grows back from
    these without splitting or encoding.  Null texts are empty; other columns are not read."""
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("tree", TREE)])

    def run(batches):
        count = counter(path)
        kind = pa.struct([("text", pa.string()), ("lengths", pa.list_(pa.int32())), ("numbers", pa.list_(pa.int32()))])
        for batch in _slices(batches):
            trees = []
            for t in batch.column(1):
                t = t.as_py()
                pieces = count.split(t)
                trees.append({"text": t, "lengths": list(map(len, pieces)), "numbers": count.counts(pieces)})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, kind)], names=["k", "tree"])

    return docs.select(F.col(key), text_of(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


def count_edited(trees: DataFrame, edits: Column, key: str = "doc_id", path: str = VOCABULARY_FILE) -> DataFrame:
    """Applies each document's edits to its tree, one after the other, and returns the token counts
    before and after, the characters after, and how many pre-tokens were encoded for the edits.

    ``edits`` is an array of (start, stop, text): characters [start, stop) of the text as it stands by then
    become ``text``; places beyond the end count as the end, a null text deletes, a null place is the
    start, a null array holds no edits.  Null or repeated keys are carried row by row."""
    stored = lambda t: (t["text"], (t["lengths"], t["numbers"]))
    return _edited(trees.select(F.col(key), "tree", edits.cast(EDITS).alias("edits")), key, path, stored)


def count_documents(docs: DataFrame, edits: Column, key: str = "doc_id", text: str = "text", path: str = VOCABULARY_FILE) -> DataFrame:
    """``plant_trees`` and ``count_edited`` in one pass, for trees that are not to be kept."""
    return _edited(docs.select(F.col(key), text_of(text).alias("t"), edits.cast(EDITS).alias("edits")), key, path, lambda t: (t, None))


def _edited(rows: DataFrame, key: str, path: str, read) -> DataFrame:
    names = [n for n, _ in COUNTS]
    schema = T.StructType([T.StructField("k", rows.schema[key].dataType), *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches):
        count = counter(path)
        for batch in _slices(batches):
            out = []
            for text, edits in zip(batch.column(1), batch.column(2)):
                text, stored = read(text.as_py())
                tree, edits = PretokenTree(text, count, stored), edits.as_py() or []
                planted, before, tree.encoded = tree.n_pretokens, tree.n_tokens, 0
                for e in edits:
                    tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                out.append((before, planted, len(edits), tree.n_tokens, tree.n_chars, tree.encoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, (_, t) in zip(zip(*out), COUNTS)]], names=["k", *names])

    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def revisions(key: str, text: Column) -> Column:
    """Edits derived from a document itself: a passage moves to a hashed place, a stretch is
    deleted, a character inside a word is replaced, and a line is appended."""
    n = F.length(text)
    place = lambda salt: F.when(n > 0, F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.greatest(n, F.lit(1)))).otherwise(0).cast("int")
    edit = lambda start, stop, new: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), new.alias("text"))
    return F.array(edit(place("move"), place("move"), F.substring(text, 1, 120)), edit(place("cut"), place("cut") + 60, F.lit("")),
                   edit(place("turn"), place("turn") + 1, F.lit("x")), edit(n + 121, n + 121, F.lit("\n  Revised:  it's done")))
