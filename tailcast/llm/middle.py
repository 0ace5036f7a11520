"""Fill-in-middle transformation by displacement scatter.

A batch of texts is one run of bytes.  Cuts are scanned from it, a difference array holds at each cut how much
further the following bytes move, its running sum is the displacement of every byte, and one scatter writes all
outputs of the batch.  Restoring is the inverse gather, from output and form alone."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

SEED, RATE, SPM = 42, 50, 80        # percent of documents transformed, and of those in suffix-first order
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM_FORM = range(3)
LETTERS = np.frombuffer(b"PSM", np.uint8)       # markers are <P>, <S> and <M>
MARK = 3                            # bytes of a marker
SLICE = 4 << 20                     # bytes moved at once; a longer text is moved by itself

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[LETTERS] = True


def slices(column: pa.Array):
    """(first row, bytes, borders) of runs of texts of about SLICE bytes; borders has one entry more than rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, data[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at]
        at = stop


def token_ends(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Ends of all tokens: a word with the white space before it, or the white space after the last word."""
    space = _SPACE[data]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[borders[1:][borders[1:] > borders[:-1]] - 1] = True      # the last byte of a text ends a token of either kind
    return np.flatnonzero(ends) + 1


def markers(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all markers that lie inside one text, and the rows of those texts."""
    open_ = np.flatnonzero(data[:-2] == 60) if len(data) > 2 else np.zeros(0, np.int64)
    at = open_[(data[open_ + 2] == 62) & _LETTER[data[open_ + 1]]]
    row = np.searchsorted(borders, at, "right") - 1
    inside = at + MARK <= borders[row + 1]
    return at[inside], row[inside]


def displace(size: int, starts: list[np.ndarray], shifts: list[np.ndarray]) -> np.ndarray:
    """Shift of every byte: ``starts`` and ``shifts`` list the segments of each text in order.  Segments may be
    empty: differences at one place add up."""
    at, by = np.stack(starts, 1).ravel(), np.stack(shifts, 1).ravel()
    kind = np.int32 if size < 1 << 30 else np.int64
    steps = np.zeros(size + 1, kind)
    np.add.at(steps, at, np.diff(by, prepend=0).astype(kind))
    return np.cumsum(steps[:size], dtype=kind)


def scatter(data: np.ndarray, borders: np.ndarray, a: np.ndarray, b: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output bytes and borders for texts cut at ``a`` and ``b``."""
    s, e = borders[:-1], borders[1:]
    moved = form != PLAIN
    out = np.concatenate([[0], np.cumsum(e - s + 3 * MARK * moved)])
    o, prefix, suffix = out[:-1], a - s, e - b
    first = np.where(form == PSM, o + MARK, o + 2 * MARK + suffix)              # where the prefix goes
    last = np.where(form == PSM, o + 2 * MARK + prefix, o + MARK)               # the suffix
    middle = o + 3 * MARK + prefix + suffix
    shifts = [np.where(moved, first - s, o - s), np.where(moved, middle - a, o - s), np.where(moved, last - b, o - s)]
    result = np.empty(out[-1], np.uint8)
    shift = displace(len(data), [s, a, b], shifts)
    result[np.arange(len(data), dtype=shift.dtype) + shift] = data
    for place, letter in zip((first, last, middle), LETTERS):
        for i, byte in enumerate((60, letter, 62)):
            result[(place - MARK + i)[moved]] = byte
    return result, out


def gather(data: np.ndarray, borders: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts again.  A text that holds a marker is never moved, and no text can run into a marker to make
    another one, so a moved output has exactly the three that were written."""
    moved = form != PLAIN
    at, row = markers(data, borders)
    at = at[moved[row]].reshape(-1, 3)
    s, e = borders[:-1], borders[1:]
    out = np.concatenate([[0], np.cumsum(e - s - 3 * MARK * moved)])
    o = out[:-1]
    size = [np.zeros(len(s), np.int64) for _ in range(2)]       # of prefix and middle
    source = [s.copy() for _ in range(3)]                       # of prefix, middle and suffix
    size[0][~moved] = (e - s)[~moved]
    source[1][~moved] = source[2][~moved] = e[~moved]
    one, two = at[:, 0] + MARK, at[:, 1] + MARK
    psm = form[moved] == PSM
    size[0][moved] = np.where(psm, at[:, 1] - one, at[:, 2] - two)
    size[1][moved] = e[moved] - at[:, 2] - MARK
    source[0][moved], source[1][moved], source[2][moved] = np.where(psm, one, two), at[:, 2] + MARK, np.where(psm, two, one)
    starts = [o, o + size[0], o + size[0] + size[1]]
    shift = displace(int(out[-1]), starts, [f - t for f, t in zip(source, starts)])
    return data[np.arange(out[-1], dtype=shift.dtype) + shift], out


def _strings(data: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())


def _cut(batches):
    for batch in batches:
        texts, draws = batch.column(1), [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]
        for at, data, borders in slices(texts):
            rows = len(borders) - 1
            h1, h2, h3, h4 = (d[at:at + rows] for d in draws)
            ends = token_ends(data, borders)
            first = np.searchsorted(ends, borders[:-1], "right")
            n = np.searchsorted(ends, borders[1:], "right") - first
            cuts = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), 0)
            a, b = (np.where(c > 0, np.concatenate([ends, [0]])[np.where(c > 0, first + c - 1, -1)], borders[:-1]) for c in cuts)
            plain = (n == 0) | h3.astype(bool)
            plain[markers(data, borders)[1]] = True
            form = np.where(plain, PLAIN, np.where(h4.astype(bool), SPM_FORM, PSM))
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            result, out = scatter(data, borders, a, b, form)
            chars = [pa.array(points[t] - points[f], pa.int64(), mask=plain) for f, t in ((borders[:-1], a), (a, b))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(n, pa.int64()), pa.array(np.array(FORMS)[form], pa.string()), *chars, _strings(result, out)],
                                             names=["k", "n", "form", "prefix_chars", "middle_chars", "output"])


def _restore(batches):
    for batch in batches:
        texts, names = batch.column("output"), batch.column("form")
        for at, data, borders in slices(texts):
            rows = len(borders) - 1
            form = np.array([FORMS.index(f) for f in names.slice(at, rows).to_pylist()])
            part = batch.slice(at, rows)
            yield pa.RecordBatch.from_arrays([*part.columns, _strings(*gather(data, borders, form))], names=[*part.schema.names, "restored"])


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned integers of 32 bits from the hash of ``seed:key``; a null key counts as no characters."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """One row per document: key, n (tokens), form (plain, psm or spm), prefix_chars and middle_chars (null if
    plain) and output, the rearranged text.

    Of every hundred documents ``rate`` are rearranged, ``spm`` percent of them suffix first.  Cuts fall
    between tokens, at places drawn from the hash of the key, so repeated rows get equal outputs.  Empty and
    null texts, and texts that hold a marker, stay plain (null: empty).  A null key is drawn like an empty one.
    Other columns are not read; an empty table gives no rows.  Nothing is shuffled."""
    h = draws(F.col(key), seed)
    rows = docs.select(F.col(key).alias("k"), text_of(text).alias("t"), h[0].alias("h1"), h[1].alias("h2"), (h[2] % 100 >= rate).cast("int").alias("stays"), (h[3] % 100 < spm).cast("int").alias("swaps"))
    kind = rows.schema["k"].dataType.simpleString()
    made = rows.mapInArrow(_cut, f"k {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return made.withColumnRenamed("k", key)


def restore(transformed: DataFrame) -> DataFrame:
    """Adds ``restored``, the text rebuilt from ``output`` and ``form`` alone."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema)
    return transformed.mapInArrow(_restore, f"{schema}, restored string")
