"""License scan by diagonal voting.

Every run of three words of every document is hashed and joined with the places of the same runs in the templates.
A hit at word p of the text and word t of a template votes for the diagonal p - t.  Diagonals with enough votes
that lie next to each other are one passage with words put in or left out; its span is verified word by word."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, stage, text_of
from .middle import slices

K = 3                          # words of a run
MIN_VOTES = 4                  # different template places that a diagonal needs, or all that the template has
NEIGHBOUR = 8                  # words that may be put in or left out between two diagonals of one passage
MIN_COVER = 0.9                # share of a template's words that must stand in the span
HASHED = 64                    # bytes of a word that its hash sees, besides its length; templates have shorter words

# Phrases whose places are counted, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Published license texts and notices, with their labels.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies."""),
    ("bsd-2", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code
must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd-3", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
version 3 of the License, or (at your option) any later version."""),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either
version 2 of the License, or (at your option) any later version."""),
    ("agpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version."""),
    ("lgpl-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;
either version 2.1 of the License, or (at your option) any later version."""),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = True
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"        # of text with A-Z lower-cased; as a pattern for whole code points
ANY_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"      # the same words before lower-casing
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of K words of each text, and the number of runs of each text."""
    low = _LOWER[data]
    word = _WORD[low]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    edges = borders[1:-1][(borders[1:-1] > 0) & (borders[1:-1] < len(data))]
    opens[edges], closes[edges - 1] = word[edges], word[edges - 1]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    size = stop - start
    hashes = size.astype(np.uint64) * _ODD
    live = np.arange(len(start))
    for i in range(min(HASHED, int(size.max(initial=0)))):
        live = live[size[live] > i]
        hashes[live] = (hashes[live] ^ low[start[live] + i]) * np.uint64(0x100000001B3) + _ODD
    hashes = _mix(hashes)
    words = np.searchsorted(start, borders[1:], "left") - np.searchsorted(start, borders[:-1], "left")
    runs = np.zeros(max(len(hashes) - K + 1, 0), np.uint64)
    for i in range(K):
        runs = _mix(runs * _ODD + hashes[i:len(hashes) - K + 1 + i]) if len(runs) else runs
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    n = np.maximum(words - K + 1, 0)
    keep = np.repeat(first - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    return runs[keep].view(np.int64), n


def _runs(batches):
    for batch in batches:
        for at, data, borders in slices(batch.column("t")):
            hashes, n = run_hashes(data, borders)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("digest").slice(at, len(n)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes))], names=["digest", "runs"])


def template_runs(spark: SparkSession, templates) -> DataFrame:
    """(run, template, t, size): every run of every template and its place."""
    rows = []
    for i, words in enumerate(templates):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        hashes, n = run_hashes(data, np.array([0, len(data)]))
        rows += [(int(h), i, t, int(n[0])) for t, h in enumerate(hashes)]
    table = spark.createDataFrame(rows, "run bigint, template int, t int, size int")
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def diagonals(texts: DataFrame, templates, phrases: int) -> DataFrame:
    """(digest, template, passage, d, low, high): diagonals that may hold a template, and the template places from the
    first to the last vote.  ``passage`` numbers neighbouring diagonals.  A phrase (one of the first ``phrases``
    templates) needs every vote, and each diagonal is a passage of its own."""
    runs = texts.mapInArrow(_runs, "digest binary, runs array<bigint>").select("digest", F.posexplode("runs").alias("p", "run"))
    hits = runs.join(template_runs(texts.sparkSession, templates), "run").select("digest", "template", (F.col("p") - F.col("t")).alias("d"), "t", "size")
    # a set, so copies of a text, which share its digest, vote once; it holds at most the places of one template
    voted = hits.groupBy("digest", "template", "d").agg(F.collect_set("t").alias("votes"), F.first("size").alias("size"))
    needed = F.when(F.col("template") < phrases, F.col("size")).otherwise(F.least(F.col("size"), F.lit(MIN_VOTES)))
    kept = voted.where(F.size("votes") >= needed).select("digest", "template", "d", F.array_min("votes").alias("low"), (F.array_max("votes") + K - 1).alias("high"))
    along = Window.partitionBy("digest", "template").orderBy("d")
    new = F.coalesce((F.col("template") < phrases) | (F.col("d") - F.lag("d").over(along) > NEIGHBOUR), F.lit(True))
    return kept.withColumn("passage", F.sum(new.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))


def check(words: list[str], passages: dict, templates, labels, phrases: int) -> list[tuple]:
    """(template, start, stop, score) of passages that hold: a phrase word for word, others with MIN_COVER of the
    template's words in place.  A template is beaten by one of another label and a better score with which it shares half of a span or more."""
    found = []
    for (template, _), lines in passages.items():
        wanted, at = templates[template], {}
        for d, low, high in sorted(lines):
            for t in range(low, high + 1):
                if 0 <= t + d < len(words) and words[t + d] == wanted[t]:
                    at.setdefault(t, t + d)
        if len(at) >= (len(wanted) if template < phrases else MIN_COVER * len(wanted)):
            found.append((template, min(at.values()), max(at.values()) + 1, len(at) / len(wanted)))
    whole = [f for f in found if f[0] >= phrases]
    beaten = lambda f: any(g[3] > f[3] and labels[g[0]] != labels[f[0]] and 2 * (min(f[2], g[2]) - max(f[1], g[1])) >= min(f[2] - f[1], g[2] - g[1]) for g in whole)
    kept = [f for f in found if f[0] < phrases or not beaten(f)]
    return sorted(kept, key=lambda f: (f[1], f[2], f[0]))


SPANS = "array<struct<label:string,base:boolean,start:bigint,stop:bigint,score:double>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=None, templates=None) -> DataFrame:
    """One row per document: key, n_words and ``spans``, sorted structs of label, base (a phrase), start and stop
    in words (stop exclusive) and score, the share of the template's words that stand there.

    A null text counts as empty.  Keys are only carried, so null or repeated ones are kept row by row; equal texts
    share their spans.  Other columns are not read; an empty table gives no rows.  Votes, diagonals and spans are keyed
    by the digest of the text, so a text is neither shuffled nor stored unless it holds a candidate; copies of it
    are reduced to one before.  ``templates`` are (label, text); those under K words are refused."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    listed = [words_of(w) for w in (*phrases, *(body for _, body in templates))]
    labels = [*phrases.values(), *(label for label, _ in templates)]
    if any(len(w) < K or max(map(len, w)) > HASHED // 4 for w in listed):
        raise ValueError(f"templates need {K} words or more, of at most {HASHED // 4} characters")
    known = len(phrases)

    def verify(found: pa.Table, bodies: pa.Table) -> pa.Table:
        passages: dict = {}
        for r in found.to_pylist():
            passages.setdefault((r["template"], r["passage"]), []).append((r["d"], r["low"], r["high"]))
        lines = check(words_of(bodies.column("t")[0].as_py()), passages, listed, labels, known)
        spans = [{"label": labels[i], "base": i < known, "start": a, "stop": b, "score": s} for i, a, b, s in lines]
        return pa.table({"digest": bodies.column("digest")[:1], "spans": pa.array([spans], _SPAN)})

    digest = F.unhex(F.sha2(text_of(text).cast("binary"), 256)).alias("digest")
    texts = docs.select(digest, text_of(text).alias("t"))
    candidates = stage(diagonals(texts, listed, known), "license-diagonals")
    digests = stage(candidates.select("digest").distinct(), "license-digests")
    once = texts.join(small(digests), "digest", "left_semi").groupBy("digest").agg(F.first("t").alias("t"))
    spans = stage(candidates.groupBy("digest").cogroup(once.groupBy("digest")).applyInArrow(verify, f"digest binary, spans {SPANS}"), "license-spans")
    rows = docs.select(F.col(key).alias("k"), F.regexp_count(text_of(text), F.lit(ANY_WORD)).cast("long").alias("n_words"), digest)
    return rows.join(spans, "digest", "left").select(F.col("k").alias(key), "n_words", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, borders and labels of the spans."""
    base = F.filter("spans", lambda s: s["base"])
    starts: Column = F.transform(base, lambda s: s["start"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(key, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"))
