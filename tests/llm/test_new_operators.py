"""Fill-in-middle, Merkle manifest and license scan against brute force on odd and planted rows."""
import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import cases
from tailcast.llm import licenses, merkle, middle, queries
from tailcast.llm.common import load

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11

def draws(key):
    digest = sha(f"42:{'' if key is None else key}")
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def rearranged(key, text):
    text, h = text or "", draws(key)
    tokens = TOKEN.findall(text)
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    parts = ["".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    p, m, s = parts
    return len(tokens), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def moved(texts):
    h = [draws(k) for k in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), *[pa.array([x[i] for x in h], pa.int64()) for i in (0, 1)],
                                        pa.array([int(x[2] % 100 >= 50) for x in h], pa.int32()), pa.array([int(x[3] % 100 < 80) for x in h], pa.int32())], names=["k", "t", "h1", "h2", "stays", "swaps"])
    made = list(middle._cut([batch]))
    return [r for b in middle._restore(made) for r in b.to_pylist()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "é", "漢", " ", "\n", "\x0b", "<", "S", ">", "P", "M", "<S", "word "]), max_size=40).map("".join), min_size=1, max_size=40))
def test_scatter_and_gather(texts):
    for k, r in enumerate(moved(texts)):
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == rearranged(k, texts[k]) and r["restored"] == texts[k]


def test_slices_do_not_change_results(monkeypatch):
    texts = [cases.prose(i, 40 + i) for i in range(60)] + ["", cases.prose(9, 3_000)]
    whole = moved(texts)
    monkeypatch.setattr(middle, "SLICE", 700)
    assert moved(texts) == whole


def test_fill_in_middle_on_odd_rows(spark):
    docs = cases.documents(spark).unionByName(cases.documents(spark, [(i, f"holds <{x}> itself", "en", "a", 1) for i, x in enumerate("PSM", 50)]))
    got = middle.restore(middle.transform(docs)).collect()
    want = [(r.doc_id, *rearranged(r.doc_id, r.text), r.text or "") for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert middle.restore(middle.transform(cases.documents(spark, []))).collect() == []


def test_fill_in_middle_rates(spark):
    got = {r.form: r["count"] for r in middle.transform(load(spark, SF, "documents"), rate=100, spm=0).groupBy("form").count().collect()}
    assert set(got) <= {"psm", "plain"} and got["psm"] > 190


# ---- 12

def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i:i + 2])) for i in range(0, len(found[-1]), 2)])
    return found


def manifest_rows(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id, sha("".join(map(enc, (r.doc_id, r.source, r.lang, r.n_chars, r.text)))), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: levels([x[1] for x in groups[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    for at, g in enumerate(names):
        for i, (key, leaf, r) in enumerate(groups[g]):
            n = r.n_chars
            if key is not None and n is not None and zlib.crc32(str(key).encode()) % 7 == 0:
                n += 1
            node, siblings = sha("".join(map(enc, (key, r.source, g, n, r.text)))), []
            for tree, place in ((trees[g], i), (top, at)):
                for level in tree[:-1]:
                    other = level[place ^ 1] if place ^ 1 < len(level) else ""
                    siblings.append(other)
                    node, place = sha(other + node if place & 1 else node + other), place // 2
            root = top[-1][0]
            out.append((key, leaf, trees[g][-1][0], root, sha("".join(siblings)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", ["odd", "tables", "repeated", "one group", "one row", "empty"])
def test_manifest_equals_a_tree_built_in_order(spark, name):
    docs = {"odd": lambda: cases.documents(spark), "tables": lambda: load(spark, SF, "documents"), "one group": lambda: load(spark, SF, "documents").withColumn("lang", F.lit(None).cast("string")),
            "one row": lambda: cases.documents(spark, [(1, "a", "en", "b", 1)]), "empty": lambda: cases.documents(spark, []),
            # negative and far keys, and one key that holds a third of the rows of each group
            "repeated": lambda: load(spark, SF, "documents").withColumn("doc_id", F.expr("case when doc_id % 3 = 0 then 70 when doc_id % 5 = 0 then -doc_id when doc_id % 7 = 0 then doc_id * 1000000007 else doc_id end"))}[name]()
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text").collect()
    got = sorted(map(tuple, queries.merkle_rows(docs).collect()), key=str)
    assert got == (manifest_rows(rows) if rows else [])
    assert all(r[-1] for r in got if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7)


def test_blocks_of_several_rounds(spark, monkeypatch):
    docs = load(spark, SF, "documents")
    whole = sorted(map(tuple, queries.merkle_rows(docs).collect()), key=str)
    spread = merkle.manifest(docs).select("doc_id", "place", "lang").collect()
    assert sorted((r.lang, r.place) for r in spread) == [(g, i) for g in sorted({r.lang for r in spread}) for i in range(sum(r.lang == g for r in spread))]
    for levels_ in (1, 3):
        monkeypatch.setattr(merkle, "LEVELS", levels_)
        monkeypatch.setattr(merkle, "BLOCK", 2 ** levels_)
        nodes = [[sha(str(i)) for i in range(n)] for n in (1, 2, 3, 9, 16)]
        for n in nodes:
            found, total = n, len(n)
            while total > 1:
                found = [merkle.levels(found[i:i + merkle.BLOCK], total)[-1][0] for i in range(0, total, merkle.BLOCK)]
                total = -(-total // merkle.BLOCK)
            assert found[0] == levels(n)[-1][0]
    assert whole == manifest_rows(docs.collect())


# ---- 13

def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def places(text):
    words, found = re.findall(licenses.WORD, lower(text)), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_phrases_equal_brute_force(spark):
    r = random.Random(5)
    parts = ["under", "the", "mit", "license", "Under the MIT License", "apache license, VERSION 2", "CC-BY-NC", "cc", "by", "nc", "é", "x\x7fy", "K", "w" * 90, ".", "\n"]
    rows = [(i, r.choice([" ", "  ", "-"]).join(r.choices(parts, k=r.choice([0, 1, 3, 30]))), "en", "a", 1) for i in range(300)]
    docs = cases.documents(spark, rows).unionByName(cases.documents(spark))
    got = licenses.digest(licenses.find_licenses(docs)).collect()
    want = [(d.doc_id, *places(d.text)) for d in docs.collect()]
    assert sorted((tuple(g)[:6] for g in got), key=str) == sorted(want, key=str)
    assert licenses.digest(licenses.find_licenses(cases.documents(spark, []))).collect() == []


def edited(body, seed):
    """A license with a word put in, one left out and one changed, inside other text."""
    r, words = random.Random(seed), body.split()
    for change in range(3):
        i = r.randrange(8, len(words) - 8)
        words[i:i + 1] = [[words[i], "inserted"], [], ["changed"]][change]
    return f"{cases.prose(seed, 50)}\n\n{' '.join(words)}\n{cases.prose(seed + 1, 40)}"


def test_edited_licenses_are_found_where_they_stand(spark):
    long = [(i, label, body) for i, (label, body) in enumerate(licenses.TEMPLATES) if len(body.split()) > 60]
    docs = cases.documents(spark, [(i, edited(body, i), "en", "a", 1) for i, _, body in long] * 2 + [(100 + i, cases.prose(i, 300), "en", "a", 1) for i in range(20)])
    got = licenses.find_licenses(docs).collect()
    for r in got:
        if r.doc_id >= 100:
            assert r.spans == []
            continue
        label = licenses.TEMPLATES[r.doc_id][0]
        span = max((s for s in r.spans if s.label == label and not s.base), key=lambda s: s.stop - s.start)
        assert 48 <= span.start <= 52 and 0.9 <= span.score < 1 and {s.label for s in r.spans} == {label}


def test_the_better_of_two_notices_stays(spark):
    bodies = dict((label, body) for label, body in licenses.TEMPLATES[:9])
    docs = cases.documents(spark, [(1, bodies["gpl-3"], "en", "a", 1), (2, bodies["gpl-2"], "en", "a", 1), (3, bodies["mit"][:200], "en", "a", 1), (4, bodies["mit"] + " " + bodies["gpl-3"] + " " + bodies["mit"], "en", "a", 1)])
    got = {r.doc_id: [(s.label, s.score) for s in r.spans] for r in licenses.find_licenses(docs).collect()}
    assert got == {1: [("gpl-3", 1.0)], 2: [("gpl-2", 1.0)], 3: [], 4: [("mit", 1.0), ("gpl-3", 1.0), ("mit", 1.0)]}


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError):
        licenses.find_licenses(cases.documents(spark), templates=[("x", "two words")])


def test_frequent_ngrams_as_arrow_lists():
    import numpy as np
    from tailcast.llm import jaccard
    values = np.array([5, 2**63 + 1, 7, 5, 2**63 + 1, 5, 9], np.uint64)
    g, c = jaccard._repeated(values.copy())
    assert dict(zip(g.view(np.uint64).tolist(), c.tolist())) == {5: 3, 2**63 + 1: 2}
    empty = jaccard._repeated(np.empty(0, np.uint64))
    assert jaccard._lists({1: (g, c), 3: empty}, 4).to_pylist() == [None, [{"g": 5, "c": 3}, {"g": 1 - 2**63, "c": 2}], None, []]
    assert jaccard._lists({}, 2).to_pylist() == [None, None]


def test_quality_hands_rows_on_in_slices():
    """A batch of documents leaves in parts, so that no worker holds the counts of all of it as Python objects."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from tailcast.llm import quality

    class Docs:
        columns, schema = ["k", "t"], T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.StringType())])

        def mapInArrow(self, run, schema):
            return run
    texts = [None if i % 7 == 0 else "the of word " * (i % 5) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], names=["k", "t"])
    out = list(quality.with_features(Docs(), "t")(iter([batch])))
    assert max(b.num_rows for b in out) <= quality.SLICE
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["k"] for r in rows] == list(range(1000)) and [r["__quality_n_words"] for r in rows] == [len((t or "").split()) for t in texts]
