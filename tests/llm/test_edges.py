"""Every operator on odd rows and on empty tables."""
import pytest

import cases
from tailcast.llm import chunking, decontaminate, extract, jaccard, mixing, quality, secrets, sharding, tokens, warc
from pyspark.sql import functions as F


def items(spark, rows=((1, "what is it? it is that thing there"), (2, None), (3, ""), (4, "one"), (1, "what is it? it is that thing there"))):
    return spark.createDataFrame(list(rows), "item_id int, text string")


OPERATORS = {
    "tokens": lambda s, d: tokens.count_edited(tokens.plant_trees(d), tokens.revisions("doc_id", F.col("tree.text"))),
    "decontaminate": lambda s, d: decontaminate.find_leaks(d, items(s)),
    "keep_clean": lambda s, d: decontaminate.keep_clean(d, items(s)),
    "sharding": lambda s, d: sharding.assign_shards(d, 5),
    "mixing": lambda s, d: mixing.mix(d),
    "quality": lambda s, d: quality.judge(d),
    "keep_good": lambda s, d: quality.keep_good(d),
    "secrets": lambda s, d: secrets.digest(secrets.scan_secrets(d)),
    "chunking": lambda s, d: chunking.repeated_passages(d),
    "remove_repeats": lambda s, d: chunking.remove_repeats(d),
    "jaccard": lambda s, d: jaccard.near_duplicates(d),
    "without_near_copies": lambda s, d: jaccard.without_near_copies(d),
}
PER_ROW = {"tokens", "sharding", "quality", "secrets", "remove_repeats", "jaccard"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = cases.documents(spark)
    got = OPERATORS[name](spark, docs).collect()
    if name in PER_ROW:
        assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((r[0] is None, r[0]) for r in cases.rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, cases.documents(spark, [])).collect() == []


def test_passing_operators_keep_columns_and_clashing_names(spark):
    docs = cases.documents(spark)
    for name in ("keep_clean", "keep_good", "remove_repeats", "without_near_copies"):
        assert OPERATORS[name](spark, docs).columns == docs.columns
    assert mixing.mix(docs, extra=False).columns == docs.columns
    assert OPERATORS["mixing"](spark, docs).columns == [c for c in docs.columns if c != "copy"] + ["copy", "shuffle_key"]


def test_pages(spark):
    given = [(1, None, None), (2, "http://h/x", ""), (None, "nonsense", "<p>a &amp; b"), (3, "http://h/y", "<p>x</p>" * 30_000), (3, "http://h/y", "<p>x</p>" * 30_000), (4, "http://h/z\r\nA: b", "a" * 1200), (5, "u", "a" * 1200), (6, None, "a" * 1200)]
    got = extract.extract(cases.pages(spark, given)).collect()
    assert sorted((r.page_id is None, r.page_id) for r in got) == sorted((r[0] is None, r[0]) for r in given)
    assert {r.page_id: r.text for r in got}[None] == "a & b" and {r.page_id: r.n_chars for r in got}[1] == 0
    back = warc.round_trip(cases.pages(spark, given)).collect()
    assert sorted((r.page_id is None, r.page_id) for r in back) == sorted((r[0] is None, r[0]) for r in given)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in back}
    assert {(4, "revisit", 6), (5, "revisit", 6), (6, "response", None), (3, "response", None), (1, "response", None)} <= kinds
    for run in (extract.extract, warc.round_trip):
        assert run(cases.pages(spark, [])).collect() == []


def test_pipeline_on_odd_rows_and_empty_table(spark, tmp_path):
    import corpus_pipeline as P
    for name, given in (("odd", None), ("empty", [])):
        at = str(tmp_path / name)
        cases.documents(spark, given).write.parquet(f"{at}/documents.parquet")
        items(spark).write.parquet(f"{at}/benchmark.parquet")
        out = P.run(spark, at)
        assert "shard" in out.columns and (out.count() == 0 or name == "odd")
