"""Named queries of the operators: thin calls over whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunking, decontaminate, extract, jaccard, licenses, merkle, middle, mixing, quality, secrets, sharding, tokens, warc
from .common import load, stage, text_of


def op1_edit_aware_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_documents(load(spark, sf_dir, "documents"), tokens.revisions("doc_id", text_of("text")))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op3_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.where("contaminated").drop("contaminated")


def op4_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(load(spark, sf_dir, "pages"))


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(load(spark, sf_dir, "documents"), 24)


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are repeated, shuffled and written; the rows name each one's document and place."""
    return stage(mixing.mix(load(spark, sf_dir, "documents")), "mixture").select("doc_id", "source", "copy", "shuffle_key")


def op7_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(load(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op8_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(load(spark, sf_dir, "documents")))


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.repeated_passages(load(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(load(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.restore(middle.transform(load(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def merkle_rows(docs: DataFrame) -> DataFrame:
    """Digests of each leaf's proof, and the root that follows from the leaf when some rows have grown by one character."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    grown = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    held = merkle.manifest(docs, columns, carry={"held": merkle.leaf_of([grown if c == "n_chars" else F.col(c) for c in columns])})
    rows = held.withColumn("folded_root", merkle.fold(F.col("held"), F.col("steps")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_of(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_rows(load(spark, sf_dir, "documents"))


def op13_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find_licenses(load(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_edit_aware_tokens, op2_warc_transactions, op3_bm25_decontamination, op4_wrapper_extraction, op5_jump_sharding, op6_poisson_mixing, op7_divergence_rules,
    op8_credential_linking, op9_chunk_dedup, op10_ngram_jaccard, op11_fill_in_middle, op12_merkle_manifest, op13_license_diagonals)}
