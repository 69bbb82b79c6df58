"""The queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import attention_lm, bayes_minhash, bpe, cotraining, decontaminate, fim, flac, licenses, merkle_audit, oracles, pii, simhash, url_filter, whitening
from millrace.llm.shared import table

#: The rules of query 9.
OP9_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_audit.report(*merkle_audit.page_replicas(table(spark, sf_dir, "pages")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), OP9_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotraining.fit(docs, table(spark, sf_dir, "labels"))
    return cotraining.score(docs, model).select("doc_id", "p_text", "p_page", "score", "keep")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op12_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bayes_minhash.groups(table(spark, sf_dir, "documents"), percent=80, width=2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merkle_audit": op1_merkle_audit,
        "op2_bpe": op2_bpe,
        "op3_pii": op3_pii,
        "op4_flac": op4_flac,
        "op5_decontaminate": op5_decontaminate,
        "op6_simhash": op6_simhash,
        "op7_licenses": op7_licenses,
        "op8_attention_lm": op8_attention_lm,
        "op9_url_filter": op9_url_filter,
        "op10_cotraining": op10_cotraining,
        "op11_whitening": op11_whitening,
        "op12_bayes_minhash": op12_bayes_minhash,
        "op13_fim": op13_fim,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_merkle_audit": oracles.op1(),
        "op5_decontaminate": oracles.op5(),
        "op7_licenses": oracles.op7(),
        "op9_url_filter": oracles.op9(OP9_RULES),
        "op12_bayes_minhash": oracles.op12(),
        "op13_fim": oracles.op13(),
    }
