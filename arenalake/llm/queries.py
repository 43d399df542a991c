"""One query per operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit, decontaminate, jaccard, lm, mixing, pii, quality, secrets, suffix, superkmer, trie, urls, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(_table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_superkmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.digest(_table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.spliced(_table(spark, sf_dir, "conversations"))).drop("id")


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality, op3_mixing, op4_suffix, op5_jaccard, op6_decontaminate, op7_superkmer, op8_urls, op9_lm, op10_secrets, op11_audit, op12_trie, op13_vectors)}
ORACLES: dict[str, str] = {"op2_quality": quality.SQL, "op6_decontaminate": decontaminate.SQL, "op11_audit": audit.SQL, "op12_trie": trie.SQL, "op13_vectors": vectors.SQL}
