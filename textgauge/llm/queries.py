"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from textgauge.llm.pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from textgauge.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textgauge.llm.kneser_ney import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textgauge.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files at source/lang/<hundreds of the id>/<id>.txt."""
    from textgauge.llm.licenses import scan_licenses

    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.expr("doc_id div 100"), F.concat(F.col("doc_id"), F.lit(".txt")))
    return scan_licenses(docs.select("doc_id", path.alias("path"), "text"), id_col="doc_id").withColumnRenamed("file_id", "doc_id")


def op6_block_matrix_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textgauge.llm.nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textgauge.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textgauge.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from textgauge.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textgauge.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
