"""Row metrics over a stream of texts: stateless, so they run on ``readStream`` as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textgauge.operators.evaluate import with_metrics


def stream_metrics(stream: DataFrame, wanted: list[str]) -> DataFrame:
    """(id, *wanted) of a streaming DataFrame (id, text)."""
    return with_metrics(stream, wanted=wanted).select("id", *wanted)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").parquet(folder).selectExpr("doc_id AS id", "text")
