"""Texts from files, reports to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inline(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(1, text)], "id long, text string")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, path, text): one row a file, ids by a hash of the path."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select(F.xxhash64("path").alias("id"), "path", "text")


def json_batch(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, text) of a JSON array whose entries are strings or objects {prompt, tier or label}. Ids are places
    in the array from 1; blank texts are dropped, so ids can have gaps; without a label it is ``#id``."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("entries"))
    rows = whole.select(F.posexplode("entries").alias("at", "entry"))
    is_object = F.col("entry").startswith("{")
    prompt = F.when(is_object, F.get_json_object("entry", "$.prompt")).otherwise(F.col("entry"))
    label = F.when(is_object, F.coalesce(F.get_json_object("entry", "$.tier"), F.get_json_object("entry", "$.label")))
    named = rows.select((F.col("at") + 1).cast("long").alias("id"), label.alias("label"), F.coalesce(prompt, F.lit("")).alias("text"))
    return named.filter(F.trim("text") != "").select("id", F.coalesce("label", F.concat(F.lit("#"), F.col("id"))).alias("label"), "text")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


REPORT = ["id", "label", "preview", "score", "verdict", "domain"]


def write_csv_report(report: DataFrame, path: str) -> None:
    """A ranked report as one CSV file with a header, best first; the rank is the order, not a column. The file is written row by row as
    the partitions arrive in order."""
    import csv

    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(REPORT)
        out.writerows(tuple(r) for r in report.orderBy("rank").select(*REPORT).toLocalIterator())


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_results(rows: DataFrame, path: str) -> None:
    """Results as one JSON array in a file, in the order of their ids."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for n, r in enumerate(rows.orderBy("id").select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
            f.write(",\n" * (n > 0) + r["j"])
        f.write("]\n")


def report(scored: DataFrame) -> DataFrame:
    """Lines of a terminal report: (id, ord, dimension, score, bar, colour)."""
    from textgauge.operators.advice import dimensions

    filled = F.round(F.col("score") * 20).cast("int")
    bar = F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(20) - filled))
    colour = F.when(F.col("score") >= 0.75, "green").when(F.col("score") >= 0.5, "yellow").when(F.col("score") >= 0.3, "orange").otherwise("red")
    return dimensions(scored).select("id", "ord", "dimension", "score", bar.alias("bar"), colour.alias("colour"))
