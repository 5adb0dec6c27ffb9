"""A training corpus from raw documents: quality classifier, quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns they were given.
``run`` writes each stage's result as Parquet and reads it again for the next one.

Verdicts act on rows: rows that share an id but not their text are judged each for itself, and rows without an id are
documents like others. Null texts count as empty: the rules drop them. Equal rows, and rows of one id and one text, are
one document from near-dedup on. Ties go to the smaller id. Empty tables stay empty. Extra columns, whatever their names, are carried
along up to packing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from textgauge.llm.common import configure, language, saved, table, text_key

#: No SQL: language model, tokens and packing are beyond it; the tests hold the stages against brute force.
ORACLE_SQL = None


def _all(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets one of ours."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))


def _orderly(kind: DataType) -> bool:
    """Whether values of the type can be hashed."""
    if isinstance(kind, StructType):
        return all(_orderly(f.dataType) for f in kind)
    return _orderly(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose perplexity is over their language's threshold.

    A row's verdict follows from its language and text alone, so rejected rows are found again by id, language and a hash of the text, null
    ids included; equal rows share their verdict. Null and short texts stay."""
    from textgauge.llm.kneser_ney import quality

    judged = quality(docs, table(spark, sf_dir, "labels"))
    rejected = judged.filter("not kept").select(F.col("doc_id").alias("r_id"), F.col("lang").alias("r_lang"), F.col("text_key").alias("r_key")).distinct()
    rejected = saved(rejected, "pipeline-rejected")
    rows = docs.select(_all(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), language("lang").alias("lang"), text_key("text").alias("key"))
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("lang") == F.col("r_lang")) & (F.col("key") == F.col("r_key"))
    return rows.join(rejected, same, "left_anti").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that fail the base rules (null and empty texts among them) or are far from their language. Each row is judged for
    itself and carries its columns along."""
    from textgauge.llm.quality_rules import quality_rules as rules

    rows = docs.select(_all(docs).alias("row"), "doc_id", "text", "lang")
    return rules(rows, carry=("row",)).filter("kept").select("c_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of near duplicates (5-word shingles, 0.8).

    Rows without an id of their own (null, or an id that several texts have) get one from a hash of id and text, over all others. Of rows
    with the same id and text the one with the least hash of all columns stays. Texts without a word are groups of their own."""
    from textgauge.llm.neardup import near_duplicates

    own = [f.name for f in docs.schema if _orderly(f.dataType)]
    hashed = F.xxhash64(*(F.col(f"`{c.replace('`', '``')}`") for c in own))
    rows = docs.select(_all(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key("text").alias("key"), "text", hashed.alias("h"))
    shared = rows.filter("id is not null").groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi")
    shared = saved(shared.select(F.col("id").alias("s_id")), "pipeline-shared")
    several = F.lit(False)
    if not shared.isEmpty():
        rows, several = rows.join(shared, F.col("id") == F.col("s_id"), "left"), F.col("s_id").isNotNull()
    far = F.lit(1 << 62) + F.pmod(F.xxhash64("id", "key"), F.lit(1 << 62))
    rows = rows.select("row", "text", "h", F.when(F.col("id").isNull() | several, far).otherwise(F.col("id")).alias("place"))
    kept = near_duplicates(rows.select("place", "text"), k=5, percent=80, id_col="place").filter("kept").select("place").distinct()
    kept = saved(kept, "pipeline-kept")
    return rows.join(kept, "place", "left_semi").groupBy("place").agg(F.min_by("row", "h").alias("row")).select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by their kind, row by row; the number of characters follows. Null texts stay null."""
    from textgauge.llm.secrets import redact_secrets

    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024 ids: one row per piece of a document, with its place. A null or empty text is its end id alone; equal
    rows are packed each for itself, null ids stay null; extra columns end here."""
    import public_tokenizers

    from textgauge.llm.packing import pack

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
