"""Word vectors: how close a text is to good examples of its domain.

A text's vector is the sum of its words' vectors, added up by a vector aggregate in the JVM with a partial sum in each
task. ``vectors`` is a table (word, vector array<double>) of the caller's; a text without known words, or with a zero sum, has no similarity (null).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgauge.operators.words import words


def text_vectors(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, vector) of texts (id, text) that have known words."""
    known = vectors.select(F.lower("word").alias("word"), array_to_vector("vector").alias("v")).dropDuplicates(["word"])
    rows = words(texts).join(known, "word")
    return rows.groupBy("id").agg(vector_to_array(Summarizer.sum(F.col("v"), F.col("n").cast("double"))).alias("vector"))


def cosine(a: str, b: str) -> Column:
    """The cosine of two array columns; null if one is zero."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, y: s + y)

    norm = lambda c: F.sqrt(total(F.transform(F.col(c), lambda y: y * y)))
    return F.try_divide(total(F.zip_with(a, b, lambda x, y: x * y)), norm(a) * norm(b))


def reference_similarity(texts: DataFrame, vectors: DataFrame, examples: DataFrame) -> DataFrame:
    """(id, p_reference_similarity) of texts (id, text, domain): the largest cosine with an example (domain, text) of the domain, or
    with the ``general`` ones where the domain has none."""
    numbered = examples.select("domain", F.col("text"), F.xxhash64("domain", "text").alias("id")).dropDuplicates(["id"])
    good = numbered.select("id", "domain").join(text_vectors(numbered.select("id", "text"), vectors), "id").select("domain", F.col("vector").alias("example"))
    domains = numbered.select(F.col("domain").alias("of")).distinct()
    own = texts.select("id", F.col("domain").alias("of")).join(F.broadcast(domains.withColumn("has", F.lit(True))), "of", "left")  # a row for each domain
    own = own.select("id", F.when(F.col("has"), F.col("of")).otherwise("general").alias("domain"))
    with_vector = own.join(text_vectors(texts.select("id", "text"), vectors), "id")
    near = with_vector.join(good, "domain").groupBy("id").agg(F.max(cosine("vector", "example")).alias("s"))
    return texts.select("id").join(near, "id", "left").select("id", F.col("s").alias("p_reference_similarity"))
