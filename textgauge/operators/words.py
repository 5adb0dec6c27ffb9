"""Word-level resources as joins: frequencies, known words, misspellings and their corrections, share of English.

The resources are tables of the caller's: ``frequencies`` (word, zipf), the Zipf frequency (log10 of occurrences in a
thousand million words) of lower-case words, and ``terms`` (word), technical words that count as known. Texts
contribute their distinct words with counts, added up before they are dealt out by word, so a word that
all texts have costs a row for each text and no more; the resources join by word (broadcast by the planner if small).

Words are runs of letters. A null text has none. Repeated rows of a resource count once, with the largest zipf.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.functions import lexicons as lex

KNOWN = 1.0
#: How many of the most frequent words count as common.
COMMON = 5000
#: Zipf from which a technical word is too common to be specific.
EVERYDAY = 6.0
#: Rarity of a word by its zipf, from the first border that it reaches.
RARITY = [(6.5, 0.10), (5.0, 0.30), (3.5, 0.55), (2.0, 0.75), (1.0, 0.85)]
TERM_RARITY = 0.80


def words(texts: DataFrame) -> DataFrame:
    """(id, word, n): the distinct words of each text (id, text) in lower case and how often it has them."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}_])\p{L}+(?![\p{L}\p{N}_])"), F.lit(0))
    return texts.select("id", F.explode(found).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))


def resource(frequencies: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, zipf, is_term, is_common, known): every word of either table."""
    zipf = frequencies.groupBy(F.lower("word").alias("word")).agg(F.max("zipf").alias("zipf"))
    named = terms.select(F.lower("word").alias("word"), F.lit(True).alias("is_term")).distinct()
    top = zipf.orderBy(F.col("zipf").desc(), "word").limit(COMMON).select("word", F.lit(True).alias("is_top"))  # the feature: the most common
    both = zipf.join(named, "word", "full").join(top, "word", "left")
    is_term = F.coalesce("is_term", F.lit(False))
    return both.select("word", F.coalesce("zipf", F.lit(0.0)).alias("zipf"), is_term.alias("is_term"), (F.coalesce("is_top", F.lit(False)) | is_term).alias("is_common"), (is_term | (F.coalesce("zipf", F.lit(0.0)) >= KNOWN)).alias("known"))


def judged(found: DataFrame, resources: DataFrame) -> DataFrame:
    """Words (with a column ``word``) with zipf, is_term, is_common, known, typo and stop. Words of one letter are known; typos have three."""
    rows = found.join(resources, "word", "left")
    known = F.coalesce("known", F.lit(False)) | (F.length("word") < 2)
    rows = rows.withColumns({"zipf": F.coalesce("zipf", F.lit(0.0)), "is_term": F.coalesce("is_term", F.lit(False)), "is_common": F.coalesce("is_common", F.lit(False)), "known": known})
    return rows.withColumns({"typo": ~F.col("known") & (F.length("word") >= 3), "stop": F.col("word").isin(lex.STOP_WORDS)})


def deletions(rows: DataFrame, most: int) -> DataFrame:
    """Rows (word, ...) with each ``part``: the word without up to ``most`` of its letters."""
    parts = F.array("word")
    for _ in range(most):
        parts = F.array_distinct(F.concat(parts, F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.length(p), F.lit(1))), lambda i: F.concat(F.substr(p, F.lit(1), i - 1), F.substr(p, i + 1)))))))
    return rows.withColumn("part", F.explode(parts))


def corrections(unknown: DataFrame, resources: DataFrame, most: int = 2) -> DataFrame:
    """(word, correction) for each distinct unknown word: of the known words in the fewest edits (at most ``most``) the most frequent, ties
    to the first in order; null without one.

    Two words that few edits apart share a part after as many deletions; so candidates meet by an equality join on
    parts, never by pairs of all words, and are then measured."""
    asked = unknown.select("word").distinct()
    left = deletions(asked, most).select("part", "word").distinct()
    right = deletions(resources.filter("known").select("word", "zipf"), most).select("part", F.col("word").alias("other"), "zipf").distinct()
    near = left.join(right, "part").select("word", "other", "zipf").distinct().withColumn("edits", F.levenshtein("word", "other"))
    best = near.filter(F.col("edits") <= most).groupBy("word").agg(F.min(F.struct("edits", (-F.col("zipf")).alias("z"), "other")).alias("best"))
    return asked.join(best, "word", "left").select("word", F.col("best.other").alias("correction"))


def typos(texts: DataFrame, frequencies: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, word, correction): every text's misspelt words, once each."""
    resources = resource(frequencies, terms)
    found = judged(words(texts), resources).filter("typo").select("id", "word")
    return found.join(corrections(found, resources), "word", "left").select("id", "word", "correction")


def providers(texts: DataFrame, frequencies: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, p_typos, p_english_ratio, p_tech_terms, p_rarity): the word-level provider columns of ``with_metrics``, a row for each text.

    Typos count once a text, other words as often as they occur. Without words the share of English is 1. Rarity is the mean over words
    of more than two letters that are no function words; without such words there is none (null)."""
    rows = judged(words(texts), resource(frequencies, terms))
    long, content = F.length("word") > 1, (F.length("word") > 2) & ~F.col("stop")
    specific = content & ~F.col("is_common") & ~F.col("typo") & F.col("known") & (F.col("zipf") <= EVERYDAY)
    rarity = F.when(F.col("typo"), None)
    for border, value in RARITY:
        rarity = rarity.when(F.col("zipf") >= border, value)
    rarity = rarity.when(F.col("is_term"), TERM_RARITY)
    n = F.col("n")
    counted = rows.withColumn("r", F.when(content, rarity)).groupBy("id").agg(
        F.count_if("typo").alias("p_typos"),
        (F.sum(F.when(long & (F.col("stop") | F.col("known")), n).otherwise(0)) / F.nullif(F.sum(F.when(long, n)), F.lit(0))).alias("ratio"),
        F.sum(F.when(specific, n).otherwise(0)).alias("p_tech_terms"),
        (F.sum(F.col("r") * n) / F.sum(F.when(F.col("r").isNotNull(), n))).alias("p_rarity"),
        F.sum(F.when(content & F.col("typo"), n).otherwise(0)).alias("wrong"),
    )
    named = texts.select("id").join(counted, "id", "left")
    rarity = F.coalesce("p_rarity", F.when(F.col("wrong") > 0, -1 / 7))  # nothing but typos: 0.3 + 0.7 r is 0.2
    return named.select("id", F.coalesce("p_typos", F.lit(0)).alias("p_typos"), F.coalesce("ratio", F.lit(1.0)).alias("p_english_ratio"), F.coalesce("p_tech_terms", F.lit(0)).alias("p_tech_terms"), rarity.alias("p_rarity"))
