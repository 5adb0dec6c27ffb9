"""Agreement statistics between two scorers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.operators.ordering import running

BANDS = ["Poor", "Below Average", "Average", "Good", "Very Good", "Excellent"]


def average_ranks(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``<column>_rank``, ties sharing their mean rank. Ranks come from the counts of distinct values, added up over ranges of values."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    before = running(counts, [F.col(column)], F.col("n"), "before")
    ranks = before.select(F.col(column).alias("_value"), (F.col("before") + (F.col("n") + 1) / 2).alias(f"{column}_rank"))
    return rows.join(ranks, F.col(column) == F.col("_value")).drop("_value")


def _agreements(a: str, b: str) -> list:
    return [F.count("*").alias("n"), F.corr(a, b).alias("pearson"), F.corr(f"{a}_rank", f"{b}_rank").alias("spearman"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_difference")]


def _label_agreements(a: str, b: str) -> list:
    bands = F.array(*map(F.lit, BANDS))
    place = lambda c: F.array_position(bands, F.col(c)) - 1
    return [F.avg((F.col(a) == F.col(b)).cast("int")).alias("exact"), F.avg((F.abs(place(a) - place(b)) <= 1).cast("int")).alias("within_one")]


def _ranked(rows: DataFrame, a: str, b: str) -> DataFrame:
    return average_ranks(average_ranks(rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), a), b)


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, pearson, spearman, mean absolute difference of two score columns."""
    return _ranked(rows, a, b).agg(*_agreements(a, b))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation r of n pairs, by the t distribution."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else 1.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def strength(r: str = "r"):
    return F.when(F.abs(F.col(r)) >= 0.6, "strong").when(F.abs(F.col(r)) >= 0.3, "moderate").otherwise("weak")


def label_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Shares of equal labels and of labels at most one band apart; unknown labels stand below the first band."""
    return rows.agg(F.count("*").alias("n"), *_label_agreements(a, b))


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of b's labels (columns) by a's; labels that are no band count as ``Other``."""
    named = [F.when(F.col(c).isin(BANDS), F.col(c)).otherwise("Other").alias(c) for c in (a, b)]
    return rows.select(*named).groupBy(a).pivot(b, [*BANDS, "Other"]).count().fillna(0)


def benchmark(pairs: DataFrame) -> DataFrame:
    """(n, pearson, pearson_p, spearman, spearman_p, mean_difference, exact, within_one) of stored score pairs: ours, judged, our_label, judged_label."""
    p = F.udf(p_value, "double")  # over the one row of the result
    whole = _ranked(pairs, "ours", "judged").agg(*_agreements("ours", "judged"), *_label_agreements("our_label", "judged_label"))
    return whole.select("n", "pearson", p("pearson", "n").alias("pearson_p"), "spearman", p("spearman", "n").alias("spearman_p"), "mean_difference", "exact", "within_one")


def tier_means(rows: DataFrame, tier: str, *columns: str) -> DataFrame:
    return rows.groupBy(tier).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in columns))


def drift(now: DataFrame, stored: DataFrame, column: str, key: str = "id", tolerance: float = 1e-9) -> DataFrame:
    """Rows whose stored value differs from the present one by more than ``tolerance``."""
    was = stored.select(key, F.col(column).alias("stored"))
    return now.select(key, F.col(column).alias("now")).join(was, key).filter(F.abs(F.col("now") - F.col("stored")) > tolerance)


def dimension_correlations(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(dimension, r, strength) for each pair of columns; constant columns are left out."""
    values = F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(a).alias("a"), F.col(b).alias("b")) for k, (a, b) in pairs.items()))
    found = rows.select(F.inline(values)).groupBy("dimension").agg(F.corr("a", "b").alias("r"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"))
    return found.filter("na > 1 AND nb > 1").select("dimension", "r", strength().alias("strength"))
