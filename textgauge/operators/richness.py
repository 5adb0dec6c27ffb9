"""Measures of lexical diversity that follow a text's words in order: MTLD, HD-D and MATTR, in Arrow batches."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
LEAST = 5


def _factors(words: list[str], threshold: float) -> float:
    """How many stretches there are in which the share of distinct words falls to the threshold; the last counts by how far it got."""
    found, kinds, n, share = 0.0, set(), 0, 1.0
    for w in words:
        kinds.add(w)
        n += 1
        share = len(kinds) / n
        if share <= threshold:
            found, kinds, n, share = found + 1, set(), 0, 1.0
    return found + (1 - share) / (1 - threshold) if n else found


def mtld(words: list[str], threshold: float = 0.72) -> float:
    """Mean length of such stretches, forwards and backwards averaged."""
    lengths = [len(words) / f if (f := _factors(own, threshold)) else float(len(words)) for own in (words, words[::-1])]
    return sum(lengths) / 2


def hdd(words: list[str], draws: int = 42) -> float:
    """The expected share of distinct words in ``draws`` words drawn without replacement."""
    n = len(words)
    log_all = math.lgamma(n + 1) - math.lgamma(n - draws + 1)
    total = 0.0
    for c in Counter(words).values():
        none = math.exp(math.lgamma(n - c + 1) - math.lgamma(n - c - draws + 1) - log_all) if n - c >= draws else 0.0
        total += (1 - none) / draws
    return total


def mattr(words: list[str], window: int = 10) -> float:
    """The mean share of distinct words over all windows."""
    inside = Counter(words[:window])
    total = len(inside)
    for out, new in zip(words, words[window:]):
        inside[new] += 1
        inside[out] -= 1
        if not inside[out]:
            del inside[out]
        total += len(inside)
    return total / window / (len(words) - window + 1)


def diversity(text: str | None) -> float | None:
    """The mean of the three, each held in [0, 1]; none for fewer than ``LEAST`` words."""
    words = _WORD.findall((text or "").lower())
    if len(words) < LEAST:
        return None
    parts = mtld(words) / 100, hdd(words, min(42, len(words) - 1)), mattr(words, min(10, len(words)))
    return sum(min(1.0, max(0.0, x)) for x in parts) / 3


def _diversities(texts: pd.Series) -> pd.Series:
    return pd.Series([diversity(t) for t in texts], dtype="float64")


def richness(texts: DataFrame) -> DataFrame:
    """Texts with the provider column ``p_diversity``."""
    return texts.withColumn("p_diversity", F.pandas_udf(_diversities, "double")("text"))
