"""Suggestions, rewrite template, comparison, ablation, resampled confidence, batch ranking."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgauge.functions import lexicons as lex
from textgauge.functions.dialect import SPARK, Dialect
from textgauge.operators.evaluate import DIMENSION_LABELS, evaluate, label_expr, score, with_all_metrics
from textgauge.operators.metrics import METRICS, PILLARS, RULES
from textgauge.operators.ordering import kept, running

#: Advice by metric: what to do about a low score (under 0.4), and, for some, about a high one (over 0.85). Only
#: rule-based metrics are looked up: that is what the observed behaviour amounts to (``all_pillars`` for the rest).
LOW = {
    "length": "Say more: a few sentences on the goal, the input and the result help.",
    "grammar": "Check spelling and grammar.",
    "readability": "Use shorter sentences and plainer words.",
    "specificity": "Name concrete things: numbers, names, formats, examples.",
    "structure": "Give the text a layout: labelled sections, lists or headings.",
    "task_signal": "Begin with what is to be done, with a verb and the result you want.",
    "constraints": "State limits: format, length, tone, readers, what to leave out.",
    "contradiction": "Some requirements exclude each other: keep one of each pair.",
    "persona_signal": "Say which role the answer should be written in.",
    "few_shot_quality": "Add an example of input and expected output.",
    "hedging": "Drop tentative phrases and ask directly.",
    "safety": "Remove phrases that try to override instructions.",
    "output_schema": "Describe the output's fields or form.",
    "compound_task_count": "Ask for one clear action.",
    "imperative_strength": "Put the request in the imperative.",
    "coherence": "Let neighbouring sentences share their subject.",
    "topic_focus": "Keep to one topic.",
    "redundancy": "Cut repeated words.",
    "ngram_repetition": "Cut repeated phrases.",
    "sentence_repetition": "Cut repeated sentences.",
    "has_context": "Describe the situation.",
    "has_task": "State the task in a sentence of its own.",
    "has_constraint": "State a constraint in a sentence of its own.",
}
HIGH = {"length": "The text may be too long: cut what the task doesn't need.", "compound_task_count": "There are several tasks: consider one text for each."}


def long_metrics(scored: DataFrame) -> DataFrame:
    """(id, ord, metric, score): one row a metric, in registry order."""
    items = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(m).alias("metric"), F.col(m).alias("score")) for i, m in enumerate(METRICS)))
    return scored.select("id", F.inline(items))


def suggestions_sql(d: Dialect, all_pillars: bool = False, most: int = 5) -> str:
    """An array of the first ``most`` pieces of advice, lowest scores first, ties in registry order. Within a
    row: the few metrics that advice exists for are sorted as an array, so there is no window or shuffle."""
    names = [m for m in (METRICS if all_pillars else RULES) if m in LOW]
    entries = []
    for m in names:
        text = f"CASE WHEN {m} < 0.4 THEN {d.lit(LOW[m])}" + (f" WHEN {m} > 0.85 THEN {d.lit(HIGH[m])}" if m in HIGH else "") + " END"
        rank = METRICS.index(m)
        entries.append(f"named_struct('s', {m}, 'o', {rank}, 'a', {text})" if d.name == "spark" else f"{{'s': {m}, 'o': {rank}, 'a': {text}}}")
    fired = d.ordered(d.filter(d.array(entries), "x", "x.a IS NOT NULL"))
    return d.transform(d.part(fired, "0", str(most)), "x", "x.a")


def with_advice(scored: DataFrame, all_pillars: bool = False) -> DataFrame:
    """Adds ``suggestions``: notices on length and on a missing task first, then advice, or the three weakest
    dimensions where no advice fired."""
    dims = {k: f"dim_{k.lower().replace(' ', '_')}" for k in lex.RUBRIC}
    weakest = F.transform(F.slice(F.array_sort(F.array(*(F.struct(F.col(c).alias("s"), F.lit(i).alias("o"), F.lit(k).alias("k")) for i, (k, c) in enumerate(dims.items())))), 1, 3), lambda x: F.concat(F.lit("Improve "), x["k"]))
    own = F.expr(suggestions_sql(SPARK, all_pillars))
    notice = F.when(F.col("penalised"), F.array(F.lit("No task was found, so the score is capped."))).otherwise(F.array().cast("array<string>"))
    short = F.when(F.col("length_factor") < 1, F.array(F.lit("The text is short, which lowers the score."))).otherwise(F.array().cast("array<string>"))
    return scored.withColumn("advice", own).withColumn("suggestions", F.concat(short, notice, F.when(F.size("advice") > 0, F.col("advice")).otherwise(weakest))).drop("advice")


#: Personas by domain.
PERSONAS = {
    "coding": "You are an engineer who has built and run software like this for years.",
    "creative": "You are a writer with a voice of your own.",
    "analysis": "You are an analyst who reads data with care.",
    "instructional": "You are a teacher who makes hard things plain.",
    "general": "You know this field well.",
}


def rewrite(scored: DataFrame) -> DataFrame:
    """(id, rewritten): a template with the sections that the text's scores call for. Context, task and constraints always
    appear as placeholders, and so the text itself never does (observed behaviour: the scores that would show them are never found)."""

    def section(name: str, hint, when=None):
        text = F.concat(F.lit(f"{name}: "), hint if not isinstance(hint, str) else F.lit(hint))
        return text if when is None else F.when(when, text)

    persona = F.lit(PERSONAS["general"])
    for domain, text in PERSONAS.items():
        persona = F.when(F.col("domain") == domain, text).otherwise(persona)
    parts = [
        section("Persona", persona, F.col("persona_signal") < 0.6),
        section("Context", "<what the situation is and what exists already>"),
        section("Task", "<what is to be done, as an instruction>"),
        section("Constraints", "<format, length, readers, what to leave out>"),
        section("Schema", "<the output's fields and their types>", (F.col("domain") == "coding") & (F.col("output_schema") < 0.6)),
        section("Examples", "<an input with its output>", F.col("few_shot_quality") < 0.6),
    ]
    return scored.select("id", F.concat_ws("\n\n", *parts).alias("rewritten"))


def dimensions(scored: DataFrame) -> DataFrame:
    """(id, ord, dimension, score, label) in long form, scores to 3 places."""
    items = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("dimension"), F.col(f"dim_{k.lower().replace(' ', '_')}").alias("raw")) for i, k in enumerate(lex.RUBRIC)))
    rows = scored.select("id", F.inline(items))
    return rows.selectExpr("id", "ord", "dimension", "round(raw, 3) AS score", f"{label_expr('raw', DIMENSION_LABELS, 'Weak')} AS label")


def compare(left: DataFrame, right: DataFrame, on: str = "pair") -> DataFrame:
    """One row per pair of evaluated texts: difference, verdict (a tie under one point) and each dimension's sign
    (about equal under 0.05). A missing side counts as 0."""
    names = {k: f"dim_{k.lower().replace(' ', '_')}" for k in lex.RUBRIC}
    a = left.select(on, F.col("final_score").alias("a"), *(F.col(c).alias(f"a_{c}") for c in names.values()))
    b = right.select(on, F.col("final_score").alias("b"), *(F.col(c).alias(f"b_{c}") for c in names.values()))
    both = a.join(b, on, "left").fillna(0.0)
    diff = F.col("a") - F.col("b")
    out = [F.when(F.abs(diff) < 1, "tie").when(diff > 0, "A").otherwise("B").alias("verdict")]
    for k, c in names.items():
        gap = F.col(f"a_{c}") - F.col(f"b_{c}")
        out.append(F.when(F.abs(gap) < 0.05, "=").when(gap > 0, "A").otherwise("B").alias(c.removeprefix("dim_")))
    return both.select(on, "a", "b", F.round(diff, 1).alias("difference"), *out)


def ablate_dimensions(scored: DataFrame) -> DataFrame:
    """(id, dimension, contribution, low_rank, high_rank): what each dimension adds to an unweighted score."""
    rows = dimensions(scored).withColumn("contribution", F.round(F.col("score") / 8 * 100, 1))
    up, down = (Window.partitionBy("id").orderBy(F.col("contribution") if asc else F.col("contribution").desc(), "ord") for asc in (True, False))
    return rows.select("id", "dimension", "contribution", F.row_number().over(up).alias("low_rank"), F.row_number().over(down).alias("high_rank"))


def ablate_pillars(metrics: DataFrame) -> DataFrame:
    """(id, pillar, final_score): the score with all metrics of one pillar set to 0.5, and (null) as it is."""
    variants = F.array(*(F.lit(p) for p in (None, *PILLARS)))
    rows = metrics.withColumn("pillar", F.explode(variants))
    for p, names in PILLARS.items():
        for m in names:
            rows = rows.withColumn(m, F.when(F.col("pillar").eqNullSafe(p), 0.5).otherwise(F.col(m)))
    return score(rows).select("id", "pillar", "final_score")


def resample(n: int, draws: random.Random) -> list[int]:
    """The places that n draws with replacement from n hit, in order."""
    return sorted({draws.randrange(n) for _ in range(n)})


def _resampled(repetitions: int, seed: int):
    def run(sentences: pd.Series) -> pd.Series:
        out = []
        for own in sentences:
            draws, texts = random.Random(seed), []
            for _ in range(repetitions if len(own) >= 3 else 0):
                picks = resample(len(own), draws)
                if len(picks) >= 2:
                    texts.append(" ".join(own[i] for i in picks))
            out.append(texts)
        return pd.Series(out)

    return run


def bootstrap(texts: DataFrame, repetitions: int = 30, seed: int = 42) -> DataFrame:
    """(id, low, high, score_std, samples): scores of texts rebuilt from resampled sentences, rescored as ordinary rows. Every text's draws
    start from the seed. Texts of fewer than 3 sentences have no samples; with fewer than 5 samples the bounds are the score itself, without
    spread. Bounds have one decimal, the spread two."""
    scored = kept(evaluate(texts).select("id", "final_score", "sents"))
    drawn = F.pandas_udf(_resampled(repetitions, seed), "array<string>")("sents")
    rebuilt = scored.select("id", F.posexplode(drawn).alias("rep", "text")).select(F.struct("id", "rep").alias("id"), "text")
    again = evaluate(rebuilt).select("id.id", F.col("final_score").alias("s"))
    spread = again.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("s"), F.stddev_pop("s").alias("std"), F.count("*").alias("m"))
    enough = F.col("m") >= 5
    low, high = F.floor(F.col("m") * 0.025).cast("int"), F.least(F.floor(F.col("m") * 0.975), F.col("m") - 1).cast("int")
    picks = spread.select("id", "m", F.when(enough, F.get("s", low)).alias("lo"), F.when(enough, F.get("s", high)).alias("hi"), F.when(enough, F.round("std", 2)).alias("std"))
    out = scored.join(picks, "id", "left")
    return out.select("id", F.round(F.coalesce("lo", "final_score"), 1).alias("low"), F.round(F.coalesce("hi", "final_score"), 1).alias("high"), F.coalesce("std", F.lit(0.0)).alias("score_std"), F.coalesce("m", F.lit(0)).cast("int").alias("samples"))


def rank_batch(scored: DataFrame) -> DataFrame:
    """The batch report (rank, id, preview, score, verdict, domain), best first, ties by id. Rows are dealt out by ranges of
    score and id, so the many texts of a capped score needn't share a task."""
    preview = F.when(F.length("t") > 80, F.concat(F.substring("t", 1, 80), F.lit("..."))).otherwise(F.col("t"))
    rows = scored.select("id", preview.alias("preview"), F.col("final_score").alias("score"), F.col("label").alias("verdict"), "domain")
    ranked = running(kept(rows), [F.col("score").desc(), F.col("id")], F.lit(1), "before")
    return ranked.select((F.col("before") + 1).alias("rank"), "id", "preview", "score", "verdict", "domain")
