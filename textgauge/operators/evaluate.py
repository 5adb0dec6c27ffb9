"""Scoring a column of texts: metrics, rubric, domain, final score. All of it needs a text's own row alone, so no text is
shuffled: one narrow stage of built-in expressions with one Arrow step for what compares sentences."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.functions import lexicons as lex
from textgauge.functions.dialect import DUCK, SPARK, Dialect
from textgauge.operators import sentences
from textgauge.operators.metrics import PROVIDERS, stages


def needed(steps: list[dict[str, str]], wanted: list[str] | None) -> list[dict[str, str]]:
    """The steps without columns that no wanted column builds on."""
    if wanted is None:
        return steps
    names, out = set(wanted), []
    for columns in reversed(steps):
        own = {c: e for c, e in columns.items() if c in names}
        for e in own.values():
            names.update(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", e))
        out.append(own)
    return [columns for columns in reversed(out) if columns]


def staged_sql(d: Dialect, source: str, wanted: list[str] | None = None) -> str:
    """The metrics over ``source`` (id, text and provider columns) as nested SELECTs."""
    sql = f"SELECT * FROM {source}"
    for columns in needed(stages(d), wanted):
        sql = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM ({sql})"
    return sql


def with_providers(texts: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """Texts with all provider columns; those that no provider gives are null."""
    if providers is not None:
        texts = texts.join(providers, "id", "left")
    return texts.select("*", *(F.lit(None).cast(t).alias(c) for c, t in PROVIDERS.items() if c not in texts.columns))


def step(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds columns that later ones refer to several times. A generator over one struct keeps the optimizer from
    putting each expression into all that refer to it, which would evaluate it again each time; it moves no rows."""
    if any(e.startswith("@") for e in columns.values()):
        return rows.withColumns({c: sentences.column(e) for c, e in columns.items()})
    if all(re.fullmatch(r"\w+\.\w+", e) for e in columns.values()):
        return rows.selectExpr("*", *(f"{e} AS {c}" for c, e in columns.items()))
    return rows.select("*", F.inline(F.array(F.struct(*(F.expr(e).alias(c) for c, e in columns.items())))))


def with_metrics(texts: DataFrame, providers: DataFrame | None = None, wanted: list[str] | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """Texts (id, text) with every (or each wanted) metric. One narrow stage. ``extra`` adds metrics of the caller's: expressions
    over the text, the columns of ``stages`` and the metrics themselves."""
    steps = stages(SPARK) + ([extra] if extra else [])
    out = with_providers(texts, providers)
    for columns in needed(steps, wanted if wanted is None else [*wanted, *(extra or {})]):
        out = step(out, columns)
    return out


def node_histogram(rows: DataFrame) -> DataFrame:
    """Adds ``nodes``: how many sentences of each kind a text has, from ``kinds``."""
    names = F.array(*map(F.lit, ("CONTEXT", "TASK", "CONSTRAINT", "EXAMPLE", "OTHER")))
    return rows.withColumn("nodes", F.map_from_arrays(names, F.transform(names, lambda k: F.size(F.filter("kinds", lambda x: x == k)))))


def with_all_metrics(texts: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """Texts with all metrics. Texts without term vectors have the fixed scores of that case."""
    return with_metrics(spread(texts), providers)


def spread(texts: DataFrame) -> DataFrame:
    """Texts dealt out without a key, over twice the cores at least. How many partitions they have says little: a file of one row
    group is one task's work however many splits it has, and a small table beside it brings partitions of its own."""
    return texts.repartition(max(2 * texts.sparkSession.sparkContext.defaultParallelism, texts.rdd.getNumPartitions()))


def domain_exprs(d: Dialect) -> dict[str, str]:
    """Keyword counts, detected domain and confidence."""
    from textgauge.operators.metrics import present

    counts = {
        k: d.sum_of([f"contains(low, {d.lit(w)})" if k in lex.SUBSTRING_DOMAINS else present(d, w) for w in words])
        for k, words in lex.DOMAIN_WORDS.items()
    }
    return {f"d_{k}": e for k, e in counts.items()}


def domain_choice(d: Dialect) -> dict[str, str]:
    names = list(lex.DOMAIN_WORDS)
    best = f"greatest({', '.join(f'd_{k}' for k in names)})"
    pick = " ".join(f"WHEN d_{k} = {best} THEN '{k}'" for k in names)
    return {
        "domain": f"CASE WHEN {best} < 2 THEN 'general' {pick} END",
        "domain_confidence": f"CASE WHEN {best} < 2 THEN {d.number(0)} ELSE {best} / CAST({' + '.join(f'd_{k}' for k in names)} + 1 AS DOUBLE) END",
    }


def rubric_exprs(d: Dialect) -> dict[str, str]:
    """The eight dimensions from the metrics."""
    return {f"dim_{k.lower().replace(' ', '_')}": "(" + " + ".join(f"{d.number(w)} * {m}" for m, w in parts.items()) + f") / {d.number(sum(parts.values()))}" for k, parts in lex.RUBRIC.items()}


def pillar_exprs(d: Dialect) -> dict[str, str]:
    from textgauge.operators.metrics import PILLARS

    return {f"pillar_{k}": f"({' + '.join(names)}) / {d.number(len(names))}" for k, names in PILLARS.items()}


def label_expr(x: str, bands: list[tuple[float, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {b} THEN '{name}'" for b, name in bands) + f" ELSE '{other}' END"


DIMENSION_LABELS = [(0.85, "Excellent"), (0.70, "Strong"), (0.50, "Good"), (0.30, "Fair")]
OVERALL_LABELS = [(85, "Excellent"), (75, "Very Good"), (60, "Good"), (45, "Average"), (25, "Below Average")]
LENGTH_FACTOR = "CASE WHEN wc >= 30 THEN 1.0 WHEN wc <= 3 THEN 0.4 WHEN wc <= 10 THEN 0.6 + 0.04 * (wc - 3) ELSE 0.85 + 0.0075 * (wc - 10) END"
TASK_CAP = "CASE WHEN wc <= 5 THEN 12 WHEN wc <= 10 THEN 22 WHEN wc <= 20 THEN 32 ELSE 40 END"


def score_stages(d: Dialect, weights: dict[str, float] | None = None) -> list[dict[str, str]]:
    """From metrics to the final score. ``weights`` by dimension replace those of the detected domain."""
    n = d.number
    dims = {k: f"dim_{k.lower().replace(' ', '_')}" for k in lex.RUBRIC}

    def weight(k: str) -> str:
        if weights:
            return n(weights.get(k, 1.0))
        cases = " ".join(f"WHEN domain = '{name}' THEN {n(own[k])}" for name, own in lex.DOMAIN_WEIGHTS.items() if k in own)
        return f"CASE {cases} ELSE {n(1)} END" if cases else n(1)

    rounded = {k: f"round({c}, 3)" for k, c in dims.items()}
    mean = f"({' + '.join(f'{rounded[k]} * ({weight(k)})' for k in dims)}) / ({' + '.join(f'({weight(k)})' for k in dims)})"
    pillars = ["pillar_rule_based", "pillar_semantic_structural", "pillar_info_theoretic", "pillar_graph_analysis"]
    least = f"least({', '.join(pillars)})"
    average = f"(({' + '.join(pillars)}) / 4)"
    return [
        domain_exprs(d) | rubric_exprs(d) | pillar_exprs(d) | {"length_factor": f"CAST({LENGTH_FACTOR} AS DOUBLE)", "task_cap": f"CAST({TASK_CAP} AS DOUBLE)"},
        domain_choice(d),
        {"weighted": f"({mean}) * length_factor", "excellence_bonus": f"CASE WHEN {least} >= {n(.6)} THEN ({average} - {n(.6)}) * {n(.25)} ELSE {n(0)} END"},
        {"uncapped": f"round(100 * least({n(1)}, weighted + excellence_bonus), 1)"},
        {"penalised": f"task_signal < {n(.2)} AND has_task < {n(.5)} AND uncapped > task_cap"},
        {"final_score": "CASE WHEN penalised THEN task_cap ELSE uncapped END"},
        {"label": label_expr("final_score", OVERALL_LABELS, "Poor")},
    ]


def evaluate(texts: DataFrame, providers: DataFrame | None = None, weights: dict[str, float] | None = None, domain: str | None = None) -> DataFrame:
    """Texts (id, text) with metrics, dimensions, pillar means, domain and final score. ``domain`` overrides the
    detected one, with confidence 1."""
    out = with_all_metrics(texts, providers)
    return score(out, weights, domain)


def score(metrics: DataFrame, weights: dict[str, float] | None = None, domain: str | None = None) -> DataFrame:
    out = metrics
    for i, columns in enumerate(score_stages(SPARK, weights)):
        if i == 1 and domain:
            columns = {"domain": f"'{domain}'", "domain_confidence": "1D"}
        out = step(out, columns) if i == 0 else out.selectExpr("*", *(f"{e} AS {c}" for c, e in columns.items()))
    return out
