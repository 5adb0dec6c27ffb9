"""Responses of a language-model judge: prompt, extraction of the JSON object, normalisation, result cache.

The judge itself is any callable from a prompt to a response; ``ask`` applies it in batches. Everything
else is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.functions import lexicons as lex
from textgauge.functions.dialect import SPARK, Dialect
from textgauge.operators.evaluate import OVERALL_LABELS, label_expr

# --- fixed values: the metrics that a judge is asked for --------------------------------------------------
JUDGED = {
    "rule_based": ["length", "grammar", "readability", "specificity", "structure", "task_signal", "constraint", "contradiction"],
    "semantic": ["coherence", "semantic_density", "topic_focus", "lexical_sophistication", "sentence_flow", "reference_resolution"],
    "info": ["shannon_entropy", "redundancy", "information_density", "vocabulary_richness", "ngram_repetition", "burstiness", "sentence_repetition"],
    "graph": ["completeness", "has_context", "has_task", "has_constraint", "connectivity", "information_flow", "complexity"],
}

INSTRUCTIONS = (
    "Rate the text below as a prompt. Answer with one JSON object: raw_metrics (an object from each of these names to "
    "{score, findings}: " + ", ".join(f"{p}.{m}" for p, names in JUDGED.items() for m in names) + "), rubric_dimensions (a list of "
    "{name, score, findings} for " + ", ".join(lex.RUBRIC) + "), final_score from 0 to 100, label, suggestions. All other scores are from 0 to 1."
)


def prompts(texts: DataFrame) -> DataFrame:
    """A null text asks about an empty one."""
    return texts.select("id", F.concat(F.lit(INSTRUCTIONS + "\n\nTEXT:\n"), F.coalesce("text", F.lit(""))).alias("prompt"))


def object_sql(d: Dialect, s: str = "response") -> str:
    """The text from the first ``{`` to the last ``}`` of a fenced object, else of the whole response; null without one."""
    fenced = d.group(s, r"(?s)```(?:json)?[ \t\r\n]*(\{.*\})[ \t\r\n]*```", 1)
    inner = f"CASE WHEN {fenced} <> '' THEN {fenced} ELSE {s} END"
    body = d.group(f"({inner})", r"(?s)(\{.*\})", 1)
    return f"CASE WHEN {body} = '' THEN NULL ELSE {body} END"


def _score(d: Dialect, path: str) -> str:
    """A number at a JSON path, clamped to [0, 1]; 0 if it is missing or no number."""
    got = f"get_json_object(body, {d.lit(path)})" if d.name == "spark" else f"json_extract_string(body, {d.lit(path)})"
    return d.clamp(f"coalesce({d.as_double(got)}, {d.number(0)})")


def normalise_stages(d: Dialect) -> list[dict[str, str]]:
    """From ``response`` to dimensions, pillar means, final score and label. Unreadable responses are errors."""
    n = d.number
    valid = "try_parse_json(object) IS NOT NULL" if d.name == "spark" else "json_valid(object)"
    dims = {k: f"dim_{k.lower().replace(' ', '_')}" for k in lex.RUBRIC}

    def by_name(k: str) -> str:
        if d.name == "spark":
            return f"try_cast(get(filter(rubric, r -> r.name = '{k}'), 0).score AS DOUBLE)"
        return f"try_cast(json_extract_string(list_filter(json_extract(body, '$.rubric_dimensions[*]'), lambda r: json_extract_string(r, '$.name') = '{k}')[1], '$.score') AS DOUBLE)"

    first = {"object": object_sql(d)}
    second = {"failed": f"NOT coalesce({valid}, FALSE)"}
    third = {"body": "CASE WHEN failed THEN '{}' ELSE object END"}
    fourth = {"rubric": "from_json(get_json_object(body, '$.rubric_dimensions'), 'array<struct<name:string,score:string>>')" if d.name == "spark" else "0"}
    fourth |= {f"m_{p}_{m}": _score(d, f'$.raw_metrics."{p}.{m}".score' if d.name == "duck" else f"$.raw_metrics['{p}.{m}'].score") for p, names in JUDGED.items() for m in names}
    fifth = {c: d.clamp(f"coalesce({by_name(k)}, {n(0)})") for k, c in dims.items()}
    fifth |= {f"pillar_{p}": f"({' + '.join(f'm_{p}_{m}' for m in names)}) / {n(len(names))}" for p, names in JUDGED.items()}
    given = "try_cast(get_json_object(body, '$.final_score') AS DOUBLE)" if d.name == "spark" else "try_cast(json_extract_string(body, '$.final_score') AS DOUBLE)"
    mean = f"100 * ({' + '.join(dims.values())}) / {n(len(dims))}"
    label = "get_json_object(body, '$.label')" if d.name == "spark" else "json_extract_string(body, '$.label')"
    sixth = {"judged": f"CASE WHEN failed THEN {n(0)} ELSE greatest({n(0)}, least({n(100)}, coalesce({given}, {mean}))) END", "said": label}
    seventh = {"verdict": f"CASE WHEN failed THEN 'Error' ELSE coalesce(said, {label_expr('judged', OVERALL_LABELS, 'Poor')}) END"}
    return [first, second, third, fourth, fifth, sixth, seventh]


def normalise(responses: DataFrame) -> DataFrame:
    """Responses (id, response) with the columns of ``normalise_stages``."""
    out = responses
    for columns in normalise_stages(SPARK):
        out = out.selectExpr("*", *(f"{e} AS {c}" for c, e in columns.items()))
    return out


def cache_key(provider: str, model: str):
    return F.sha2(F.concat_ws("|", F.lit(provider), F.lit(model), F.col("text")), 256)


def misses(texts: DataFrame, cache: DataFrame, provider: str, model: str) -> DataFrame:
    """Texts whose key the cache (key, response) doesn't have."""
    return texts.withColumn("key", cache_key(provider, model)).join(cache.select("key"), "key", "left_anti")


def cached(texts: DataFrame, cache: DataFrame, provider: str, model: str) -> DataFrame:
    return texts.withColumn("key", cache_key(provider, model)).join(cache, "key")


def write_cache(answered: DataFrame, path: str, provider: str, model: str) -> None:
    """Adds answers (text, response) to the cache under ``path``; missing and unreadable responses aren't kept, so they are asked again."""
    readable = F.expr(f"try_parse_json({object_sql(SPARK)}) IS NOT NULL")
    rows = answered.filter(F.col("response").isNotNull()).filter(F.coalesce(readable, F.lit(False)))
    rows.select(cache_key(provider, model).alias("key"), "response").dropDuplicates(["key"]).write.mode("append").parquet(path)


class QuotaError(RuntimeError):
    """The provider's quota is used up: another key may go on."""


class AccessError(RuntimeError):
    """The key isn't accepted."""


def classified(error: Exception) -> Exception:
    text = str(error).lower()
    if "429" in text or "resource_exhausted" in text or "quota" in text:
        return QuotaError(str(error))
    if "401" in text or "403" in text or "invalid" in text and "key" in text:
        return AccessError(str(error))
    return error


def ask(questions: DataFrame, judge: Callable[[str, str], str], keys: tuple[str, ...] = ("",), tries: int = 3, wait: float = 2.0, quota_wait: float = 0.5) -> DataFrame:
    """(id, response, error) of ``judge(prompt, key)``, in Arrow batches.

    After a quota error the next key goes on (shortly after), after an access error too, and that key isn't used again by the task; when no key
    is left the question fails. Other errors are tried ``tries`` times, ``wait`` seconds apart. A question without an answer has a null response and
    the last error's text."""

    def run(batches):
        import time

        left_keys = list(keys)
        for batch in batches:
            answers, errors = [], []
            for prompt in batch["prompt"]:
                response = error = None
                left, turns = tries, len(left_keys)
                while left and left_keys:
                    try:
                        response, error = judge(prompt, left_keys[0]), None
                        break
                    except Exception as e:  # noqa: BLE001  a provider's own error types
                        kind, error = classified(e), str(e)
                        if isinstance(kind, AccessError):
                            left_keys.pop(0)
                        elif isinstance(kind, QuotaError) and turns > 1:
                            left_keys.append(left_keys.pop(0))
                            turns -= 1
                            time.sleep(quota_wait)
                        else:
                            left -= 1
                            time.sleep(wait if left else 0)
                answers.append(response)
                errors.append(error if response is None and error else None if response is not None else "no key left")
            yield batch.assign(response=answers, error=errors)[["id", "response", "error"]]

    return questions.mapInPandas(run, "id long, response string, error string")
