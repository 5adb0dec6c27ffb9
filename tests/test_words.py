"""Word-level providers, vectors, diversity, SQL functions and added metrics."""

import math
import random
from itertools import combinations

import pytest

from textgauge.functions import sql
from textgauge.operators import evaluate as ev
from textgauge.operators import richness, vectors, words

FREQUENCIES = [("the", 7.7), ("write", 5.2), ("report", 5.1), ("reports", 4.5), ("house", 5.6), ("horse", 4.9), ("zyzzyva", 1.2), ("rare", 0.4), ("Quantum", 4.1), ("quantum", 4.2), ("of", 7.4), ("and", 7.4)]
TERMS = [("webhook",), ("API",)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(FREQUENCIES, "word string, zipf double"), spark.createDataFrame(TERMS, "word string")


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


def test_typos_and_corrections(spark, tables):
    got = [tuple(r) for r in words.typos(texts(spark, "The hause and the hause, a repotr; x9y webhook rare qq", None, "", "hoose xxxxxxx"), *tables).orderBy("id", "word").collect()]
    # "rare" is below the border of known words, "qq" too short, "x9y" no word of letters; "hoose" is one edit from house and horse: the more frequent
    assert got == [(0, "hause", "house"), (0, "rare", None), (0, "repotr", "report"), (3, "hoose", "house"), (3, "xxxxxxx", None)]


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_corrections_equal_all_pairs(spark):
    rng = random.Random(3)
    known = [("".join(rng.choice("abcd") for _ in range(rng.randint(2, 6))), round(rng.uniform(1, 7), 1)) for _ in range(60)]
    asked = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 7))) for _ in range(40)} - {w for w, _ in known})
    resources = words.resource(spark.createDataFrame(known, "word string, zipf double"), spark.createDataFrame([], "word string"))
    got = {r["word"]: r["correction"] for r in words.corrections(spark.createDataFrame([(w,) for w in asked], "word string"), resources).collect()}
    best = {}
    for w, z in known:
        best[w] = max(z, best.get(w, 0))
    for w in asked:
        near = sorted((plain_levenshtein(w, k), -z, k) for k, z in best.items() if plain_levenshtein(w, k) <= 2)
        assert got[w] == (near[0][2] if near else None), w


def test_providers(spark, tables):
    df = texts(spark, "The API and the webhook write quantum reports", "blorp blorp snarf", None, "... 123", "zyzzyva house")
    got = {r["id"]: r for r in words.providers(df, *tables).collect()}
    assert (got[0]["p_typos"], got[0]["p_english_ratio"]) == (0, 1.0)
    # quantum and reports are among the most common words of so small a table, so nothing is specific
    assert got[0]["p_tech_terms"] == 0
    assert got[0]["p_rarity"] == pytest.approx((0.8 + 0.8 + 0.3 + 0.55 + 0.55) / 5)
    assert (got[1]["p_typos"], got[1]["p_english_ratio"], got[1]["p_rarity"]) == (2, 0.0, pytest.approx(-1 / 7))
    assert got[2]["p_english_ratio"] == got[3]["p_english_ratio"] == 1.0 and got[2]["p_rarity"] is None
    assert got[4]["p_rarity"] == pytest.approx((0.85 + 0.3) / 2)
    scored = {r["id"]: r["lexical_sophistication"] for r in ev.with_metrics(df, words.providers(df, *tables), wanted=["lexical_sophistication"]).collect()}
    assert scored[0] == pytest.approx(0.3 + 0.7 * 0.6) and scored[1] == 0.0 and scored[2] == 0.3


def test_specific_words_beyond_the_common(spark, tables, monkeypatch):
    monkeypatch.setattr(words, "COMMON", 3)
    got = words.providers(texts(spark, "Quantum quantum reports, the webhook"), *tables).first()
    assert got["p_tech_terms"] == 3


VECTORS = [("cat", [1.0, 0.0, 0.0]), ("dog", [0.8, 0.6, 0.0]), ("code", [0.0, 0.0, 2.0]), ("zero", [0.0, 0.0, 0.0])]


def test_reference_similarity(spark):
    known = spark.createDataFrame(VECTORS, "word string, vector array<double>")
    examples = spark.createDataFrame([("coding", "code code"), ("coding", "cat code"), ("general", "dog"), ("general", "none here")], "domain string, text string")
    df = spark.createDataFrame([(1, "Cat cat dog", "creative"), (2, "code cat", "coding"), (3, "nothing", "coding"), (4, "zero", "general"), (5, None, "general")], "id long, text string, domain string")
    got = {r["id"]: r["p_reference_similarity"] for r in vectors.reference_similarity(df, known, examples).collect()}
    assert got[1] == pytest.approx((2.8 * 0.8 + 0.6 * 0.6) / math.hypot(2.8, 0.6))
    assert got[2] == pytest.approx(1.0)
    assert got[3] is None and got[4] is None and got[5] is None
    scored = {r["id"]: r["reference_similarity"] for r in ev.with_metrics(df, vectors.reference_similarity(df, known, examples), wanted=["reference_similarity"]).collect()}
    assert scored[2] == 1.0 and scored[3] == 0.5


def test_diversity():
    same = ["a"] * 50
    assert richness.mtld(same) == 2.0  # a stretch ends with its second word
    assert richness.mtld([str(i) for i in range(50)]) == 50
    assert richness.mattr(same) == pytest.approx(0.1) and richness.mattr("a b a c".split(), 2) == 1.0
    own = "a a b c d a b e".split()
    drawn = [len(set(c)) / 3 for c in combinations(own, 3)]
    assert richness.hdd(own, 3) == pytest.approx(sum(drawn) / len(drawn))
    windows = [len(set(own[i : i + 4])) / 4 for i in range(len(own) - 3)]
    assert richness.mattr(own, 4) == pytest.approx(sum(windows) / len(windows))
    assert richness.diversity("too few") is None and richness.diversity(None) is None


def test_diversity_as_provider(spark):
    df = texts(spark, " ".join(f"word{'abcdefghij'[i % 10]} other" for i in range(40)), "short")
    got = {r["id"]: r for r in ev.with_metrics(richness.richness(df), wanted=["vocabulary_richness", "n_distinct", "n_tokens", "p_diversity"]).collect()}
    assert got[0]["vocabulary_richness"] == pytest.approx((11 / 80 + 3 * got[0]["p_diversity"]) / 4)
    assert got[1]["p_diversity"] is None


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT text_word_count('a b  c') a, text_word_count(CAST(NULL AS STRING)) b, text_clamp(3) c, text_gaussian(150, 150, 200) d, text_short_factor(20) e, text_neutralised(1, 0.65) f, text_length_factor(2) g, text_task_cap(7) h, text_label(80) i, text_dimension_label(0.1) j").first()
    assert tuple(r) == (3, 0, 1.0, 1.0, pytest.approx(0.65), pytest.approx(0.825), 0.4, 22, "Very Good", "Weak")
    plan = spark.range(5).selectExpr("text_gaussian(id, 1, 2) AS g")._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_added_metrics_and_histogram(spark):
    rows = ev.with_metrics(texts(spark, "Write it. It must be so. Blue."), wanted=["kinds"], extra={"shout": "CAST(regexp_count(t, '!') AS DOUBLE)", "half": "task_signal / 2"})
    r = ev.node_histogram(rows).first()
    assert (r["shout"], r["half"]) == (0.0, pytest.approx(0.1))
    assert r["nodes"] == {"CONTEXT": 0, "TASK": 1, "CONSTRAINT": 1, "EXAMPLE": 0, "OTHER": 1}
