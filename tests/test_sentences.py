"""What compares sentences, against all pairs and dense matrices."""

import math
import random
import time
from collections import Counter

import pytest

from textgauge.operators import evaluate as ev
from textgauge.operators import sentences

WORDS = [f"w{i}" for i in range(40)]


def texts():
    rng = random.Random(7)
    yield from ([], [[]], [["a"], ["a"]], [[], [], []], [["a"], ["b"], ["a"]], [["a", "b"]] * 90)
    for _ in range(60):
        yield [rng.sample(WORDS[: rng.choice([3, 12, 40])], rng.randint(0, 3)) for _ in range(rng.randint(0, 90))]


def plain_rank(content):
    n = len(content)
    weight = [[0.0] * n for _ in range(n)]
    for i in range(n - 1):
        weight[i][i + 1] = 1.0
        for j in range(i + 2, n):
            weight[i][j] = float(len(set(content[i]) & set(content[j])))
    out = [sum(row) for row in weight]
    rank = [1 / n] * n
    for _ in range(100):
        loose = sum(r for r, o in zip(rank, out) if o == 0)
        new = [0.85 * (sum(rank[i] * weight[i][j] / out[i] for i in range(n) if out[i]) + loose / n) + 0.15 / n for j in range(n)]
        moved, rank = sum(abs(a - b) for a, b in zip(new, rank)), new
        if moved < n * 1e-6:
            break
    mean = sum(rank) / n
    return math.sqrt(sum((r - mean) ** 2 for r in rank) / n) / mean


def test_pairs_and_ranks():
    for content in texts():
        n = len(content)
        assert sentences.shared_pairs(content) == sum(bool(set(content[a]) & set(content[b])) for a in range(n) for b in range(a + 2, n))
        if n < 2:
            assert sentences.page_rank_variation(content) is None
        elif n < 50:
            assert sentences.page_rank_variation(content) == pytest.approx(plain_rank(content), abs=1e-9)


def test_frequent_words_as_bits(monkeypatch):
    monkeypatch.setattr(sentences, "FREQUENT", 2)
    test_pairs_and_ranks()


def test_twins():
    for sets in texts():
        pairs = [(set(a), set(b)) for i, a in enumerate(sets) for b in sets[i + 1 :]]
        assert sentences.twins(sets) == sum(len(a & b) > 0.7 * min(len(a), len(b)) for a, b in pairs)


def plain_vectors(terms):
    n = len(terms)
    seen = Counter(w for s in terms for w in set(s))
    rows = []
    for s in terms:
        v = {w: c * (math.log((1 + n) / (1 + seen[w])) + 1) for w, c in Counter(s).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        rows.append({w: x / norm for w, x in v.items()})
    dot = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items())
    centre = {w: sum(r.get(w, 0) for r in rows) / n for w in seen}
    length = math.sqrt(dot(centre, centre))
    coherence = 1.5 * sum(dot(a, b) for a, b in zip(rows, rows[1:])) / (n - 1)
    focus = 1 - 2 * (1 - sum(dot(r, centre) / length for r in rows) / n)
    return min(1, max(0, coherence)), min(1, max(0, focus))


def test_term_scores():
    for terms in texts():
        if len(terms) < 2 or not any(terms):
            assert sentences.term_scores(terms) == (None, None)
        else:
            assert sentences.term_scores(terms) == pytest.approx(plain_vectors(terms))


def test_a_text_of_twenty_thousand_sentences(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    long = " ".join(" ".join(rng.choice(words[: rng.choice([20, 4000])]) for _ in range(9)).capitalize() + "." for _ in range(20_000))
    began = time.time()
    row = ev.evaluate(spark.createDataFrame([(1, long)], "id long, text string")).select("ns", "connectivity", "centrality", "sentence_repetition", "coherence", "final_score").first()
    assert row["ns"] == 20_000 and 0 < row["final_score"] <= 100
    assert time.time() - began < 60
