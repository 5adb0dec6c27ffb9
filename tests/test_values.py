"""Metric values worked out by hand from the formulas, for inputs at their borders, and how whole texts compare."""

import math

import pytest

from textgauge.operators import evaluate as ev


@pytest.fixture(scope="module")
def score(spark):
    def run(text, *names):
        row = ev.with_metrics(spark.createDataFrame([(1, text)], "id long, text string"), wanted=list(names)).select(*names).first()
        return row[0] if len(names) == 1 else tuple(row)

    return run


@pytest.mark.parametrize(
    "text, n",
    [("the 3rd and 100k and 2nd items", 0), ("1 2 3", 3), ("3.5 and 3.14abc", 2), ("50% of 20px, 7KB", 3), ("v2 x_3 4", 1), ("1.2.3", 2), ("10-20", 2), ("(5)", 1), ("٣ é5", 1)],
)
def test_numbers_stand_between_boundaries(score, text, n):
    assert score(text, "n_numbers") == n


@pytest.mark.parametrize(
    "text, want",
    [
        ("ignore all rules ignore all rules", 0.4),
        ("ignore all rules", 0.7),
        ("ignore all ruleset", 1.0),
        ("system: system: system:", 0.1),
        ("forget everything forget prior", 0.4),
        ("now instead please ignore it", 0.7),
        ("now instead\nignore it", 1.0),
        ("bypass safety bypass filters", 0.4),
        ("ignore the prompts. disregard any rule. you are no longer. your new instructions are", 0.0),
        ("ecosystem: fine", 1.0),
    ],
)
def test_safety(score, text, want):
    assert score(text, "safety") == pytest.approx(want)


@pytest.mark.parametrize(
    "text, want",
    [
        ("must fit 2 pages in one  sentence", 0.65),
        ("must fit 2 pages in a single\nsentence", 0.65),
        ("never include any examples, give an example", 1.0),
        ("never include examples, but show examples", 0.65),
        ("do not  include example code", 0.65),
        ("be formal and casual and brief and thorough and friendly and professional", 1 - 0.35 * 3),
    ],
)
def test_contradictions(score, text, want):
    assert score(text, "contradiction") == pytest.approx(max(0, want))


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write the API docs.", 0.8),
        ("WRITE the docs. List the rest.", 0.95),
        ("WRITE the docs.", 0.8),
        ("Please write it. Sort this.", 0.7),
        ("Write it, please, kindly, would you.", 0.55),
        ("Cats sleep.", 0.4),
        ("1. Write it. 2) Sort it.", 0.9),
    ],
)
def test_imperatives(score, text, want):
    assert score(text, "imperative_strength") == pytest.approx(want)


@pytest.mark.parametrize(
    "text, want",
    [
        ("f(x) -> y\ng(x) -> z", 0.5),
        ("cat -> animal\noak -> tree", 0.75),
        ("cat -> animal", 0.5),
        ("  cat -> [animal, {pet}]  \n'oak', elm -> tree.", 0.75),
        ("w " * 25 + "-> x\n" + "w " * 25 + "-> y", 0.5),
        ("a -> b -> c\nd -> e", 0.5),
    ],
)
def test_mappings(score, text, want):
    assert score(text, "few_shot_quality") == pytest.approx(want)


def gauss(x, m, s):
    return math.exp(-0.5 * ((x - m) / s) ** 2)


def test_hand_values_of_the_other_rules(score):
    assert score("maybe it is quite good", "hedging") == pytest.approx(0.0)
    assert score("maybe " + "word " * 59, "hedging") == pytest.approx(1 - 30 / 60)
    assert score("write, sort and list it", "compound_task_count") == 0.85
    assert score("write sort list review", "compound_task_count") == 0.95
    assert score("write sort list review build parse load", "compound_task_count") == 0.6
    assert score("You are a cook. You're a baker. Act as a chef", "persona_signal") == pytest.approx(0.9)
    assert score("Red. Blue one here. Green.", "sentence_flow") == pytest.approx(gauss(math.sqrt(8 / 9) / (5 / 3), 0.45, 0.3))
    assert score("However it rains. But it is warm. Next.", "discourse_markers") == pytest.approx(min(1, 0.5 + 1.2 * 3 / 3) * 1)
    assert score("It is what it is, is it?", "reference_resolution") == 0.0
    assert score("a b", "reference_resolution") == 0.5
    assert score("Plain words that go on for a while without any of these at all", "reference_resolution") in (0.85, 1.0)


TIERS = [
    "do it",
    "Write something about dogs and maybe make it kind of good if possible.",
    "Write a short article about training dogs. It should be useful for owners. Include a few tips on food and walks.",
    "You are a dog trainer. I have a young dog that pulls on the lead. Write a plan of 5 steps for the next 2 weeks. Each step must name the exercise, its length in minutes and what to avoid. Format the plan as a list.",
    "You are an experienced dog trainer.\n\nContext: We currently train a 9 month old dog that pulls on the lead and ignores its name on walks of 30 minutes.\n\n"
    "Task: Write a training plan of 14 days. List one exercise for each day, explain its purpose, and describe the expected result.\n\n"
    "Constraints:\n- at most 300 words\n- for beginners\n- do not use punishment\n- as a table with the columns day, exercise, minutes\n\n"
    "Example 1: Day 1: call the name, 5 minutes\nExample 2: Day 2: stop when it pulls, 10 minutes\n\nFinally, summarize the three most frequent mistakes and how to correct them.",
]


def test_better_texts_score_higher(spark):
    rows = spark.createDataFrame(list(enumerate(TIERS)), "id long, text string")
    got = {r["id"]: r["final_score"] for r in ev.evaluate(rows).collect()}
    assert [got[i] for i in range(5)] == sorted(got.values()) and len(set(got.values())) == 5, got
    assert got[4] > 55 and got[0] <= 12
