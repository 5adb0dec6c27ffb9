"""Every registered query of the scoring engine against its DuckDB statement."""

import duckdb
import pytest

from textgauge.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    text = lambda x: "" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x)
    return columns, sorted(tuple(map(text, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    ours = catalogue.queries()[name](spark, DATA).toPandas()
    assert len(ours)
    assert rows(ours) == rows(duck.execute(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - {"bootstrap_ci"}))
def test_other_queries_have_rows(spark, name):
    assert catalogue.queries()[name](spark, DATA).count()


TURNS = [
    "Write a list of colours. Use at most ten words. Name the red ones first. Then stop.",
    "help",
    "Sort these numbers in Python. They come from a file. For example, 3 and 1 give 1 and 3. Do not use libraries. Explain the complexity.",
    "Tell me. Tell me more.",
]


@pytest.fixture
def turns(spark, tmp_path):
    path = "file://" + str(tmp_path)
    rows = [(i, 0, "user", t) for i, t in enumerate(TURNS)] + [(9, 1, "assistant", "Here you are. It is done. Good bye.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path + "/conversations.parquet")
    return path


def test_rewrites_cover_the_table(spark, turns):
    got = {r["id"]: r["rewritten"] for r in catalogue.queries()["rewrites"](spark, turns).collect() if r["id"] >= 0}
    assert sorted(got) == [1000 * i for i in range(len(TURNS))]
    assert all("Task: <" in x and "Persona: " in x for x in got.values())


def test_bootstrap_equals_plain_resampling(spark, turns):
    import random
    import re

    from textgauge.operators import evaluate as ev

    def draws(n):
        draw = random.Random(42)
        sets = [sorted({draw.randrange(n) for _ in range(n)}) for _ in range(30)]
        return [x for x in sets if len(x) >= 2]

    rebuilt = {}
    for i, t in enumerate(TURNS):
        parts = re.split(r"(?<=[.])\s+", t)
        rebuilt[1000 * i] = [t] + ([" ".join(parts[j] for j in x) for x in draws(len(parts))] if len(parts) >= 3 else [])
    flat = [(k, n, t) for k, own in rebuilt.items() for n, t in enumerate(own)]
    scores = ev.evaluate(spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(flat)], "id long, text string")).select("id", "final_score").collect()
    by = {r["id"]: r["final_score"] for r in scores}
    want = {}
    for k in rebuilt:
        own, *s = [by[i] for i, (key, _, _) in enumerate(flat) if key == k]
        s, m = sorted(s), len(s)
        want[k] = (s[int(m * 0.025)], s[min(int(m * 0.975), m - 1)], (sum((x - sum(s) / m) ** 2 for x in s) / m) ** 0.5, m) if m >= 5 else (own, own, 0.0, m)
    got = {r["id"]: (r["low"], r["high"], r["score_std"], r["samples"]) for r in catalogue.queries()["bootstrap_ci"](spark, turns).collect() if r["id"] >= 0}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == (want[k][0], want[k][1], pytest.approx(want[k][2], abs=0.0051), want[k][3])  # the spread has two decimals


def test_full_ranking_has_the_full_scores(spark, turns):
    from textgauge.operators import evaluate as ev

    scored = ev.evaluate(catalogue.users(spark, turns)).collect()
    want = sorted(((r["final_score"], r["label"], r["id"]) for r in scored), key=lambda x: (-x[0], x[2]))
    got = sorted(catalogue.queries()["batch_rank"](spark, turns).collect(), key=lambda r: r["rank"])
    assert [(r["score"], r["verdict"], r["id"]) for r in got] == want
    assert [r["rank"] for r in got] == list(range(1, len(TURNS) + 1))
