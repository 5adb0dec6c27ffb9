"""Operators 6 and 8 against brute force."""

import random

import numpy as np
import pytest
from helpers import SCHEMA, by_id, empty, messy, prose

from textgauge.llm import neardup, nearest


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def checked(spark, docs, k):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_components(rows, k, 80)
    got = neardup.near_duplicates(docs, k=k).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("k", [2, 5])
def test_components_of_messy_documents(spark, k):
    checked(spark, messy(spark), k)


def test_components_of_a_near_miss_cluster(spark):
    """Many variants of one text around the threshold: the pivot misses some links that tiles must find."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(60)] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(words), "en", "s", 0, 0, "", 0, 0, 0.0, False))
    rows += [(200 + i, prose(rng, 40), "en", "s", 0, 0, "", 0, 0, 0.0, False) for i in range(60)]
    checked(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), 2)


def test_components_with_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 7)
    test_components_of_a_near_miss_cluster(spark)


def test_no_documents(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in neardup.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:320], rng.integers(0, 2**63, 0).astype(np.uint64)]))
    s = neardup.sketches([a, b, a[:1], a])
    assert not (s == np.uint64(0xFFFFFFFFFFFFFFFF)).any()
    assert (s[0] == s[3]).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15


def brute_nearest(vectors, every, k):
    good = {}
    for i, v, *_ in vectors:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good[i], v) if i in good else v
    out = []
    for q in good:
        if q % every == 0:
            scored = []
            for i, v in good.items():
                if i != q and len(v) == len(good[q]):
                    s = 0.0
                    for x, y in zip(np.float32(good[q]).astype(float), np.float32(v).astype(float)):
                        s += x * y
                    scored.append((-s, i))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(2048, 8192), (3, 20)])
def test_nearest_is_exact(spark, blocks):
    rng = np.random.default_rng(4)
    rows = [(i, np.float32(rng.normal(size=8)).tolist(), 1, "x") for i in range(150)]
    rows += [(200 + i, rows[3][1], 1, "x") for i in range(60)]  # one common vector
    rows += [(300, None, 1, "x"), (301, [0.0] * 8, 1, "x"), (302, [1.0, float("nan")] + [0.0] * 6, 1, "x"), (303, [None] * 8, 1, "x"), (304, [float("inf")] * 8, 1, "x"), (305, [], 1, "x"), (None, [1.0] * 8, 1, "x"), (5, [9.0] * 8, 1, "x"), (400, [1.0, 2.0], 1, "x"), (420, [2.0, 1.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim int, id string").repartition(3)
    got = by_id(nearest.nearest(df, 20, 20, query_block=blocks[0], candidate_block=blocks[1]), "query_id", "rank", "vec_id", "score")
    want = brute_nearest(rows, 20, 20)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_nearest_of_nothing(spark):
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), 20, 20).count() == 0
