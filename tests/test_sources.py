"""Files, streams and judges."""

import csv
import json

from textgauge.operators import judge
from textgauge.sources import files
from textgauge.streaming import scores


def test_json_batch(spark, tmp_path):
    path = tmp_path / "batch.json"
    path.write_text(json.dumps(["one", {"prompt": "two", "tier": "good"}, "  ", {"prompt": "three", "label": "x"}, {"prompt": "four"}]))
    got = [tuple(r) for r in files.json_batch(spark, str(path)).orderBy("id").collect()]
    assert got == [(1, "#1", "one"), (2, "good", "two"), (4, "x", "three"), (5, "#5", "four")]


def test_text_files_and_csv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nline two")
    assert files.text_files(spark, str(tmp_path / "a.txt")).first()["text"] == "line one\nline two"
    rows = spark.createDataFrame([(2, 7, "b", 'two "quoted", words', 1.5, "Poor", "general"), (1, 9, "a", "line\nbreak", 90.0, "Good", "coding")], "rank int, id long, label string, preview string, score double, verdict string, domain string")
    files.write_csv_report(rows, str(tmp_path / "out.csv"))
    with open(tmp_path / "out.csv", newline="") as f:
        got = list(csv.reader(f))
    assert got[0] == ["id", "label", "preview", "score", "verdict", "domain"]
    assert got[1:] == [["9", "a", "line\nbreak", "90.0", "Good", "coding"], ["7", "b", 'two "quoted", words', "1.5", "Poor", "general"]]
    files.write_results(rows, str(tmp_path / "out.json"))
    assert [r["id"] for r in json.loads((tmp_path / "out.json").read_text())] == [7, 9]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Write it.", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "in"))
    stream = scores.stream_metrics(scores.read_documents(spark, str(tmp_path / "in")), ["wc", "task_signal"])
    query = stream.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("streamed").collect()] == [(1, 2, 0.2)]


def test_judge_calls_and_cache(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")

    def answer(prompt, key):
        if key == "used":
            raise RuntimeError("429 quota")
        return '{"final_score": 50}'

    got = judge.normalise(judge.ask(judge.prompts(texts), answer, keys=("used", "fresh"), wait=0.0)).orderBy("id").collect()
    assert [(r["judged"], r["verdict"]) for r in got] == [(50.0, "Average")] * 2
    cache = texts.filter("id = 1").select(judge.cache_key("p", "m").alias("key"))
    assert [r["id"] for r in judge.misses(texts, cache, "p", "m").collect()] == [2]


def test_judge_errors(spark):
    texts = spark.createDataFrame([(1, "fails"), (2, "b"), (3, None)], "id long, text string").coalesce(1)

    def answer(prompt, key):
        if key == "bad":
            raise RuntimeError("401 unauthorized")
        if prompt.endswith("fails"):
            raise RuntimeError("connection reset")
        return '{"final_score": 80}' if prompt.endswith("b") else "no object"

    got = {r["id"]: r for r in judge.ask(judge.prompts(texts), answer, keys=("bad", "good"), wait=0.0, quota_wait=0.0).collect()}
    assert (got[1]["response"], got[1]["error"]) == (None, "connection reset")
    assert got[2]["response"] == '{"final_score": 80}' and got[2]["error"] is None and got[3]["response"] == "no object"
    none = judge.ask(judge.prompts(texts), answer, keys=("bad",), wait=0.0).collect()
    assert all(r["response"] is None and r["error"] for r in none)


def test_cache_is_written_without_errors(spark, tmp_path):
    answered = spark.createDataFrame([(1, "a", '{"final_score": 1}'), (2, "b", None), (3, "c", "broken {"), (4, "a", '{"final_score": 1}')], "id long, text string, response string")
    path = str(tmp_path / "cache")
    judge.write_cache(answered, path, "p", "m")
    cache = spark.read.parquet(path)
    assert cache.count() == 1
    assert sorted(r["id"] for r in judge.misses(answered.select("id", "text"), cache, "p", "m").collect()) == [2, 3]
    assert sorted(r["id"] for r in judge.cached(answered.select("id", "text"), cache, "p", "m").collect()) == [1, 4]
