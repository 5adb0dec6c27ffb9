"""Findings, the nested result and the command line."""

import json

import pytest

from textgauge import cli
from textgauge.operators import evaluate as ev
from textgauge.operators.findings import FINDINGS, result
from textgauge.operators.metrics import METRICS
from textgauge.sources import chart


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["Write a report on sales in json. You are an analyst. It must be short.", "help", "# A\n\n- b\n- c\n\nMaybe it is so."]
    return {r["id"]: r for r in result(ev.evaluate(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))).collect()}


def test_every_metric_has_findings():
    assert set(FINDINGS) == set(METRICS)


def test_result_is_whole(rows):
    r = rows[0]
    assert len(r["rubric_dimensions"]) == 8 and len(r["raw_metrics"]) == len(METRICS)
    assert r["raw_metrics"]["rule_based.task_signal"]["findings"] == ["imperative verbs", "a deliverable"]
    assert r["raw_metrics"]["rule_based.persona_signal"]["findings"] == ["names a role"]
    assert r["raw_metrics"]["graph_analysis.completeness"]["findings"] == ["missing context", "missing task"]  # "in json" makes the first sentence a constraint
    assert {d["label"] for d in r["rubric_dimensions"]} <= {"Excellent", "Strong", "Good", "Fair", "Weak"}
    assert rows[1]["task_penalty_applied"] and rows[1]["final_score"] <= 12
    assert "bullet points" in rows[2]["raw_metrics"]["rule_based.structure"]["findings"]
    assert rows[2]["raw_metrics"]["rule_based.hedging"]["findings"] == ["moderate hedging"]  # one in ten words


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "batch.json"
    path.write_text(json.dumps(["help", {"prompt": "Write a report in json for experts. It must be short.", "tier": "good"}]))
    report = cli.run(spark, cli.parser().parse_args(["--batch", str(path), "--export-csv", str(tmp_path / "out.csv")]))[0].collect()
    assert [(r["rank"], r["label"]) for r in report] == [(1, "good"), (2, "#1")]
    assert (tmp_path / "out.csv").read_text().startswith("id,label,preview,score,verdict,domain\n2,good,")
    (tmp_path / "b.txt").write_text("help")
    args = cli.parser().parse_args(["help", "--compare", str(tmp_path / "b.txt")])
    assert cli.run(spark, args)[0].first()["verdict"] == "tie"
    one = cli.run(spark, cli.parser().parse_args(["help", "-j"]))[0].first()["json"]
    assert json.loads(one)["final_score"] <= 12
    shown = cli.run(spark, cli.parser().parse_args(["-f", str(tmp_path / "b.txt"), "-o", str(tmp_path / "charts"), "--rewrite"]))
    chart = shown[-1].first()["chart"]
    assert chart == str(tmp_path / "charts/radar_chart.svg") and "Task Definition" in open(chart).read()
    assert len(cli.run(spark, cli.parser().parse_args(["help", "--no-chart"]))) == 2


@pytest.mark.parametrize("argv, said", [([" "], "no text"), (["--file", "/no/such/file"], "/no/such/file"), (["help", "--compare", "/no/such/file"], "/no/such/file"), (["--batch", "/no/such/file"], "/no/such/file"), ([], "no text")])
def test_command_line_refuses(argv, said, capsys):
    assert cli.main(argv) == 1
    assert said in capsys.readouterr().err


def test_benchmark(spark, tmp_path):
    path = tmp_path / "results.json"
    texts = ["help", "Write a report in json for experts. It must be short.", "Sort it.", "You are a cook. List 5 soups. Avoid meat."]
    entries = [{"id": i, "tier": "low" if i % 2 else "high", "prompt": t, "classical_score": 1.0, "llm_score": 10.0 * i, "llm_label": "Poor", "note": "kept"} for i, t in enumerate(texts)]
    path.write_text(json.dumps(entries))
    whole, tiers, drift = cli.run(spark, cli.parser().parse_args(["--benchmark", str(path), "--write"]))
    assert whole.first()["n"] == 4 and -1 <= whole.first()["pearson"] <= 1
    assert {r["tier"]: r["mean_judged"] for r in tiers.collect()} == {"low": 20.0, "high": 10.0}
    assert drift.count() == 4
    again = json.loads(path.read_text())
    assert all(e["note"] == "kept" and e["classical_score"] != 1.0 for e in again)
    assert cli.run(spark, cli.parser().parse_args(["--benchmark", str(path)]))[2].count() == 0


def test_chart():
    drawn = chart.radar([("A & B", 0.5), ("C", 1.0), ("D", 0.0)])
    assert "A &amp; B 0.50" in drawn and drawn.count("<polygon") == 6
    assert "320.0,100.0" in chart.radar([("A", 1.0), ("B", 0.0)])  # the first axis points up
