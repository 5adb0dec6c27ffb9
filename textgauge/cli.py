"""Command line: ``python -m textgauge.cli "text"``, ``--file``, ``--batch``, ``--compare``, ``--benchmark``; see ``--help``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.operators import advice, stats
from textgauge.operators.evaluate import evaluate
from textgauge.operators.findings import result
from textgauge.sources import chart, files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textgauge")
    p.add_argument("text", nargs="?")
    p.add_argument("--file", "-f", help="a file with the text")
    p.add_argument("--json", "-j", action="store_true", help="the whole result as JSON")
    p.add_argument("--verbose", "-v", action="store_true", help="all metrics with their findings")
    p.add_argument("--no-chart", action="store_true", help="no radar chart")
    p.add_argument("--output", "-o", default="output", metavar="FOLDER", help="where the chart goes (output)")
    p.add_argument("--rewrite", action="store_true", help="a template for a better text")
    p.add_argument("--confidence", action="store_true", help="scores of resampled sentences")
    p.add_argument("--ablation", action="store_true", help="what each dimension contributes")
    p.add_argument("--compare", metavar="FILE", help="a file with a second text")
    p.add_argument("--batch", metavar="JSON", help="a JSON array of texts")
    p.add_argument("--export-csv", metavar="FILE", help="the batch report as CSV")
    p.add_argument("--benchmark", metavar="JSON", help="stored score pairs: score their texts again and compare with the judge")
    p.add_argument("--write", action="store_true", help="with --benchmark: put the present scores into the file")
    return p


def ranked(spark: SparkSession, path: str) -> DataFrame:
    texts = files.json_batch(spark, path)
    report = advice.rank_batch(evaluate(texts.select("id", "text")))
    return report.join(texts.select("id", F.col("label")), "id").select("rank", "id", "label", "preview", "score", "verdict", "domain").orderBy("rank")


def benchmark(spark: SparkSession, path: str, write: bool) -> list[DataFrame]:
    """Agreement with a judge of the entries (id, tier, prompt, classical_score, llm_score, llm_label) of a results file, means by tier, and the
    entries whose score has changed. ``write`` puts the present scores and labels into the file."""
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    rows = spark.createDataFrame([(e["id"], e["tier"], e["prompt"], float(e["classical_score"]), float(e["llm_score"]), e["llm_label"]) for e in stored], "id long, tier string, text string, was double, judged double, judged_label string")
    now = evaluate(rows.select("id", "text")).select("id", F.col("final_score").alias("ours"), F.col("label").alias("our_label"), F.col("domain"))
    pairs = rows.join(now, "id")
    if write:
        found = {r["id"]: r for r in now.collect()}  # the entries of one file
        entries = [e | {"classical_score": found[e["id"]]["ours"], "classical_label": found[e["id"]]["our_label"], "classical_domain": found[e["id"]]["domain"]} for e in stored]
        with open(path, "w", encoding="utf-8") as f:
            json.dump(entries, f, indent=2)
    drift = stats.drift(pairs.select("id", F.col("ours").alias("score")), pairs.select("id", F.col("was").alias("score")), "score")
    return [stats.benchmark(pairs), stats.tier_means(pairs, "tier", "ours", "judged"), drift.orderBy("id")]


def read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def run(spark: SparkSession, args: argparse.Namespace) -> list[DataFrame]:
    """The tables to show, by precedence: batch, benchmark, comparison, ablation, evaluation."""
    if args.batch:
        report = ranked(spark, args.batch)
        if args.export_csv:
            files.write_csv_report(report, args.export_csv)
        return [report]
    if args.benchmark:
        return benchmark(spark, args.benchmark, args.write)
    texts = files.inline(spark, read(args.file) if args.file else args.text)
    if args.compare is not None:
        other = files.inline(spark, read(args.compare))
        if args.json:
            return [result(evaluate(t)).select(F.to_json(F.struct("*")).alias(name)) for t, name in ((texts, "first"), (other, "second"))]
        pair = lambda t: evaluate(t).withColumn("pair", F.col("id"))
        return [advice.compare(pair(texts), pair(other))]
    scored = evaluate(texts)
    if args.ablation:
        return [advice.ablate_dimensions(scored).orderBy("low_rank")]
    whole = result(scored)
    if args.json:
        return [whole.select(F.to_json(F.struct("*")).alias("json"))]
    out = [whole.select("final_score", "label", "detected_domain", "suggestions"), files.report(scored).orderBy("ord")]
    if args.verbose:
        out.append(whole.select(F.explode("raw_metrics").alias("metric", "found")).select("metric", "found.score", "found.findings"))
    if args.rewrite:
        out.append(advice.rewrite(scored))
    if args.confidence:
        out.append(advice.bootstrap(texts))
    if not args.no_chart:
        found = [(r["dimension"], r["score"]) for r in advice.dimensions(scored).orderBy("ord").collect()]  # eight rows
        out.append(spark.createDataFrame([(chart.write_radar(found, os.path.join(args.output, "radar_chart.svg")),)], "chart string"))
    return out


def problem(args: argparse.Namespace) -> str | None:
    """What keeps the arguments from being run."""
    for path in (args.batch, args.benchmark, None if args.batch or args.benchmark else args.file, args.compare):
        if path and not os.path.isfile(path):
            return f"no such file: {path}"
    if args.batch or args.benchmark:
        return None
    return None if (read(args.file) if args.file else args.text or "").strip() else "no text given"


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if found := problem(args):
        print(found, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("textgauge").getOrCreate()
    for table in run(spark, args):
        if args.json:
            print(*(r[0] for r in table.collect()), sep="\n")  # one row a text
        else:
            table.show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
