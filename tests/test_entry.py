"""The entry points with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
found, sql = e.queries(), e.oracle_sql()
assert "evaluate_scores" in found and set(sql) <= set(found), sorted(found)
print(*sorted(found))
"""


def run(folder, code=CODE):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})


@pytest.fixture
def copy(tmp_path):
    """The repository without the optional folders, but with what is left beside them."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    return tmp_path / "repo"


@pytest.mark.parametrize("rest", ["nothing", "compiled files", "no pipeline"])
def test_entry_without_the_subpackage(copy, rest):
    if rest == "compiled files":
        (copy / "textgauge/llm/__pycache__").mkdir(parents=True)
    if rest == "no pipeline":
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    got = run(copy)
    assert got.returncode == 0, got.stderr
    names = got.stdout.split()
    assert "pipeline" not in names and not any(n.startswith("op") for n in names)


def test_a_broken_subpackage_is_not_swallowed(copy):
    (copy / "textgauge/llm").mkdir()
    (copy / "textgauge/llm/__init__.py").touch()
    (copy / "textgauge/llm/queries.py").write_text("import a_module_that_is_not_there")
    got = run(copy)
    assert got.returncode != 0 and "a_module_that_is_not_there" in got.stderr


def test_core_query_runs_without_the_subpackage(copy):
    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
assert e.queries()["judge_normalise"](spark, "/root/testdata/sf0.001").count() > 0
print("ran")
"""
    import os

    got = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert got.returncode == 0 and "ran" in got.stdout, got.stderr[-2000:]
