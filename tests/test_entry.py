"""The driver's contract, and that it holds without the optional part."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert [r["l_returnflag"] for r in entry.entry(spark).collect()] == ["A", "N", "R"]


def test_without_the_optional_part(tmp_path):
    here = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(here, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; from pyspark.sql import SparkSession as S; print(*e.queries()); print(e.entry(S.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()).count())"
    names = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}).stdout.split()
    assert "sql_flagship" in names and names[-1] == "3" and not any(n.startswith("op") or n == "pipeline" for n in names)
