"""The entry points work without the subpackage for training data, whichever of its parts are gone."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROBE = """
import __spark_entry__ as e
queries, sql = e.queries(), e.oracle_sql()
assert not any(n.startswith("op") or n == "pipeline" for n in (*queries, *sql)), sorted(queries)
assert len(queries) > 90 and set(sql) <= set(queries)
"""
RUN = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert queries["tel_report_summary"](spark, SF).count() > 0
spark.stop()
"""


@pytest.mark.parametrize("gone", [("sparkloom/llm", "tests/llm"), ("sparkloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_library_without_training_operators(tmp_path, sf, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for path in gone:
        if (copy / path).is_dir():
            shutil.rmtree(copy / path)
        else:
            (copy / path).unlink(missing_ok=True)
    code = PROBE + (f"SF = {sf!r}" + RUN if len(gone) == 3 else "")
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr[-2000:]


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
