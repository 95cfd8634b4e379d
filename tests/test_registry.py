import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
# The full list runs with `python tests/oracle.py`; these cover every family quickly.
QUICK = (
    "daily_bars", "targets", "range_vol_features", "calendar_features", "calendar_gaps", "coverage",
    "folds_expanding", "baselines_return", "sequence_windows", "second_venue_candles", "buy_and_hold",
)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert {"model", "cost_bps", "sharpe"} <= set(df.columns) and df.count() == 16


def test_import_without_the_text_operators(tmp_path):
    """A copy without both text folders still lists every other query, with or without the pipeline's file."""
    here = os.path.dirname(os.path.abspath(entry.__file__))
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "*.md")
    copy = tmp_path / "copy"
    shutil.copytree(here, copy, ignore=skip)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"
    others = sum(not name.startswith("op") and name != "pipeline" for name in entry.queries())
    for name in ("corpus_pipeline.py", None):
        env = {**os.environ, "PYTHONPATH": str(copy)}
        said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True)
        assert said.stdout.split() == [str(others), "False", "True"]
        if name:
            os.remove(copy / name)
