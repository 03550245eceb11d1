import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["grp", "seq", "ts_ns", "value"] and df.count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_without_the_training_data_operators(tmp_path, gone):
    """The rest stands alone: the subpackage and its tests may be deleted, with or without the pipeline."""
    skip = shutil.ignore_patterns(*gone, ".git", "__pycache__")
    shutil.copytree(HERE, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120, env=env)
