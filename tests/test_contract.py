import os
import shutil
import subprocess
import sys

import __spark_entry__ as contract

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_sql_belongs_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    ignore = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py")
    shutil.copytree(HERE, tmp_path / "repo", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
