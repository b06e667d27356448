"""The engine stands without its training-data part."""

import os
import shutil
import subprocess
import sys

from tributary.plans import catalogue

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def registered(folder):
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=folder, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": ""})
    return [int(x) for x in out.stdout.split()]


def test_without_the_training_data_part(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    core = [len(catalogue.QUERIES), len(catalogue.ORACLE_SQL)]
    assert registered(copy) == core  # the pipeline's file alone
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert registered(copy) == core
