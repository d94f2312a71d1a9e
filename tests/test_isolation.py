"""The core without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_core_stands_alone(tmp_path):
    """In a copy without the operators' folder, and with the pipeline or without it."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mlem_sql' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
