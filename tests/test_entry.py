"""The driver's contract holds with and without the subpackage for training corpora."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_series_queries_stay_without_the_subpackage(tmp_path):
    for name in ("tidewell", "corpus_pipeline.py", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; from tidewell.queries import ORACLES, QUERIES; assert set(e.queries()) == set(QUERIES) and e.oracle_sql() == ORACLES; print(len(QUERIES))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) > 100, done.stderr
