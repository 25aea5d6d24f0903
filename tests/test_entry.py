"""What the driver imports, with and without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), set(e.oracle_sql()) <= set(q), 'pipeline' in q, 'op5_minhash_dedup' in q)"


def say(folder) -> list[str]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", SAY], cwd=folder, env=env, check=True, capture_output=True, text=True).stdout.split()


@pytest.mark.parametrize("gone", [[], ["skyloom/llm", "tests/llm"], ["skyloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    shutil.copytree(ROOT / "skyloom", tmp_path / "skyloom", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path, ignore_errors=True)
        path.unlink(missing_ok=True)
    queries, _, known, pipeline, dedup = say(tmp_path)
    there = (tmp_path / "skyloom/llm").exists()
    assert int(queries) > 50 and known == "True" and pipeline == dedup == str(there)
