"""The entry module without the corpus subpackage, its tests and its pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(x.startswith('op') or x == 'pipeline' for x in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("gone", [("tessera/llm", "tests/llm"), ("tessera/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_lives_without_the_corpus_operators(tmp_path, gone):
    from tessera.catalog import QUERIES

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis"))
    for name in gone:
        path = copy / name
        if path.exists():  # the driver may have deleted them here already
            shutil.rmtree(path) if path.is_dir() else path.unlink()
    out = subprocess.run([sys.executable, "-c", SAY], cwd=copy, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert out.stdout.split() == [str(len(QUERIES)), "False", "True"]
