"""The entry module with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
NAMES = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(x.startswith('op') for x in q), 'pipeline' in q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_corpus_operators(tmp_path, pipeline):
    leave = shutil.ignore_patterns("__pycache__", "llm")
    shutil.copytree(ROOT / "orgcard", tmp_path / "orgcard", ignore=leave)
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])]:
        shutil.copy(ROOT / name, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", NAMES], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, corpus, has_pipeline = out.stdout.split()
    assert int(n) >= 42 and corpus == "0" and has_pipeline == "False"
