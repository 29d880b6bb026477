"""The library works without the training-data folders and the corpus pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PARTS = ("plaudit", "corpus_pipeline.py", "__spark_entry__.py")


@pytest.mark.parametrize("gone", [("plaudit/llm",), ("corpus_pipeline.py",), ("plaudit/llm", "corpus_pipeline.py")])
def test_entry_without_deleted_parts(tmp_path, gone):
    for part in PARTS:
        source = os.path.join(ROOT, part)
        if part in gone or not os.path.exists(source):
            continue
        if os.path.isdir(source):
            left_out = [os.path.basename(g) for g in gone if os.path.dirname(g) == part]
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__", *left_out))
        else:
            shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print('recommend_score' in q and set(o) <= set(q), 'pipeline' in q, any(k.startswith('op1_') for k in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    has_llm = "plaudit/llm" not in gone and os.path.isdir(os.path.join(ROOT, "plaudit/llm"))
    assert out.stdout.split() == ["True", "False", str(has_llm)], out.stderr
