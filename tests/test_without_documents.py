"""The rest of the library stands without the folder of document operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_the_document_folder(tmp_path):
    """With and without corpus_pipeline.py, which then has nothing to call."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", ".hypothesis"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 250 and set(q) == set(o); assert 'pipeline' not in q"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)}, timeout=100)
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
