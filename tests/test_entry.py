"""The entry points with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(' '.join(sorted(q)))"


def listed(where) -> set:
    return set(subprocess.run([sys.executable, "-c", SHOW], cwd=where, capture_output=True, text=True, check=True).stdout.split())


def test_queries_without_the_corpus_operators(tmp_path):
    from axonlake.plans import catalog, catalog_extra, catalog_reports  # noqa: F401

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json"))
    assert listed(copy) == set(catalog.QUERIES)  # corpus_pipeline.py is still there
    (copy / "corpus_pipeline.py").unlink()
    assert listed(copy) == set(catalog.QUERIES)
