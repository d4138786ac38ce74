"""The library stands without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_import_without_llm(tmp_path):
    shutil.copytree(REPO / "quillspan", tmp_path / "quillspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300)


def test_nothing_else_imports_llm():
    for f in (REPO / "quillspan").rglob("*.py"):
        if "llm" not in f.parts:
            assert "quillspan.llm" not in f.read_text()
