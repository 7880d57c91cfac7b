"""The rest imports and registers its queries where the corpus operators are absent."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "cuewright", tmp_path / "cuewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'qa_score' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for file in (ROOT / "cuewright").rglob("*.py"):
        if "llm" not in file.parts:
            assert "cuewright.llm" not in file.read_text(), file
