"""The rest works without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("without", [("llm",), ("corpus_pipeline.py",), ("llm", "corpus_pipeline.py"), ("queries.py",)])
def test_entry_without_the_corpus_operators(tmp_path, without):
    copy = tmp_path / "copy"
    names = shutil.ignore_patterns(".git", "__pycache__", *without)

    def leave_out(folder, entries):
        inside = Path(folder).name == "tallyfold_checks"
        return names(folder, [e for e in entries if not (inside and e == "queries.py")])

    shutil.copytree(REPO, copy, ignore=leave_out)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q); print(*q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert not [n for n in done.stdout.split() if n.startswith("op") or n == "pipeline"]  # none of the corpus operators
    assert "without the corpus operators" in done.stderr
