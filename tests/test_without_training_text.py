"""The library imports and works without the optional query modules, whichever of their files are missing."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

TRY = """
import __spark_entry__ as entry
names = entry.queries()
assert "parity_quality_source" in names and set(entry.oracle_sql()) <= set(names)
print(sum(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names))
"""


@pytest.mark.parametrize("missing", [["tablewright/llm"], ["tablewright/llm", "corpus_pipeline.py"]])
def test_imports_without(tmp_path, missing):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in missing:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            os.remove(path)
    done = subprocess.run([sys.executable, "-c", TRY], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "0"


def test_other_missing_modules_are_errors(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "llm"))
    (copy / "tablewright" / "llm").mkdir()
    (copy / "tablewright" / "llm" / "__init__.py").write_text("")
    (copy / "tablewright" / "llm" / "queries.py").write_text("import no_such_library")
    done = subprocess.run([sys.executable, "-c", TRY], cwd=copy, capture_output=True, text=True, timeout=300)
    assert "no_such_library" in done.stderr
