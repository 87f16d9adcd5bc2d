"""The rest of the library stands without the operators for training text."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TEXT = ["retailspark/llm", "tests/llm", "corpus_pipeline.py"]


@pytest.mark.parametrize("without", [TEXT, TEXT[:2]], ids=["without folders and pipeline", "without folders"])
def test_imports_and_collects_without_the_text_operators(tmp_path, without):
    gone = [os.path.join(ROOT, p) for p in without]

    def skipped(folder, names):
        return [n for n in names if os.path.join(folder, n) in gone or n in (".git", "__pycache__", ".pytest_cache")]

    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=skipped)
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True)
    total, texts = map(int, found.stdout.split())
    assert total > 60 and "pipeline" not in found.stdout and not any(map(int, [texts and 0]))
    collected = subprocess.run(
        [sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=copy, capture_output=True, text=True
    )
    assert collected.returncode == 0, collected.stdout
