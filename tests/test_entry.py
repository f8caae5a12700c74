"""The rest of the project without the subpackage for training data."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
IN_COPY = "import __spark_entry__ as e; from workload.catalog import CATALOG; assert set(e.queries()) == set(e.oracle_sql()) == set(CATALOG)"


@pytest.mark.parametrize("left", ["no folder", "an empty folder", "no pipeline either"])
def test_entry_without_the_subpackage(tmp_path, left):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda at, names: [n for n in names if n in (".git", "llm", "__pycache__", ".pytest_cache")])
    if left == "an empty folder":
        (copy / "terralake/llm").mkdir()
    if left == "no pipeline either":
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    made = subprocess.run([sys.executable, "-B", "-c", IN_COPY], cwd=copy, capture_output=True, text=True, timeout=120)
    assert made.returncode == 0, made.stderr
