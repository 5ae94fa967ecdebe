"""The library without its training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
LISTED = "from __spark_entry__ import oracle_sql, queries; import bench; print(*queries()); assert oracle_sql().keys() <= queries().keys()"


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_the_rest_imports_and_lists_its_queries(tmp_path, with_pipeline):
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"]))
    copy = shutil.copytree(REPO, tmp_path / "copy", ignore=left_out)
    ran = subprocess.run([sys.executable, "-c", LISTED], cwd=copy, capture_output=True, text=True, check=True)
    names = ran.stdout.split()
    assert "list_collapse" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]


def test_nothing_else_imports_the_subpackage():
    for path in [*REPO.glob("mediashelf/**/*.py"), *REPO.glob("workload/*.py"), REPO / "bench.py"]:
        if "llm" not in path.relative_to(REPO).parts:
            assert "mediashelf.llm" not in path.read_text()
