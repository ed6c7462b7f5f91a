"""The driver's entry with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(set(e.queries()) - set(__import__('velograph.plans.queries').plans.queries.QUERIES)) == [])"


def _said(code, folder=TOP):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=300, check=True).stdout.split()


@pytest.mark.parametrize("block", ["velograph.llm", "xxhash"])
def test_without_a_module(block):
    """With the subpackage, or a library of its, out of reach, the engine's own queries are there."""
    own = "from velograph.plans import queries as q; print(len(q.QUERIES), len(q.ORACLES), True)"
    assert _said(f"import sys; sys.modules[{block!r}] = None; {SAY}") == _said(own)


def test_with_caches_alone(tmp_path):
    """A folder that holds caches only is no subpackage."""
    import shutil

    shutil.copytree(TOP / "velograph", tmp_path / "velograph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    (tmp_path / "velograph" / "llm" / "__pycache__").mkdir(parents=True)
    assert _said(SAY, tmp_path)[2] == "True"
