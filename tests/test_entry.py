"""The driver's contract, with and without the subpackage for training data."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_core_stands_alone(tmp_path):
    """Without the subpackage and the pipeline the rest imports."""
    (tmp_path / "vellum").mkdir()
    for p in (ROOT / "vellum").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "vellum" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import importlib.util as u; s = u.spec_from_file_location('e', {str(tmp_path / '__spark_entry__.py')!r}); m = u.module_from_spec(s); s.loader.exec_module(m); print(m.llm, len(m.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], capture_output=True, text=True, cwd=tmp_path, check=True).stdout
    assert out.startswith("None ")
