"""Every registered query with SQL against DuckDB on the smallest tables; the part of the training-data operators may be absent."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_against_oracle(spark):
    sys.path.insert(0, str(ROOT / "tools"))
    from compare import compare

    from riskloom.plans import registry

    got = compare(spark, SF, list(registry.oracle_sql()))
    assert {k: v for k, v in got.items() if not v.startswith("ok")} == {}


def test_names_agree():
    from riskloom.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("gone", ["riskloom/llm", "corpus_pipeline.py"])
def test_without_the_training_data_part(tmp_path, gone):
    code = f"""
import sys, shutil
shutil.copytree({str(ROOT)!r}, {str(tmp_path / 'r')!r}, ignore=shutil.ignore_patterns('.git', '__pycache__'))
import os
for x in ('riskloom/llm', 'corpus_pipeline.py') if {gone!r} == 'riskloom/llm' else (({gone!r},)):
    p = os.path.join({str(tmp_path / 'r')!r}, x)
    shutil.rmtree(p) if os.path.isdir(p) else os.remove(p)
sys.path.insert(0, {str(tmp_path / 'r')!r})
import __spark_entry__ as e
q = e.queries()
assert 'r01_cross_core_window' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)
assert ('op5_token_files' in q) == ({gone!r} != 'riskloom/llm')
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_part():
    for p in ROOT.joinpath("riskloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "riskloom.llm" not in p.read_text(), p
