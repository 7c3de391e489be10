"""The driver contract, with and without the optional corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_oracle_names_are_queries():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 100


def test_flagship_has_rows(spark):
    out = entry.queries()["factor_momentum_rank"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["date_", "code", "factor"] and out.count() > 0


def test_core_stands_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "quantloom", tmp_path / "quantloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = set(e.queries()); print(len(n), any(x.startswith('op') or x == 'pipeline' for x in n))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, timeout=120).stdout.split()
    assert int(said[0]) > 100 and said[1] == "False"


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "quantloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quantloom.llm" not in path.read_text() or path.name == "ship.py", path
