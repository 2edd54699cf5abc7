"""The driver's contract, and that the rest stands without the llm subpackage."""

import ast
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_query_has_a_name_and_oracles_belong_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(callable(f) for f in e.queries().values())


def test_nothing_else_imports_llm():
    for path in (ROOT / "tracemill").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("tracemill.llm") for n in names), path


def test_entry_without_llm(tmp_path):
    for name in ("tracemill", "__spark_entry__.py"):
        os.symlink(ROOT / name, tmp_path / name) if name.endswith(".py") else subprocess.run(["cp", "-r", ROOT / name, tmp_path / name], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "tracemill" / "llm"], check=True)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('p7_found' in e.queries(), 'p9_found' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == ["True", "False"], said.stderr


def test_flagship(spark, small):
    import __spark_entry__ as e

    assert e.queries()["p7_found"](spark, small).count() > 0
