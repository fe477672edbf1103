import ast
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_the_core_imports_nothing_of_llm():
    for file in (ROOT / "quillmere").rglob("*.py"):
        if "llm" in file.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), file


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.columns == ["tier", "files", "n_tokens"] and got.count() > 0
