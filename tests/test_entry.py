"""The driver's contract: every query of the core against its SQL on the smallest tables, and the shape of the package."""

import ast
import os
from pathlib import Path

import duckdb
import pytest

from tidewell.plans import registry

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(small):
        con.execute(f"create view {name.split('.')[0]} as select * from '{small}/{name}'")
    return con


#: Names of one kind of column in both engines.
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def _value(v):
    return None if isinstance(v, float) and v != v else round(v, 6) if isinstance(v, float) else v


def _sorted(rows):
    return sorted((tuple(map(_value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, small, duck):
    """Same columns of the same kinds and the same rows; null equals null only. Without SQL: at least one row."""
    got = registry.queries()[name](spark, small)
    columns = sorted(got.columns)
    rows = _sorted(tuple(r[c] for c in columns) for r in got.collect())
    if name not in registry.oracle_sql():
        assert rows
        return
    answer = duck.execute(registry.oracle_sql()[name])
    kinds = {c[0]: str(c[1]) for c in answer.description}
    order = [c[0] for c in answer.description]
    want = _sorted(tuple(r[order.index(c)] for c in columns) for r in answer.fetchall())
    assert sorted(order) == columns and rows == want
    assert {c: KINDS[t] for c, t in got.dtypes} == {c: "VARCHAR" if t == "STRING" else "BIGINT" if t == "NUMBER" else t for c, t in kinds.items()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["rec", "rec_key", "posted_utc"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    for path in (ROOT / "tidewell").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path
