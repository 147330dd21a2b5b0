"""Every registered query against its SQL over the smallest tables, and no name defined twice in a module."""

import ast
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from barloom.registry import QUERIES, SQL
from tools.check import TABLES, rows

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name not in SQL:
        return
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, cur.fetchall())


@pytest.mark.parametrize("path", sorted(str(p.relative_to(ROOT)) for p in (ROOT / "barloom").rglob("*.py") if "llm" not in p.parts))
def test_no_name_is_defined_twice(path):
    names = [n.name for n in ast.parse((ROOT / path).read_text()).body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
    assert not [n for n, k in Counter(names).items() if k > 1]
