"""Every registered query against its SQL twin in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from paylens.plans import oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = ["lineitem", "orders", "customer", "part", "supplier", "nation"]
DUCK_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}

ORACLE = oracle.oracle_sql()
OTHERS = entry.llm.queries() if entry.llm else {}
QUERIES = {name: query for name, query in entry.queries().items() if name not in OTHERS}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


def _sorted(rows):
    return sorted(rows, key=lambda row: [(v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in row])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLE[name])
    assert cols == sorted(rel.columns)
    duck_types = dict(zip(rel.columns, rel.types))
    assert {c: DUCK_TYPES[t] for c, t in df.dtypes} == {c: str(duck_types[c]) for c in cols}

    ours = _sorted([tuple(r[c] for c in cols) for r in df.collect()])
    theirs = _sorted(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert ours == theirs
    assert not any(isinstance(v, float) and math.isnan(v) for row in ours for v in row)
    assert ours or name == "skill_gap__all_skills"
