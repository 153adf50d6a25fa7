"""Each query against its SQL on the driver's tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from monsoonway.plans import accessibility, fields, measures, mechanism, routing, shapes, states
from monsoonway.plans import queries as plans

QUERIES = plans.QUERIES | accessibility.QUERIES | routing.QUERIES | measures.QUERIES | fields.QUERIES | states.QUERIES | shapes.QUERIES | mechanism.QUERIES
ORACLE_SQL = plans.ORACLE_SQL | accessibility.ORACLE_SQL | routing.ORACLE_SQL | measures.ORACLE_SQL | fields.ORACLE_SQL | states.ORACLE_SQL | shapes.ORACLE_SQL | mechanism.ORACLE_SQL
DATA = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(x, 6) + 0.0) if isinstance(x, float) else str(x) for x in (r[i] for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    got = QUERIES[name](spark, str(DATA))
    want = tables.execute(ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
