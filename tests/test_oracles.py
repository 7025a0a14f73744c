"""Every registered query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from cuepoint.plans import oracle, roster

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    return str(value)


def rows(records, columns):
    return sorted(tuple(normal(r[c]) for c in columns) for r in records)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(roster.queries()))
def test_query_equals_its_sql(spark, sf, duck, name):
    found = [r.asDict() for r in roster.queries()[name](spark, sf).collect()]
    relation = duck.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in relation.description]
    expected = [dict(zip(columns, r, strict=True)) for r in relation.fetchall()]
    assert not found or sorted(found[0]) == sorted(columns)
    assert rows(found, sorted(columns)) == rows(expected, sorted(columns))


def test_every_query_has_sql():
    assert set(roster.queries()) == set(oracle.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
