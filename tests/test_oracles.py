"""Every registered query that has SQL agrees with DuckDB; the others run."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import registry

#: Large enough that range boundaries are drawn from samples.
SF = "/root/testdata/sf0.01"
NAMES = sorted(registry.queries())


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(norm(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    rel = duck.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rel.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
