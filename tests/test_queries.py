"""Every query of the engine with SQL against DuckDB on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tessera.plans.queries import QUERIES, SQL

SLOW = {"beam_paths", "multihop_query"}


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(row[c]) for c in columns) for row in df.collect())
    db = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    found = db.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(row[i]) for i in places) for row in found.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
