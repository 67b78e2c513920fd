"""Every query of the engine against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from stratakv.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(value):
    if isinstance(value, float) and value == int(value):
        return int(value)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bloom_probe_of_all_keys_misses_none(spark):
    from stratakv.sources import adapters

    found = {(r.key, r.level) for r in QUERIES["bloom_probe_all"](spark, SF).collect()}
    there = {(f"user{r.key:012d}", r.level) for r in adapters.levels(spark, SF).collect()}
    assert there <= found and len(found) < 1.1 * len(there) + 10
