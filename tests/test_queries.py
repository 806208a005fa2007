"""Every query of the library against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

from lumenfold.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted([tuple(canon(r[c]) for c in columns) for r in got.collect()], key=repr)
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted([tuple(canon(r[names.index(c)]) for c in columns) for r in cursor.fetchall()], key=repr)
