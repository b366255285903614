"""Every registered query with SQL against that SQL, on the smallest tables."""

import math
import os

import pytest

from millrace.jobs import catalog, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def same(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = query(spark, SF)
    names = sorted(got.columns)
    r = con.execute(sql)
    columns = [d[0] for d in r.description]
    assert sorted(columns) == names
    want = sorted(repr([plain(dict(zip(columns, row, strict=True))[c]) for c in names]) for row in r.fetchall())
    assert sorted(repr([plain(row[c]) for c in names]) for row in got.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])
