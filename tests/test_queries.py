"""Every query against its SQL, at the smallest size."""

import math
import os

import duckdb
import pytest

from docgrade.plans import lifecycle, registry  # noqa: F401 - lifecycle adds queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in registry.ORACLE_SQL:
        assert df.columns
        return
    r = con.execute(registry.ORACLE_SQL[name])
    theirs = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(theirs)
    mine, other = [df.columns.index(c) for c in sorted(theirs)], [theirs.index(c) for c in sorted(theirs)]
    assert sorted(repr([plain(x[i]) for i in mine]) for x in rows) == sorted(repr([plain(x[i]) for i in other]) for x in r.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
