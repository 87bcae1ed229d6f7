"""Every registered query of the package itself against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from lumenframe.plans import demo, more  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(cols, got):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in got), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(demo.QUERIES))
def test_query(spark, name):
    import duckdb

    df = demo.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(cols, df.select(*cols).collect())
    if name not in demo.ORACLES:
        assert got
        return
    with duckdb.connect() as c:
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = c.sql(f"SELECT {', '.join(cols)} FROM ({demo.ORACLES[name]})")
        assert got == rows(cols, want.fetchall())
