"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quillspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toArrow()
    want = duck.execute(registry.SQL[name]).to_arrow_table()
    columns = sorted(got.schema.names)
    assert columns == sorted(want.schema.names)
    rows = lambda t: sorted(repr([r[c] for c in columns]) for r in t.to_pylist())
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["page_id", "md"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
