"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import pytest
from siltstone import vault_queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(vault_queries.SQL))
def test_against_sql(spark, duck, name):
    df = vault_queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({vault_queries.SQL[name]})").fetchall()
    text = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(text, got)) == sorted(map(text, want))


def test_entry_has_rows(spark):
    import __spark_entry__

    if not DATA.exists():
        pytest.skip("no test tables here")
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
