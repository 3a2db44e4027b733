"""Every registered query of the library against its SQL in DuckDB."""

from collections import Counter

import pytest

from quaymark import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    want = found.select(*[f'"{c}"' for c in columns]).fetchall()
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(want)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
