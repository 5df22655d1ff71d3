"""Every query of the catalogue against its SQL in DuckDB."""

import duckdb
import pytest

from ledgerloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(found):
    return sorted(tuple("NULL" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    if name not in catalog.SQL:
        assert df.count() > 0
        return
    want = duck.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert rows(tuple(r[c] for c in columns) for r in df.collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())
