import duckdb
import pytest

from pulsework import catalog

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "lineitem", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, D)
    names = sorted(df.columns)
    order = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=order)
    want = sorted(con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({catalog.ORACLE[name]})").fetchall(), key=order)
    assert got == want and got
