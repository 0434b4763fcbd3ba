"""Every registered query with SQL equals it on the smallest tables; the others give rows."""

import decimal

import duckdb
import pytest

from quillstream.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return made


def ordered(rows):
    plain = [tuple(float(v) if isinstance(v, decimal.Decimal) else v for v in r) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name not in SQL:
        assert rows
        return
    found = con.sql(SQL[name])
    assert sorted(found.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert ordered(rows) == ordered(con.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
