"""Every usage query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from usagelens.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    tell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(tell, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = duck.execute(f"SELECT {cols} FROM ({ORACLES[name]})").fetchall()
    assert plain(df.select(*sorted(df.columns)).collect()) == plain(want)
