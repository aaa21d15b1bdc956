"""Every query of the catalog against its SQL, on the smallest tables."""

import duckdb
import pytest

from itemloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def shown(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    found = catalog.QUERIES[name](spark, FOLDER)
    order = sorted(found.columns)
    mine = sorted(tuple(shown(r[c]) for c in order) for r in found.collect())
    answer = sql.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == order
    assert mine == sorted(tuple(shown(r[names.index(c)]) for c in order) for r in answer.fetchall())
