"""Every query of the catalogue against its SQL on DuckDB."""

import math

import duckdb
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(map(plain, (r[c] for c in cols))) for r in df.collect()]
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    expected = [tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall()]
    key = lambda t: tuple("" if x is None else x for x in t)
    assert sorted(got, key=key) == sorted(expected, key=key)
