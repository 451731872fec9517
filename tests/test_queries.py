import duckdb
import pytest

from keyloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    flat = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in data]
    return sorted(names), sorted(flat, key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_no_query_is_held_against_nothing(name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    assert c.execute(queries.SQL[name]).fetchone() is not None


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())
