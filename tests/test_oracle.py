"""Every query with SQL gives the rows that a second engine gives."""

import duckdb
import pytest

import orrery.plans.log_queries  # noqa: F401  registers its queries
import orrery.plans.moment_queries  # noqa: F401  registers its queries
import orrery.plans.state_queries  # noqa: F401  likewise
import orrery.plans.stream_queries  # noqa: F401  likewise
from orrery.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(f"{x:.9g}") + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    want = [tuple(row[columns.index(c)] for c in names) for row in found.fetchall()]
    have = [tuple(row[c] for c in names) for row in df.collect()]
    assert sorted(map(repr, map(plain, have))) == sorted(map(repr, map(plain, want)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert rows and df.columns == list(dict.fromkeys(df.columns)) and not all(v is None for v in rows[0])
