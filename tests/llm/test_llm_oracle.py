"""Queries of this subpackage that SQL expresses give the rows that a second engine gives."""

import duckdb
import pytest

from orrery.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = QUERIES[name](spark, FOLDER)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda row: tuple(round(x, 4) if isinstance(x, float) else x for x in row)
    assert sorted(map(repr, map(plain, found.fetchall()))) == sorted(repr(plain(r[c] for c in columns)) for r in df.collect())
