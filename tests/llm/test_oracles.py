"""The SQL beside the queries gives the queries' rows."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
from xsdframe.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op2_collision_counting"])
def test_same_rows(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("embeddings", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
