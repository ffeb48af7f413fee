import duckdb
import pytest

from sheetlark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_embed", "op3_minhash", "op5_suffix"])
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = c.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert df.columns == rel.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rel.fetchall(), key=str)
