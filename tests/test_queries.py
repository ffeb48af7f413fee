import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from sheetlark import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = norm(df.select(*sorted(df.columns)).collect()), norm(rel.project(", ".join(f'"{c}"' for c in sorted(rel.columns))).fetchall())
    assert got == want and want


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(re.fullmatch(r"\w+", k) for k in e.queries())


def test_every_value_of_a_document_is_found(spark, tmp_path):
    """All matches, told by Python's own engine."""
    texts = ["1111 2222 3333 4444 5555-6666-7777-8888;10.0.0.1 10.0.0.2,1.2.3.4.5", "a1111222233334444 9999888877776666", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    card, ipv4 = r"(?<![0-9A-Za-z])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?![0-9A-Za-z])", r"(?<![0-9A-Za-z.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![0-9A-Za-z])"
    want = [(str(i), k, v) for i, t in enumerate(texts) for k, p in (("card", card), ("ipv4", ipv4)) for v in re.findall(p, t or "", re.ASCII)]
    got = [tuple(r) for r in queries.findings_revealed_on_request(spark, str(tmp_path)).select("path", "kind", "raw").collect()]
    assert sorted(got) == sorted(want) and len(got) == 6
    assert queries.findings_masked_by_default(spark, str(tmp_path)).count() == 6
    assert {r.path: r.n_findings for r in queries.risk_level(spark, str(tmp_path)).collect()} == {"0": 5, "1": 1, "2": 0, "3": 0}
    assert queries.findings_grouped(spark, str(tmp_path)).agg({"n_findings": "max"}).first()[0] == 6


@pytest.mark.parametrize("name", ["ibans_in_cells", "card_luhn", "cpf_in_cells"])
def test_a_narrow_file_is_dealt_over_the_cores(spark, name):
    """One small file is one task's to read; what its rows ask for is everyone's."""
    used = queries.QUERIES[name](spark, SF).groupBy(F.spark_partition_id()).count().collect()
    assert len(used) > 8 and max(r["count"] for r in used) < 40
