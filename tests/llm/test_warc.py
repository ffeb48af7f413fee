import gzip
import hashlib
import os

import duckdb

from sheetlark.llm import warc
from sheetlark.llm.queries import ORACLES, op4_warc

SF = "/root/testdata/sf0.001"
LONG = "<html>" + "x" * 200


def test_matches_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    assert sorted(map(tuple, op4_warc(spark, SF).collect()), key=str) == sorted(c.sql(ORACLES["op4_warc"]).fetchall(), key=str)


def rows():
    return [(5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, None, LONG), (9, None, LONG), (4, "u\r\nX: y", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "n", LONG), (11, "u", "é" * 100_000), (12, "u", "é" * 100_000)]


def test_edges_rolling_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, "z") for r in rows()], "page_id long, url string, html string, file string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(df, folder, shard_bytes=2000, roll_bytes=300)
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(rows()) and manifest.count() > 3
    by = sorted(((r.id if r.id is not None else -1, r.record_type, r.payload_bytes, r.refers_to) for r in got), key=str)
    expect = []
    for i, _, html in rows():
        size = len((html or "").encode())
        to = {5: 3, 9: 3, 12: 11, None: 3}.get(i)
        expect.append((i if i is not None else -1, "revisit" if to else "response", size, to))
    assert by == sorted(expect, key=str)
    bodies = {r.id: r.payload for r in got if r.record_type == "response"}
    assert bodies[11].decode() == "é" * 100_000 and bodies[7] == b""
    for m in manifest.collect():
        raw = (tmp_path / "w" / m.file).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (m.bytes, m.sha256)
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")


def test_same_files_on_every_run(spark, tmp_path):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string")
    names = []
    for n in (1, 3):
        warc.write_warc(df.repartition(n), f"file://{tmp_path}/{n}", shard_bytes=2000, roll_bytes=500)
        names.append({f: (tmp_path / str(n) / f).read_bytes() for f in os.listdir(tmp_path / str(n)) if f.endswith("gz")})
    assert names[0] == names[1]


def test_unlisted_files_do_not_count(spark, tmp_path):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.write_warc(df, folder)
    (tmp_path / "w" / "shard-999999-000000.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read_warc(spark, folder).count() == len(rows())
    warc.write_warc(df.limit(0), f"file://{tmp_path}/e")
    (tmp_path / "e").mkdir(exist_ok=True)
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_wide_ids_even_shards_and_null_ids(spark, tmp_path):
    """One far id puts the others into no common shard; ids may span all longs; rows without id revisit a copy that has one."""
    same = "<p>" + "same " * 60
    rows = [(i, f"http://h/{i}", f"<p>{i} " + "word " * 200) for i in range(400)]
    rows += [(-(2**63), "u", "low " * 300), (2**63 - 1, "u", same), (7_000, "u", same), (None, "n", same), (None, "n", "alone " * 50), (None, "n", "alone " * 50), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(df, folder, shard_bytes=40_000, roll_bytes=2_000).collect()
    shards = {}
    for r in manifest:
        shards[r.shard] = shards.get(r.shard, 0) + r.records
    assert len(shards) > 8 and max(shards.values()) < 60 and len(manifest) > len(shards)
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got if r.id is not None}
    assert (by[7_000].record_type, by[2**63 - 1].record_type, by[2**63 - 1].refers_to) == ("response", "revisit", 7_000)
    null = sorted((r.record_type, r.refers_to or 0, r.payload_bytes) for r in got if r.id is None)
    assert null == [("response", 0, 0), ("response", 0, 300), ("response", 0, 300), ("revisit", 7_000, len(same))]
    again = warc.write_warc(df.repartition(2), f"file://{tmp_path}/x", shard_bytes=40_000, roll_bytes=2_000).collect()
    assert sorted((r.file, r.sha256) for r in again) == sorted((r.file, r.sha256) for r in manifest)


def test_null_ids_follow_the_query_s_sql(spark, tmp_path):
    """Every copy refers to the smallest id, also where only one row has an id and the copies are many."""
    table = [(5, "u", LONG), *[(None, f"v{i % 3}", LONG) for i in range(40)], (None, None, LONG + "y"), (8, None, LONG + "z"), (None, None, "short"), (9, None, "short")]
    spark.createDataFrame([(i, u, h, "s", 1) for i, u, h in table], "page_id long, url string, html string, record_type string, shard int").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, op4_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(c.sql(ORACLES["op4_warc"]).fetchall(), key=str) and sum(g[3] == "revisit" for g in got) == 40
