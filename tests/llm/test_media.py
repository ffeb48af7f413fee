import hashlib
import os
import tarfile
import zlib

from sheetlark.llm import media
from sheetlark.llm.queries import op7_media

SF = "/root/testdata/sf0.001"


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.width, r.height, r.bit_depth) == (576, len(payload) // 576, 8)
        assert r.feature == media.feature(payload)
        image = media.encode_image(payload)
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())


def test_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(op7_media(spark, SF).collect(), texts)


def test_edges_and_shards(spark, tmp_path):
    texts = {1: None, 2: "", 3: "x" * 576, 4: "x" * 577, 5: "é" * 400_000, 6: "same", 7: "same", 8: "\x00"}
    df = spark.createDataFrame([(i, t, "q") for i, t in texts.items()], "doc_id long, text string, digest string").repartition(3)
    rows = media.media_columns(df, f"file://{tmp_path}", shard_bytes=3000).collect()
    check(rows, texts)
    by = {r.doc_id: r for r in rows}
    assert (by[6].shard, by[6].offset) == (by[7].shard, by[7].offset) and by[1].digest == by[2].digest
    for r in rows:
        with tarfile.open(os.path.join(tmp_path, r.shard)) as t:
            assert hashlib.sha256(t.extractfile(f"{r.digest}.png").read()).hexdigest() == r.digest
    heads = media.read_media(media.write_media(df, f"file://{tmp_path}"), f"file://{tmp_path}", features=False).collect()
    assert {(h.width, h.payload_bytes) for h in heads} == {(576, None)}
    assert media.media_columns(df.limit(0), f"file://{tmp_path}").collect() == []
    twice = df.where("doc_id = 6").union(df.where("doc_id = 6"))
    assert media.media_columns(twice, f"file://{tmp_path}").count() == 2
