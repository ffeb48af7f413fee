"""Deterministic sharded WARC writer and its reader.

Records are dealt to shards by ranges of their id, sorted within them, and written as one
gzip member each; a file is rolled when its compressed size passes ``roll_bytes``. Range
bounds come from exact sums of bytes in order of id, so shards are even however the ids are
spread, and the same table gives the same files whatever the cluster. Headers, lengths and SHA-256 digests are made anew.

A task writes under a temporary name and renames the file when it is complete. File names and
contents depend on the data alone, so a task that runs twice replaces its file with the same
bytes. The manifest, written last by Spark's own committer, is what makes files count:
readers open only what it lists.

Payloads that are null count as empty. Equal payloads of ``dedup_bytes`` or more are stored
once, in the record of the smallest id; the others are revisit records, those with a null id too. Where no copy
has an id there is none to refer to, and all are responses. Rows with a null id are dealt over all shards and
written last there. Rows that repeat an id stay, ordered by url and payload, in one shard; all that repeat the
smallest one are responses. A payload of any length is one record. Extra columns are not read. An
empty table makes an empty manifest.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

MOST_SHARDS = 100_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, bytes long, sha256 string, records long, shard int, first_id long, last_id long"
RECORDS = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, file string, offset long"


def record_id(id_: int | None, n: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{id_}:{n}')}>"


def _headers(fields: list[tuple[str, object]]) -> bytes:
    clean = lambda v: str(v).replace("\r", " ").replace("\n", " ")
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "replace")


def make_record(id_: int | None, url: str | None, payload: bytes, refers: tuple[int, str] | None, repeat: int, level: int) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(id_, repeat)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    if refers:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers[0])), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Row", refers[0])]
        if refers[1] is not None:
            fields.append(("WARC-Refers-To-Target-URI", refers[1]))
    if id_ is not None:
        fields.append(("X-Row", id_))
    fields += [("X-Payload-Length", len(payload)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(_headers(fields)) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


class _Shard:
    """One shard's current file; closed files are told as manifest rows."""

    def __init__(self, folder: str, shard: int, roll: int, level: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.level, self.seq, self.out = shard, roll, level, 0, None

    def add(self, id_, record: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.seq:06d}.warc.gz"
            self.temp = posixpath.join(self.folder, "_temporary", f"{uuid.uuid4().hex}-{self.name}")
            self.fs.create_dir(posixpath.dirname(self.temp), recursive=True)
            self.out, self.sha, self.bytes, self.records, self.first = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0, id_
            info = b"software: sheetlark\r\nformat: WARC File Format 1.1\r\n"
            pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
            head = _headers([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.shard * 1_000_000 + self.seq)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))])
            self._put(pack.compress(head + info + b"\r\n\r\n") + pack.flush())
        self._put(record)
        self.records, self.last = self.records + 1, id_
        if self.bytes >= self.roll:
            yield self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> tuple:
        self.out.close()
        final = posixpath.join(self.folder, self.name)
        there = self.fs.get_file_info(final)
        if there.type == pafs.FileType.File and there.size == self.bytes:
            self.fs.delete_file(self.temp)  # a lost attempt had come this far
        else:
            if there.type == pafs.FileType.File:
                self.fs.delete_file(final)
            self.fs.move(self.temp, final)
        self.out, self.seq = None, self.seq + 1
        return self.name, self.bytes, self.sha.hexdigest(), self.records, self.shard, self.first, self.last


def _bounds(meta: DataFrame, shard_bytes: int) -> list[int]:
    """First ids of the shards after the first: the ids at which the bytes so far, in order of id, pass a multiple of ``shard_bytes``.

    Sums are exact and depend on the data alone. The driver meets one sum a partition and one id
    a shard; beyond MOST_SHARDS shards, shards grow instead.
    """
    schema = pa.schema([("p", pa.int32()), ("id", pa.int64()), ("upto", pa.int64())])

    def run(batches):
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = total + np.cumsum(batch.column("n").to_numpy())
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), part), pa.int32()), batch.column("id"), pa.array(sums, pa.int64())], schema=schema)

    # rows of one id count as one, so that they stay in one shard whatever their order
    sizes = meta.where("id is not null").groupBy("id").agg(F.sum(F.col("bytes") + 500).alias("n"))
    summed = materialize(sizes.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(run, "p int, id long, upto long"), "warc-sums")
    ends = sorted((r.p, r.n) for r in summed.groupBy("p").agg(F.max("upto").alias("n")).collect())
    before, total = {}, 0
    for p, n in ends:
        before[p], total = total, total + n
    if total <= shard_bytes:
        return []
    each = max(shard_bytes, total // MOST_SHARDS + 1)
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("p"))
    # a shard's place in the order is where the row before its first one ends
    of = F.floor((F.col("upto") + offset - 1) / F.lit(each))
    return sorted(r.first for r in summed.groupBy(of.alias("s")).agg(F.min("id").alias("first")).collect())[1:]


def write_warc(pages: DataFrame, folder: str, *, id: str = "page_id", url: str = "url", payload: str = "html", shard_bytes: int = 64 << 20, roll_bytes: int = 8 << 20, dedup_bytes: int = 100, level: int = 6) -> DataFrame:
    """Write ``pages`` below ``folder`` and return the committed manifest."""
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    meta = materialize(rows.select("id", "url", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("bytes")), "warc-meta")
    bounds = pages.sparkSession.sparkContext.broadcast(np.array(_bounds(meta, shard_bytes), np.int64))
    n = len(bounds.value) + 1

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, ids.to_numpy(np.int64), "right").astype(np.int32))

    # rows without id are dealt by what they hold
    shard = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("url", "digest"), F.lit(n)).cast("int")).otherwise(place(F.coalesce("id", F.lit(0))))
    large = meta.where(F.col("bytes") >= dedup_bytes)
    first = large.groupBy("digest").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("m"), F.count("*").alias("copies")).where("copies > 1 AND m IS NOT NULL").select("digest", F.col("m.id").alias("to_id"), F.col("m.url").alias("to_url"))
    # a mark goes where the rows that it is for go: by their id, or by what they hold
    loose = F.col("id").isNull()
    marks = large.join(first, "digest").where(loose | (F.col("id") != F.col("to_id"))).select("id", F.lit(0).alias("kind"), F.when(loose, F.col("url")).alias("url"), F.unhex("digest").alias("payload"), "to_id", "to_url", F.when(loose, F.col("digest")).alias("digest")).distinct()
    full = rows.select("id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("to_id"), F.lit(None).cast("string").alias("to_url"), F.when(F.col("id").isNull(), F.sha2("payload", 256)).alias("digest"))
    dealt = full.unionByName(marks).withColumn("shard", shard).drop("digest").repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_last(), "kind", "url", "payload")
    schema = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("records", pa.int64()), ("shard", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64())])

    def run(batches):
        writer, done, marked, last, repeat = None, [], {}, None, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "id", "kind", "url", "to_id", "to_url")]
            payloads = batch.column("payload")
            for i, (s, id_, kind, url_, to_id, to_url) in enumerate(zip(*columns, strict=True)):
                if writer is None or writer.shard != s:
                    if writer and writer.out:
                        done.append(writer.close())
                    writer = _Shard(folder, s, roll_bytes, level)
                    marked, last, repeat = {}, id_, 0
                if id_ != last:
                    marked, last, repeat = {}, id_, 0
                body = payloads[i].as_py()
                if kind == 0:
                    marked[body] = (to_id, to_url)
                    continue
                refers = marked.get(hashlib.sha256(body).digest()) if marked else None
                done.extend(writer.add(id_, make_record(id_, url_, body, refers, repeat if id_ is not None else s << 40 | repeat, level)))
                repeat += 1
        if writer and writer.out:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else [[]] * len(schema), schema, strict=True)], schema=schema)

    dealt.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member."""
    view, at, step = memoryview(data), 0, 1 << 15
    while at < len(view):
        unpack, out, began = zlib.decompressobj(31), [], at
        while not unpack.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise ValueError("a gzip member ends early")
            out.append(unpack.decompress(piece))
            at += len(piece)
        at -= len(unpack.unused_data)
        yield began, b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_warc(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """Records of the files that the manifest lists; digests of blocks and payloads are checked."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, held, size = batch.column("file")[i].as_py(), [], 0
                for offset, raw in members(batch.column("content")[i].as_buffer()):
                    f, block = parse(raw)
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    if f"sha256:{hashlib.sha256(block).hexdigest()}" != f["WARC-Block-Digest"]:
                        raise ValueError(f"{name} at {offset}: the block's digest differs")
                    n, digest, body = int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha256:"), None
                    if f["WARC-Type"] == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                        if (len(body), hashlib.sha256(body).hexdigest()) != (n, digest):
                            raise ValueError(f"{name} at {offset}: the payload's digest differs")
                    number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                    held.append((number("X-Row"), f.get("WARC-Target-URI"), f["WARC-Type"], n, digest, number("X-Refers-To-Row"), body if payloads else None, name, offset))
                    size += len(raw)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema, strict=True)], schema=schema)

    return files.join(F.broadcast(manifest.select("file")) if _small(manifest) else manifest.select("file"), "file", "left_semi").mapInArrow(run, RECORDS)


def _small(manifest: DataFrame, most: int = 100_000) -> bool:
    """Whether the manifest has few enough files to be broadcast."""
    return manifest.limit(most + 1).count() <= most
