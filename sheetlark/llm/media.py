"""Media columns: content-addressed payloads in tar shards, read back by ranges.

A payload becomes an 8-bit grey image of ``WIDTH`` columns, packed losslessly as PNG. Tasks
write tar shards of about ``shard_bytes``; a member is named by the SHA-256 of its bytes and
stored once per shard. A shard is written under a temporary name and renamed to the SHA-256
of its member list, so a task that runs twice leaves the same file. Rows carry the digest,
shard, offset and length; rows of equal content all point to the copy with the least
(shard, offset).

Reading takes each distinct content once: a range read of the tar and image headers fills the
metadata columns, and a second range read fetches the stored bytes for checks and features.

Null counts as an empty payload, and payloads are padded with 255 to a positive multiple of
``WIDTH``, so no image is empty; a very long text is one tall image. Equal rows get equal values, rows with a null id too; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, scratch_path, slices, text_buffer

WIDTH = 576
LEVEL = 6
BLOCK = 512
HEADER = 33  # PNG signature and IHDR chunk
_SIGNATURE = b"\x89PNG\r\n\x1a\n"

INDEX = "row_id long, n_bytes long, digest string, media_bytes long, shard string, offset long"
MEDIA = "digest string, shard string, offset long, width int, height int, bit_depth int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % WIDTH if text else WIDTH)


def encode_image(payload: bytes, level: int = LEVEL) -> bytes:
    """A grey PNG of WIDTH columns; every scan line has filter type 0."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def image_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not an image of ours")
    return struct.unpack(">IIB", head[16:25])


def decode_image(image: bytes) -> bytes:
    width, height, depth = image_header(image)
    at, packed = 8, []
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + data)) != image[at + 8 + n : at + 12 + n]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if depth != 8 or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit images are stored here")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Sum, sum of squares and a 16-bin histogram of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    bins = counts.reshape(16, 16).sum(1)
    return f"n={len(x)};sum={int(counts @ values)};sq={int(counts @ (values * values))};hist={','.join(map(str, bins.tolist()))}"


class _Shards:
    """Tar shards of one task; ``add`` returns the place of a content, ``close`` the finished shard's name."""

    def __init__(self, folder: str, most: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.most, self.out = most, None

    def add(self, digest: str, image: bytes) -> int:
        if self.out is None:
            self.temp = posixpath.join(self.folder, "_temporary", uuid.uuid4().hex)
            self.fs.create_dir(posixpath.dirname(self.temp), recursive=True)
            self.out, self.at, self.there = self.fs.open_output_stream(self.temp, compression=None), 0, {}
        if digest not in self.there:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + image + b"\0" * (-len(image) % BLOCK))
            self.there[digest] = self.at
            self.at += BLOCK + len(image) + -len(image) % BLOCK
        return self.there[digest]

    @property
    def full(self) -> bool:
        return self.out is not None and self.at >= self.most

    def close(self) -> str:
        self.out.write(b"\0" * (2 * BLOCK))
        self.out.close()
        name = f"{hashlib.sha256(' '.join(self.there).encode()).hexdigest()}.tar"
        final = posixpath.join(self.folder, name)
        if self.fs.get_file_info(final).type == pafs.FileType.File:
            self.fs.delete_file(self.temp)  # the same contents in the same order
        else:
            self.fs.move(self.temp, final)
        self.out = None
        return name


def write_media(df: DataFrame, folder: str, *, id: str = "doc_id", payload: str = "text", shard_bytes: int = 32 << 20, level: int = LEVEL) -> DataFrame:
    """Store the payloads of ``df`` below ``folder``; returns the index, one row per row of ``df``.

    Contents that several tasks met are in several shards; :func:`read_media` settles on one.
    """
    schema = pa.schema([("row_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("media_bytes", pa.int64()), ("shard", pa.string()), ("offset", pa.int64())])

    def run(batches):
        shards, held = _Shards(folder, shard_bytes), []

        def told(name):
            ids, sizes, digests, media, offsets = zip(*held, strict=True)
            held.clear()
            return batch_of(schema, row_id=ids, n_bytes=sizes, digest=digests, media_bytes=media, shard=[name] * len(ids), offset=offsets)

        for batch in batches:
            for part in slices(batch, "payload"):
                data, off = text_buffer(part.column("payload"))
                raw = data.tobytes()
                for id_, a, b in zip(part.column("row_id").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    image = encode_image(pad(raw[a:b]), level)
                    digest = hashlib.sha256(image).hexdigest()
                    held.append((id_, b - a, digest, len(image), shards.add(digest, image)))
                    if shards.full:
                        yield told(shards.close())
        if held:
            yield told(shards.close())

    rows = df.select(F.col(id).cast("long").alias("row_id"), F.col(payload).alias("payload"))
    return materialize(rows.mapInArrow(run, INDEX), "media-index")


def read_media(index: DataFrame, folder: str, *, features: bool = True) -> DataFrame:
    """Place, metadata columns and features of every distinct content that ``index`` points to.

    With ``features`` off only headers are read, and the columns taken from payloads are null.
    """
    schema = pa.schema([("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("bit_depth", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        shard, file = None, None
        for batch in batches:
            out = []
            for name, offset, n, digest in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "media_bytes", "digest")), strict=True):
                if name != shard:
                    if file:
                        file.close()
                    shard, file = name, fs.open_input_file(posixpath.join(root, name))
                head = file.read_at(BLOCK + HEADER, offset)
                member = tarfile.TarInfo.frombuf(head[:BLOCK], "utf-8", "strict")
                if (member.name, member.size) != (f"{digest}.png", n):
                    raise ValueError(f"{name} at {offset} holds {member.name}")
                width, height, depth = image_header(head[BLOCK:])
                if not features:
                    out.append((digest, name, offset, width, height, depth, None, None, None, None, None))
                    continue
                image = file.read_at(n, offset + BLOCK)
                sha = hashlib.sha256(image).hexdigest()
                if sha != digest:
                    raise ValueError(f"{name} at {offset}: the stored bytes' digest differs")
                payload = decode_image(image)
                out.append((digest, name, offset, width, height, depth, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), sha, feature(payload)))
            if out:
                yield batch_of(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))
        if file:
            file.close()

    distinct = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "media_bytes")).alias("place")).select("digest", "place.*")
    return distinct.repartition(F.col("shard"), F.floor(F.col("offset") / F.lit(4 << 20))).sortWithinPartitions("shard", "offset").mapInArrow(run, MEDIA)


def media_columns(df: DataFrame, folder: str | None = None, *, id: str = "doc_id", payload: str = "text", **options) -> DataFrame:
    """Store, read back and join: one row per row of ``df`` with its place, metadata and features."""
    folder = folder or scratch_path(df.sparkSession, "media")
    index = write_media(df, folder, id=id, payload=payload, **options)
    return index.drop("shard", "offset").join(read_media(index, folder), "digest").withColumnRenamed("row_id", id)
