"""What the operators share: scratch tables, Arrow text buffers, words, hashes.

The numpy helpers work on one slice of an Arrow batch at a time. Spark has already
partitioned the rows; a slice is bounded by ``SLICE_BYTES`` of text (or one document,
if that is longer), so a task's memory does not depend on the batch size.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

SLICE_BYTES = 4 << 20
MOST_BUCKETS = 50_000  # half of what Spark allows by default

_SCRATCH: list[str] = []
_TABLES: list[str] = []


# ---------------------------------------------------------------- scratch tables


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; unless ``keep`` is set, :func:`release` deletes it."""
    path = f"{shared_folder(spark)}/sheetlark/{name}-{uuid.uuid4().hex[:12]}"
    if not keep:
        _SCRATCH.append(path)
    return path


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here."""
    path = scratch_path(df.sparkSession, name, keep)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables made so far; results that still read them must be written by now."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _SCRATCH:
        delete(spark, _SCRATCH.pop())


def bucketed(df: DataFrame, n: int, column: str, name: str) -> DataFrame:
    """Write ``df`` as a table of ``n`` buckets, so that joins and co-groups by ``column`` leave it in place."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex[:12]}"
    df.repartition(n, column).write.option("compression", "zstd").bucketBy(n, column).saveAsTable(name)
    _TABLES.append(name)
    return spark.table(name)


def text_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0


def buckets_for(df: DataFrame, text: str, each: int = 64 << 20) -> int:
    """Buckets of about ``each`` bytes of text: a bucket is one task's, so their number follows the data."""
    return min(MOST_BUCKETS, max(partitions(df.sparkSession), text_bytes(df, text) // each + 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- Arrow text buffers


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``most`` bytes of text, or one row."""
    _, off = text_buffer(batch.column(column))
    first, n = 0, batch.num_rows
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


# ---------------------------------------------------------------- hashes

_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit values by rule: the finaliser over a counter."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed * 1_000_003)) * _U(BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS.get("p", ())):
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("p", BASE), ("i", _INVERSE)):
            a = np.full(size, base, _U)
            a[0] = 1
            _POWERS[key] = np.cumprod(a, dtype=_U)
    return _POWERS["p"], _POWERS["i"]


BYTE_VALUES = constants(11, 256)
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32  # A-Z hash as a-z
LONG_SPAN = 4096
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[32, *range(9, 14)]] = True


def prefix_hashes(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any span follows by :func:`span_hashes`."""
    powers, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(values[data] * powers[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling 64-bit hashes of byte spans; equal spans hash equally wherever they stand.

    Cheap for a span at every byte. Patterns that double and swap themselves can collide, so what
    must be told apart for certain goes by :func:`byte_hashes`.
    """
    _, inverse = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step, each step through the finaliser.

    All spans step together; those of more than LONG_SPAN bytes are hashed one by one.
    """
    lens = (ends - starts).astype(np.int64)
    out = mix(lens.astype(_U) ^ _U(BASE))
    if not len(data):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    for i in np.flatnonzero(lens > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    live = np.flatnonzero((lens > 0) & (lens <= LONG_SPAN))
    at, left, held = starts[live].astype(np.int64), lens[live], out[live]
    while len(live):
        cut = (8 * np.maximum(0, 8 - left)).astype(_U)
        held = mix((held ^ ((eight[at] << cut) >> cut)) * _U(BASE) + _U(0x2545F4914F6CDD1D))
        going = left > 8
        done = ~going
        out[live[done]] = held[done]
        live, at, left, held = live[going], at[going] + 8, left[going] - 8, held[going]
    return out


# ---------------------------------------------------------------- words


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each row its first word's index."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = SEPARATORS[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = True
    after[edges - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and the word offsets of the rows."""
    starts, ends, rows = word_spans(data, offsets)
    return byte_hashes(FOLDED[data], starts, ends), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size``-word shingles and their row offsets; a shorter row is one shingle of all its words."""
    counts = np.diff(rows)
    per_row = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_rows = np.concatenate([[0], np.cumsum(per_row)])
    out = np.empty(int(out_rows[-1]), _U)
    weights = constants(23, size)
    if len(words) >= size:
        every = words[: len(words) - size + 1] * weights[0]
        for j in range(1, size):
            every = every + words[j : len(words) - size + 1 + j] * weights[j]
    long = np.flatnonzero(counts >= size)
    if len(long):
        n = per_row[long]
        at = np.repeat(rows[long] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        to = np.repeat(out_rows[long] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        out[to] = every[at]
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        some = words[rows[r] : rows[r + 1]]
        out[out_rows[r]] = (some * weights[: len(some)]).sum(dtype=_U) + counts[r : r + 1].astype(_U)[0]
    return mix(out), out_rows


def distinct_in_rows(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, with new row offsets."""
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(rows)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def crc_bucket(column, n: int):
    """crc32 of a number written as text, modulo ``n``; null has no bucket."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


# ---------------------------------------------------------------- integer vectors

MOST_UNITS = 1 << 26  # of a component; sums of squares and of products then stay exact in 64 bits


def finite(vector):
    """Whether a vector is there and holds neither null nor non-finite components."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def floors(vector, scale: int):
    """``floor(scale * x)`` of every component as an integer; null where one is beyond ``MOST_UNITS``."""
    units = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when(F.forall(units, lambda u: F.abs(u) <= MOST_UNITS), units.cast("array<int>"))


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column, each of ``width`` numbers and none null, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
