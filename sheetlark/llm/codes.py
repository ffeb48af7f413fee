"""Vector code compression: product quantisation with exact codes from screened float32 products.

A vector's components become ``floor(scale * x)`` and are cut into ``parts`` equal consecutive
parts. Each position's codebook starts as that part of the ``entries`` vectors of least id; each round
assigns every part to the nearest entry (squared Euclidean distance, ties to the lower index) and
replaces every entry that is used by the floor of its parts' mean. Finally parts are assigned again.

Distances are screened, then settled: for a batch of parts x and all entries c, the product x.c is one
float32 matrix product. Its rounding error is at most g |x| |c| with g = (n + 2) u / (1 - (n + 2) u),
u = 2^-24 and n the width, whatever the order of summation; two of the n + 2 roundings are those of x and c themselves. The
score |c|^2 - 2 x.c, in float64, so has an interval that holds the true one. Entries whose interval
overlaps that of the least upper bound are worked out anew in int64; the least distance wins, then the lower
index. Mostly one entry is left, and equal entries always meet in int64.

A task sends one count and sum for each entry that it used; codebooks (``parts`` x ``entries``) are all
that the driver holds. Vectors stay where they are. Error sums by label meet in a plain join, which
Spark broadcasts if they turn out small and whose hot labels it splits otherwise.

Dropped are rows whose vector is null or holds null or non-finite components. A kept vector without
``dim`` components, or with one beyond ``common.MOST_UNITS``, has no code: its row has a null code and
error, and takes no part. Repeated rows are coded each; of equal ids the lesser vector goes first into the
codebook, null ids never do. With fewer vectors than ``entries`` the codebooks are as short as that.
Null labels count as one label. Sums of a label beyond 64 bits are null. An empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, finite, floors, materialize, matrix

ROWS = 4096  # parts screened at once
UNIT = 2.0**-24


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of ``book`` for every row of ``x``, the squared distance, and how many pairs were settled in int64."""
    n, width = x.shape
    found, distance, settled = np.zeros(n, np.int32), np.zeros(n, np.int64), 0
    gamma = (width + 2) * UNIT / (1 - (width + 2) * UNIT)
    squares = (book * book).sum(1).astype(np.float64)
    length = np.sqrt(squares) * (1 + 1e-12)
    narrow = np.ascontiguousarray(book.T, np.float32)
    for a in range(0, n, ROWS):
        part = x[a : a + ROWS]
        own = np.sqrt((part * part).sum(1).astype(np.float64)) * (1 + 1e-12)
        score = squares - 2.0 * (part.astype(np.float32) @ narrow).astype(np.float64)
        reach = own[:, None] * length
        # the float64 steps round too, each by less than 2^-52 of what it handles
        margin = 2.0 * gamma * reach + 2.0**-49 * (squares + 2.0 * reach)
        least = (score + margin).min(1)
        row, entry = np.nonzero(score - margin <= least[:, None])
        exact = ((part[row] - book[entry]) ** 2).sum(1)
        first = np.searchsorted(row, np.arange(len(part)))
        best = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == best[row])
        at = hit[np.searchsorted(row[hit], np.arange(len(part)))]  # entries ascend within a row
        found[a : a + ROWS], distance[a : a + ROWS] = entry[at], best
        settled += len(row)
    return found, distance, settled


PARTIAL = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
CODED = pa.schema([("row_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])


def _cut(batch: pa.RecordBatch, books: np.ndarray) -> np.ndarray:
    parts, _, width = books.shape
    return matrix(batch.column("q"), parts * width).astype(np.int64).reshape(-1, parts, width)


def _round(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape

    def run(batches):
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = _cut(batch, books)
            for p in range(parts if len(x) else 0):
                index, _, _ = nearest(x[:, p], books[p])
                counts[p] += np.bincount(index, minlength=entries)
                np.add.at(sums[p], index, x[:, p])
        part, entry = np.nonzero(counts)
        yield batch_of(PARTIAL, part=part.astype(np.int32), entry=entry.astype(np.int32), n=counts[part, entry], sums=pa.array(sums[part, entry].tolist(), pa.list_(pa.int64())))

    sent = vectors.select("q").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    whole = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))
    out = books.copy()
    for r in whole.collect():  # a row for each entry
        out[r.part, r.entry] = [s // r.n for s in r.sums]
    return out


def compress(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", dim: int = 64, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` for every kept vector; ``entries`` is at most 256, two hex digits each."""
    if dim % parts or not 0 < entries <= 256:
        raise ValueError("dim must be a multiple of parts, and entries at most 256")
    kept = df.select(F.col(id).cast("long").alias("row_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")).where(finite(F.col("v")))
    kept = materialize(kept.select("row_id", "label", F.when(F.size("v") == dim, floors(F.col("v"), scale)).alias("q")), "vectors")
    vectors = kept.where("q IS NOT NULL")
    first = vectors.where("row_id IS NOT NULL").select("row_id", "q").orderBy("row_id", "q").limit(entries).collect()
    books = np.array([r.q for r in first], np.int64).reshape(-1, parts, dim // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        books = _round(vectors, books)

    def run(batches):
        for batch in batches:
            x = _cut(batch, books)
            if len(x):
                pairs = [nearest(x[:, p], books[p])[:2] for p in range(parts)]
                codes = np.stack([index for index, _ in pairs], 1).astype(np.uint8)
                yield batch_of(CODED, row_id=batch.column("row_id"), label=batch.column("label"), code=pa.array([c.tobytes().hex() for c in codes]), error=sum(d for _, d in pairs))

    none = lambda rows: rows.select("row_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = none(kept.where("q IS NULL" if first else "true"))
    if first:
        coded = materialize(vectors.mapInArrow(run, "row_id bigint, label bigint, code string, error bigint"), "coded").unionByName(coded)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    sums = coded.groupBy("label").agg(F.expr("try_cast(sum(CAST(error AS DECIMAL(38,0))) AS BIGINT)").alias("label_error")).withColumnRenamed("label", "l")
    rows = coded.join(sums, F.col("label").eqNullSafe(F.col("l")), "left")
    return rows.select(F.col("row_id").alias(id), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
