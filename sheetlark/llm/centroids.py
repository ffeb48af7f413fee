"""Centroid clustering by kd-tree filtering, exact in integers.

A vector's components become ``floor(scale * x)``. Centroids start as the ``k`` vectors whose
lower-case hex SHA-256 of ``seed:id`` is least, in that order; each round assigns every vector to its
nearest centroid (squared Euclidean distance, ties to the smaller number) and replaces every centroid that
has vectors by the floor of their mean; after the last round vectors are assigned once more.

1. The vectors of a partition are cut into blocks of ``BLOCK``. Each block becomes a kd-tree (halves at
   the median of the widest side, down to leaves of about ``LEAF`` vectors) whose nodes hold their box and
   their integer sums; counts follow from the ranges. Trees are written once, a row each.
2. In a round all nodes of a level are filtered together. A centroid is dropped for a node if
   another one is strictly nearer everywhere in the box, which its farthest corner decides; one
   that only ties stays. A node with one centroid left is assigned whole, by its sums; leaves with several
   are resolved vector by vector among those left.
3. Only a count and a sum for each centroid leave a task, and they meet in one small aggregate.

No vector moves after its tree is written, so a centroid that draws a third of all rows costs
nothing extra. The driver holds the ``k`` centroids.

Kept are vectors of ``dim`` components, none null or non-finite; all others give no row. A kept vector
with a component beyond ``common.MOST_UNITS`` has no exact 64-bit distance: it takes no part and its row
has a null cluster and distance. Repeated rows count as often as they come; of ids that tie for a start
the lesser vector goes first, and rows with a null id never start a centroid. With fewer than ``k`` vectors there are as many
centroids as vectors. Sums of distances beyond 64 bits are null. An empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, finite, floors, materialize, matrix

BLOCK, LEAF = 16_384, 32
STEP = 1 << 21  # numbers that the filter handles at once


class Tree:
    """A kd-tree over the rows of ``points``; node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, points: np.ndarray, order: np.ndarray, starts: np.ndarray, sums: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.points, self.order, self.starts, self.sums, self.low, self.high = points, order, starts, sums, low, high

    @property
    def inner(self) -> int:
        return len(self.starts) // 2

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        """``points`` are put in the order of the leaves; ``order`` tells the rows they come from."""
        n, dim = points.shape
        depth = max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))
        nodes = (2 << depth) - 1
        starts = np.zeros((nodes, 2), np.int32)
        low, high, sums = np.zeros((nodes, dim), np.int32), np.zeros((nodes, dim), np.int32), np.zeros((nodes, dim), np.int64)
        order = np.arange(n)
        starts[0] = 0, n
        for i in range(nodes):
            a, z = starts[i]
            own = points[order[a:z]]
            low[i], high[i], sums[i] = own.min(0), own.max(0), own.sum(0, dtype=np.int64)
            if 2 * i + 2 < nodes:
                half = (z - a) // 2
                axis = int(np.argmax(high[i].astype(np.int64) - low[i]))
                order[a:z] = order[a:z][np.argpartition(own[:, axis], half)]
                starts[2 * i + 1], starts[2 * i + 2] = (a, a + half), (a + half, z)
        return cls(points[order], order, starts, sums, low, high)

    def row(self) -> dict[str, bytes]:
        return {"points": self.points.astype("<i4").tobytes(), "starts": self.starts.astype("<i4").tobytes(), "sums": self.sums.astype("<i8").tobytes(), "low": self.low.astype("<i4").tobytes(), "high": self.high.astype("<i4").tobytes()}

    @classmethod
    def of_row(cls, row: dict[str, bytes], dim: int) -> Tree:
        read = lambda name, kind, width: np.frombuffer(row[name], kind).reshape(-1, width)
        return cls(read("points", "<i4", dim), None, read("starts", "<i4", 2), read("sums", "<i8", dim), read("low", "<i4", dim), read("high", "<i4", dim))


def undominated(low: np.ndarray, high: np.ndarray, centers: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Which active centers no other one beats strictly in the whole box, a row for each box."""
    out = np.empty_like(active)
    step = max(1, STEP // centers.size)
    for a in range(0, len(low), step):
        lo, hi, on = low[a : a + step].astype(np.int64), high[a : a + step].astype(np.int64), active[a : a + step]
        to_middle = ((2 * centers[None] - (lo + hi)[:, None]) ** 2).sum(2)
        best = np.where(on, to_middle, np.iinfo(np.int64).max).argmin(1)
        star = centers[best][:, None]
        apart = centers[None] - star
        corner = np.where(apart > 0, hi[:, None], lo[:, None])
        # distance to the center less that to the best one, where that is least
        out[a : a + step] = on & ((apart * (centers[None] + star - 2 * corner)).sum(2) <= 0)
    return out


def resolved(points: np.ndarray, centers: np.ndarray, active: np.ndarray) -> np.ndarray:
    """The nearest of its active centers for every point; ties go to the smaller number."""
    least, found = np.full(len(points), np.iinfo(np.int64).max), np.zeros(len(points), np.int32)
    for c, center in enumerate(centers):
        at = np.flatnonzero(active[:, c])
        d = ((points[at] - center) ** 2).sum(1)
        nearer = d < least[at]
        least[at[nearer]], found[at[nearer]] = d[nearer], c
    return found


def walk(tree: Tree, centers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """``(nodes, None, cluster of each)`` for nodes assigned whole, ``(leaves, points, cluster of each point)`` for the others."""
    nodes, active = np.zeros(1, np.int64), np.ones((1, len(centers)), bool)
    while len(nodes):
        active = undominated(tree.low[nodes], tree.high[nodes], centers, active)
        whole = active.sum(1) == 1
        yield nodes[whole], None, active[whole].argmax(1)
        leaf = ~whole & (nodes >= tree.inner)
        if leaf.any():
            ends = tree.starts[nodes[leaf]].astype(np.int64)
            at = np.concatenate([np.arange(a, z) for a, z in ends])
            held = np.repeat(active[leaf], ends[:, 1] - ends[:, 0], axis=0)
            yield nodes[leaf], at, resolved(tree.points[at].astype(np.int64), centers, held)
        going = ~whole & ~leaf
        nodes = np.concatenate([2 * nodes[going] + 1, 2 * nodes[going] + 2])
        active = np.concatenate([active[going], active[going]])


def totals(tree: Tree, centers: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
    """Add the tree's vectors to the counts and sums of their clusters."""
    for nodes, at, cluster in walk(tree, centers):
        if at is None:
            np.add.at(counts, cluster, (tree.starts[nodes, 1] - tree.starts[nodes, 0]).astype(np.int64))
            np.add.at(sums, cluster, tree.sums[nodes])
        else:
            counts += np.bincount(cluster, minlength=len(centers))
            for c in np.unique(cluster):
                sums[c] += tree.points[at[cluster == c]].sum(0, dtype=np.int64)


def assigned(tree: Tree, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of every point, in the tree's order."""
    out = np.zeros(len(tree.points), np.int32)
    for nodes, at, cluster in walk(tree, centers):
        if at is None:
            for (a, z), c in zip(tree.starts[nodes], cluster, strict=True):
                out[a:z] = c
        else:
            out[at] = cluster
    return out, ((tree.points.astype(np.int64) - centers[out]) ** 2).sum(1)


# ---------------------------------------------------------------- Spark jobs

TREES = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("starts", pa.binary()), ("sums", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
PARTIAL = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
ASSIGNED = pa.schema([("row_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def _trees(vectors: DataFrame, dim: int, block: int) -> DataFrame:
    def run(batches):
        ids, points, n = [], [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                some = batch.slice(a, block)
                if n + some.num_rows > block:
                    yield made(ids, points)
                    ids, points, n = [], [], 0
                ids.append(some.column("row_id"))
                points.append(matrix(some.column("q"), dim).astype(np.int32))
                n += some.num_rows
        if n:
            yield made(ids, points)

    def made(ids, points):
        tree = Tree.build(np.concatenate(points))
        held = pa.concat_arrays(ids).take(pa.array(tree.order))
        return pa.RecordBatch.from_pylist([{"ids": held.to_pylist(), **tree.row()}], schema=TREES)

    return materialize(vectors.mapInArrow(run, "ids array<bigint>, points binary, starts binary, sums binary, low binary, high binary"), "trees")


def _round(trees: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The centers after one round."""
    k, dim = centers.shape

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for row in batch.to_pylist():  # one row a tree
                totals(Tree.of_row(row, dim), centers, counts, sums)
        some = np.flatnonzero(counts)
        yield batch_of(PARTIAL, cluster=some.astype(np.int32), n=counts[some], sums=pa.array(sums[some].tolist(), pa.list_(pa.int64())))

    parts = trees.drop("ids").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(dim))).alias("sums"))
    out = centers.copy()
    for r in whole.collect():  # a row for each centroid
        out[r.cluster] = [s // r.n for s in r.sums]
    return out


def cluster(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1", block: int = BLOCK) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every kept vector."""
    spark = df.sparkSession
    kept = df.select(F.col(id).cast("long").alias("row_id"), F.col(vector).alias("v")).where(finite(F.col("v")) & (F.size("v") == dim))
    kept = materialize(kept.select("row_id", floors(F.col("v"), scale).alias("q")), "vectors")
    vectors = kept.where("q IS NOT NULL")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string")), 256)
    first = vectors.where("row_id IS NOT NULL").select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    centers = np.array([r.q for r in first], np.int64).reshape(-1, dim)
    if not first:
        return kept.select(F.col("row_id").alias(id), *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    trees = _trees(vectors, dim, block)
    for _ in range(rounds):
        centers = _round(trees, centers)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found, distance = assigned(Tree.of_row(row, dim), centers)
                yield batch_of(ASSIGNED, row_id=pa.array(row["ids"], pa.int64()), cluster=found, distance=distance)

    rows = materialize(trees.mapInArrow(run, "row_id bigint, cluster int, distance bigint"), "assigned")
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    digests = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centers[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    table = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    rows = rows.unionByName(kept.where("q IS NULL").select("row_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")))
    return rows.join(F.broadcast(table), "cluster", "left").select(F.col("row_id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
