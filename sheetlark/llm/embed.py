"""Embedding near-dedup by collision-counting projections.

Vectors of one label are compared by cosine. Each normalised vector gets ``axes`` projections
that place it and ``projections`` that are counted, all on fixed Gaussian directions. Two unit
vectors at cosine c are sqrt(2 - 2c) apart, so their projections differ by a normal variable of
that width: a query-centred window of ``WINDOW`` widths meets a pair at the threshold with known
probability. A pair that collides in at least ``needed`` windows is verified; ``needed`` is
calibrated so that a pair at the threshold is lost with probability below ``miss``.

1. The vectors are range-sorted by label, cells of the first axes and the last axis. Equal
   vectors then stand together and collapse to the one of the smallest id, with their number;
   the rest is cut into blocks of ``block`` vectors, so a large label or cell is many blocks
   and no group is whole anywhere. There are more axes where the largest label has more rows.
2. Blocks of the same or neighbouring cells whose last axis comes within the window are paired
   by their numbers alone. Blocks that follow each other make bundles, and what is sent is bundles in pairs: a vector goes to
   as many tasks as there are bundles near its own, not blocks. Bundles grow with the largest label (an eighth of it, up to
   ``MOST_BUNDLE_BYTES``, which bounds a task's memory). (The windows on axes are ``AXIS_WINDOW`` widths, which a pair leaves
   with probability below 1e-8 an axis.)
3. Inside a pair of blocks every counted projection of one block is sorted; the window around
   each vector of the other is a range of that order, which prefix sets of rows turn into the
   set of vectors met. Sets of all projections are added up bit by bit, and the pairs that pass
   are verified in double precision. Only link counts per vector and a spanning forest of the
   links leave the task, never pairs of a group.
4. Link counts are summed, and components come from the forests and the equal vectors.

Vectors that are null, zero, or hold null or non-finite components, and vectors without label,
link with nothing. Only vectors of equal length are compared. Rows with a null id link with
nothing; rows that repeat an id are one vertex, and each counts in its neighbours' links (where
their vectors differ, the id has the greatest of their counts). An empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize
from .graph import components

THRESHOLD, PROJECTIONS, MISS, BLOCK = 0.98, 24, 1e-8, 2048
WINDOW, AXIS_WINDOW, MOST_AXES = 2.0, 6.0, 5
BUNDLES, MOST_BUNDLE_BYTES = 8, 32 << 20
SEED = 20_240


def directions(dim: int, n: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed + dim).standard_normal((dim, n))


def needed_collisions(n: int, window: float, miss: float) -> int:
    """The largest count that a pair at the threshold reaches with probability 1 - ``miss``."""
    p = math.erf(window / math.sqrt(2))
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > miss:
            return k
    return n


def _usable(df: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """Rows that can link; single-precision vectors stay so until they are compared."""
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    fine = F.col(id).isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0)
    fine &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(fine).select(F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"))


def _matrix(column) -> list[np.ndarray]:
    flat = column.flatten().to_numpy()
    off = np.asarray(column.offsets)
    return [flat[a:b] for a, b in zip(off[:-1] - off[0], off[1:] - off[0], strict=True)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes_for(rows: int, block: int) -> int:
    """Axes so that a cell of the largest label holds about a block: an axis has some five cells."""
    return min(MOST_AXES, 1 + max(0, math.ceil(math.log(max(1, rows / block), 5))))


def bundle_for(rows: int, block: int) -> int:
    """Vectors in a bundle: some ``BUNDLES`` bundles for the largest label, none smaller than a block."""
    return max(block, -(-rows // BUNDLES))


def _blocks(rows: DataFrame, width: float, block: int, axes: int, bundle: int) -> DataFrame:
    """Blocks of vectors near each other on the axes, and rows without block number that tell equal vectors.

    ``ids``, ``numbers`` and ``vectors`` are those of a block's distinct vectors. Where ``no`` is
    null, ``ids`` are equal to the vector of ``rep``.
    """
    placed_schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("cell", pa.list_(pa.int64())), ("y", pa.float64()), ("v", pa.binary())])

    def place(batches):
        for batch in batches:
            vectors = _matrix(batch.column("v"))
            dims = np.array([len(v) for v in vectors])
            cell, y = np.zeros((len(dims), axes - 1), np.int64), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                some = np.flatnonzero(dims == d)
                p = _unit(np.stack([vectors[i] for i in some])) @ directions(d, axes, SEED + 1)
                cell[some], y[some] = np.floor(p[:, :-1] / (AXIS_WINDOW * width)), p[:, -1]
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1) * (axes - 1), pa.int32()), pa.array(cell.reshape(-1)))
            yield batch_of(placed_schema, id=batch.column("id"), label=batch.column("label"), dim=dims, cell=cells, y=y, v=[v.tobytes() for v in vectors])

    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.list_(pa.int64())), ("lo", pa.float64()), ("hi", pa.float64()), ("rep", pa.int64()), ("bundle", pa.int64()), ("ids", pa.binary()), ("numbers", pa.binary()), ("vectors", pa.binary())])

    def cut(batches):
        held: list[list] = []  # distinct vectors: id, y, bytes, number
        equal: list[int] = []
        key = None
        number, size, of = TaskContext.get().partitionId() << 32, 0, None  # of the bundle that takes the next block

        def told():
            nonlocal number, size, of
            label, dim, cell = key
            if of != (label, dim) or size + len(held) > min(bundle, MOST_BUNDLE_BYTES // len(held[0][2])):
                number, size, of = number + 1, 0, (label, dim)
            size += len(held)
            ids, numbers = (np.array([x[k] for x in held], np.int64).tobytes() for k in (0, 3))
            return batch_of(schema, label=[label], dim=[dim], cell=[list(cell)], lo=[held[0][1]], hi=[held[-1][1]], rep=pa.array([None], pa.int64()), bundle=[number], ids=[ids], numbers=[numbers], vectors=[b"".join(x[2] for x in held)])

        def told_equal():
            out = batch_of(schema, label=pa.array([None], pa.string()), dim=pa.array([None], pa.int32()), cell=pa.array([None], pa.list_(pa.int64())), lo=pa.array([None], pa.float64()), hi=pa.array([None], pa.float64()), rep=[held[-1][0]], bundle=pa.array([None], pa.int64()), ids=[np.array(equal, np.int64).tobytes()], numbers=[b""], vectors=[b""])
            equal.clear()
            return out

        for batch in batches:
            for id_, label, dim, cell, y, v in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "dim", "cell", "y", "v")), strict=True):
                here = (label, dim, tuple(cell))
                if held and here == key and held[-1][2] == v:
                    held[-1][3] += 1
                    equal.append(id_)
                    if len(equal) >= 50_000:
                        yield told_equal()
                    continue
                if equal:
                    yield told_equal()
                if held and (key != here or len(held) >= block):
                    yield told()
                    held.clear()
                key = here
                held.append([id_, y, v, 1])
        if equal:
            yield told_equal()
        if held:
            yield told()

    placed = rows.mapInArrow(place, "id long, label string, dim int, cell array<long>, y double, v binary")
    order = ("label", "dim", "cell", "y", "v", "id")
    # bounds by the id as well: equal vectors of a hot group go to several tasks
    made = placed.repartitionByRange("label", "dim", "cell", "y", "id").sortWithinPartitions(*order)
    made = made.mapInArrow(cut, "label string, dim int, cell array<long>, lo double, hi double, rep long, bundle long, ids binary, numbers binary, vectors binary")
    return materialize(made.withColumn("no", F.when(F.col("rep").isNull(), F.monotonically_increasing_id())), "blocks")


def collisions(a: np.ndarray, b: np.ndarray, reach: float, needed: int) -> np.ndarray:
    """Which rows of two matrices of projections lie within ``reach`` of each other in ``needed`` columns or more.

    Each column of ``b`` is sorted once. The window around a row of ``a`` is a range of that
    order, and the rows in it are the difference of two prefix sets; the sets are added up as
    binary counters of one bit a pair.
    """
    n, k, m = len(a), len(b), a.shape[1]
    words = -(-k // 64)
    planes = [np.zeros((n, words), np.uint64) for _ in range(m.bit_length())]
    for j in range(m):
        order = np.argsort(b[:, j], kind="stable")
        ranked = b[order, j]
        prefix = np.zeros((k + 1, words), np.uint64)
        prefix[np.arange(1, k + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
        np.bitwise_xor.accumulate(prefix, axis=0, out=prefix)
        met = prefix[np.searchsorted(ranked, a[:, j] + reach, "right")] ^ prefix[np.searchsorted(ranked, a[:, j] - reach, "left")]
        for i, plane in enumerate(planes):
            planes[i], met = plane ^ met, plane & met
    more, same = np.zeros((n, words), np.uint64), np.full((n, words), np.iinfo(np.uint64).max)
    for i in reversed(range(len(planes))):
        if needed >> i & 1:
            same &= planes[i]
        else:
            more |= same & planes[i]
            same &= ~planes[i]
    return np.unpackbits((more | same).view(np.uint8), axis=1, bitorder="little")[:, :k].astype(bool)


def linked(a: np.ndarray, b: np.ndarray, threshold: float, projections: int, needed: int, width: float) -> np.ndarray:
    """Boolean matrix of the links between the rows of two matrices of vectors."""
    ua, ub = _unit(a), _unit(b)
    d = directions(a.shape[1], projections)
    passed = collisions(ua @ d, ub @ d, WINDOW * width, needed)
    rows, cols = np.flatnonzero(passed.any(1)), np.flatnonzero(passed.any(0))
    out = np.zeros(passed.shape, bool)
    if len(rows):
        out[np.ix_(rows, cols)] = (ua[rows] @ ub[cols].T >= threshold) & passed[np.ix_(rows, cols)]
    return out


def _forest(link: np.ndarray, ids: np.ndarray, other: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect what ``link`` connects: breadth-first over its rows and columns."""
    a: list[int] = []
    b: list[int] = []
    rows_left, cols_left = link.any(1), link.any(0)
    for start in np.flatnonzero(rows_left).tolist():
        if not rows_left[start]:
            continue
        frontier = np.array([start])
        rows_left[start] = False
        while len(frontier):
            new = np.zeros(link.shape[1], bool)
            for r in frontier.tolist():
                hit = np.flatnonzero(link[r] & cols_left)
                cols_left[hit] = False
                new[hit] = True
                a.extend([int(ids[r])] * len(hit))
                b.extend(other[hit].tolist())
            nxt = []
            for c in np.flatnonzero(new).tolist():
                hit = np.flatnonzero(link[:, c] & rows_left)
                rows_left[hit] = False
                nxt.append(hit)
                a.extend(ids[hit].tolist())
                b.extend([int(other[c])] * len(hit))
            frontier = np.concatenate(nxt) if nxt else np.zeros(0, np.int64)
    return a, b


def _pairs(blocks: DataFrame, width: float, axes: int) -> DataFrame:
    """Numbers ``(no, no_b)`` of blocks that may hold links, each pair once, with their bundles; vectors are not touched."""
    meta = blocks.where("no is not null").select("label", "dim", "cell", "lo", "hi", "no", "bundle")
    # of two opposite steps to a neighbouring cell only one is taken
    steps = [s for s in itertools.product((-1, 0, 1), repeat=axes - 1) if s >= (0,) * (axes - 1)]
    moved = F.array(*(F.struct(F.array(*(F.col("cell")[i] + x for i, x in enumerate(s))).cast("array<long>").alias("cell"), F.lit(any(s)).alias("other")) for s in steps))
    near = meta.select("label", "dim", F.explode(moved).alias("m"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.col("no").alias("no_b"), F.col("bundle").alias("bundle_b")).select("label", "dim", "m.*", "lo_b", "hi_b", "no_b", "bundle_b")
    reach = AXIS_WINDOW * width
    close = (F.col("lo") <= F.col("hi_b") + reach) & (F.col("lo_b") <= F.col("hi") + reach)
    return meta.join(near, ["label", "dim", "cell"]).where(close & (F.col("other") | (F.col("no") <= F.col("no_b")))).select("no", "no_b", "bundle", "bundle_b")


def _sent(pairs: DataFrame) -> DataFrame:
    """``(first, second, of, role)``: the bundles ``of`` that go to each pair of bundles, once to a pair of its own."""
    both = pairs.select(F.least("bundle", "bundle_b").alias("first"), F.greatest("bundle", "bundle_b").alias("second")).distinct()
    roles = F.array_distinct(F.array(F.struct(F.col("first").alias("of"), F.lit(0).alias("role")), F.struct(F.col("second").alias("of"), (F.col("first") != F.col("second")).cast("int").alias("role"))))
    return both.select("first", "second", F.explode(roles).alias("r")).select("first", "second", "r.*")


def near_duplicates(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, projections: int = PROJECTIONS, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row per row of ``df``."""
    width = math.sqrt(2 - 2 * threshold)
    needed = needed_collisions(projections, WINDOW, miss)
    rows = _usable(df, id, vector, label)
    kind = np.float32 if rows.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    largest = df.groupBy(label).count().agg(F.max("count")).first()[0] or 0
    axes, bundle = axes_for(largest, block), bundle_for(largest, block)
    blocks = _blocks(rows, width, block, axes, bundle)
    sent = _sent(_pairs(blocks, width, axes)).join(blocks.where("no is not null").select(F.col("bundle").alias("of"), "no", "dim", "cell", "lo", "hi", "ids", "numbers", "vectors"), "of").drop("of")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def met(first, second):
        ids, numbers, x = first
        other, their, y = second or first
        link = linked(x, y, threshold, projections, needed, width)
        if second is None:
            np.fill_diagonal(link, False)
        count = link @ their
        who, n = (ids, count) if second else (ids, count + numbers - 1)
        if second:
            who, n = np.concatenate([who, other]), np.concatenate([n, link.T @ numbers])
        fa, fb = _forest(link, ids, other)
        some = n > 0
        return batch_of(schema, a=np.concatenate([who[some], np.array(fa, np.int64)]), b=pa.array([None] * int(some.sum()) + fb, pa.int64()), n=np.concatenate([n[some], np.zeros(len(fa), np.int64)]))

    def together(first, second):
        """The links between blocks of two bundles, or of one where ``second`` is empty."""
        for i, (meta, block_) in enumerate(first):
            if second:
                cells, lows, highs = (np.array([m[k] for m, _ in second]) for k in range(3))
            else:
                cells, lows, highs = (np.array([m[k] for m, _ in first[i:]]) for k in range(3))
            near = (np.abs(cells - np.array(meta[0])) <= 1).reshape(len(lows), -1).all(1) & (lows <= meta[2] + reach) & (highs >= meta[1] - reach)
            for j in np.flatnonzero(near).tolist():
                if second:
                    yield met(block_, second[j][1])
                else:
                    yield met(block_, None if j == 0 else first[i + j][1])

    def run(batches):
        sides, key = ([], []), None
        for batch in batches:
            for i in range(batch.num_rows):
                col = {c: batch.column(c)[i].as_py() for c in ("first", "second", "role", "dim", "cell", "lo", "hi", "ids", "numbers", "vectors")}
                if key != (col["first"], col["second"]):
                    yield from together(*sides)
                    sides, key = ([], []), (col["first"], col["second"])
                mine = (np.frombuffer(col["ids"], np.int64), np.frombuffer(col["numbers"], np.int64), np.frombuffer(col["vectors"], kind).reshape(-1, col["dim"]))
                sides[col["role"]].append(((col["cell"], col["lo"], col["hi"]), mine))
        yield from together(*sides)

    reach = AXIS_WINDOW * width
    spread = sent.repartition("first", "second").sortWithinPartitions("first", "second", "role", "no")
    found = materialize(spread.mapInArrow(run, "a long, b long, n long"), "block-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    schema_equal = pa.schema([("id", pa.int64()), ("rep", pa.int64())])

    def each(batches):
        for batch in batches:
            for rep, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(ids, np.int64)
                yield batch_of(schema_equal, id=ids, rep=np.full(len(ids), rep))

    equal = blocks.where("no is null").select("rep", "ids").mapInArrow(each, "id long, rep long")
    counts = counts.unionByName(equal.join(counts.withColumnRenamed("a", "rep"), "rep").select(F.col("id").alias("a"), "n"))
    counts = counts.groupBy("a").agg(F.max("n").alias("n")).withColumnRenamed("a", id)
    classes = components(found.where("b is not null").select("a", "b").unionByName(equal.select(F.col("id").alias("a"), F.col("rep").alias("b")))).withColumnRenamed("id", id)
    whole = df.select(F.col(id).cast("long").alias(id)).join(counts, id, "left").join(classes, id, "left")
    component = F.coalesce("component_id", id)
    return whole.select(id, F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col(id).eqNullSafe(component).alias("kept"))
