"""MinHash near-dedup with tensored banding.

Two small collections of ``halves`` half-keys each, every half-key made of ``rows``
minhashes, stand in for halves^2 independent tables: table (i, j) is keyed by half-key i
of the first collection with half-key j of the second. 2 * halves * rows minhashes serve
halves^2 tables, a square root of what separate tables would need. With the defaults a
pair at similarity s is missed with probability below 2 * (1 - s^2)^16: 3.6e-6 at 0.75,
1.6e-7 at 0.8; where two shared tables are asked for (:func:`least_tables`), about 1.4e-9 more.

Steps, none of which gathers a group in one task:

1. Documents with equal shingle sets collapse to the smallest id (a partial aggregate).
2. A half-key that only one set has can be in no common table, so only shared half-keys
   are kept; their products are the table keys.
3. Round one verifies each set against the smallest set of each of its buckets. What is
   confirmed is contracted to classes.
4. Round two compares, bucket by bucket, only sets of different classes. Buckets of up to
   ``block`` such sets yield their cross pairs, and a pair is verified that shares as many
   tables as :func:`least_tables` asks for. Larger ones go the exact way: sets at
   Jaccard >= t share one of their first (1 - t) * n + 1 shingles under any one order, here
   with the most common shingles last, so only sets that share such a shingle, at ranks that
   leave enough behind it, are paired.
5. Every link is confirmed by intersecting full shingle sets; pairs whose sizes rule them out
   are left out before.

Rows without words (or with null text) have empty sets and link with nothing. Rows with a
null id link with nothing and stay. A repeated id is one vertex. Texts of any length are read whole;
ties (equal sets) go to the smallest id. An empty table gives no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, constants, distinct_in_rows, materialize, mix, shingle_hashes, signed, slices, text_buffer, word_hashes
from .graph import components

SHINGLE, HALVES, ROWS, BLOCK = 5, 16, 2, 64
MOST_COMMON = 1_000_000  # shingles that are broadcast as common ones: 8 MB


def half_keys(shingles: np.ndarray, rows: np.ndarray, halves: int, width: int) -> np.ndarray:
    """For each non-empty row its 2 * halves half-keys."""
    full = np.flatnonzero(np.diff(rows) > 0)
    n = 2 * halves * width
    mult, add = constants(31, n) | np.uint64(1), constants(37, n)
    out = np.zeros((len(full), 2 * halves), np.uint64)
    if len(full):
        for k in range(n):
            least = np.minimum.reduceat((shingles * mult[k] + add[k]) >> np.uint64(1), rows[full])
            out[:, k // width] = out[:, k // width] * np.uint64(0x9E3779B97F4A7C15) + mix(least)
        out = mix(out + constants(41, 2 * halves))
    return out


def least_tables(halves: int, width: int, percent: int) -> int:
    """Tables that a pair must share to be a candidate: two where that loses next to nothing, else one.

    Half-keys in common are binomial in each collection and tables in common their product. Two
    are asked for if pairs at the threshold with just one are under a hundredth of those with none.
    """
    p = (percent / 100) ** width
    none, one = (1 - p) ** halves, halves * p * (1 - p) ** (halves - 1)
    return 2 if one * one <= 0.01 * (2 * none - none * none) else 1


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach ``percent`` of their union."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def signatures(df: DataFrame, *, id: str, text: str, size: int, halves: int, width: int) -> DataFrame:
    """``(id, n_shingles, set_hash, keys array<long>)`` of whole texts."""
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s, rows = distinct_in_rows(*shingle_hashes(*word_hashes(*text_buffer(part.column("text"))), size))
                full = np.diff(rows) > 0
                keys = half_keys(s, rows, halves, width)
                sums = np.concatenate([[0], np.cumsum(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)]).astype(np.uint64)
                whole = mix(sums[rows[1:]] - sums[rows[:-1]] + np.diff(rows).astype(np.uint64))
                at = np.concatenate([[0], np.cumsum(full)]) * 2 * halves
                yield batch_of(schema, id=part.column("id"), n_shingles=np.diff(rows), set_hash=signed(whole), keys=pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(signed(keys.reshape(-1)))))

    return df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n_shingles long, set_hash long, keys array<long>")


def shingle_sets(df: DataFrame, *, id: str, text: str, size: int) -> DataFrame:
    """``(id, s array<long>)``: the distinct shingles of whole texts, ascending."""
    schema = pa.schema([("id", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s, rows = distinct_in_rows(*shingle_hashes(*word_hashes(*text_buffer(part.column("text"))), size))
                yield batch_of(schema, id=part.column("id"), s=pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(signed(s))))

    return df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, s array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach ``percent`` of their union."""
    sa, sb = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(sa, "a").join(sb, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def links(df: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = 75, halves: int = HALVES, width: int = ROWS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(id, n_shingles)`` per row, and links ``(a, b)`` that join what belongs together."""
    sig = materialize(signatures(df, id=id, text=text, size=size, halves=halves, width=width), "signatures")
    per_row = sig.select(F.col("id").alias(id), "n_shingles")
    sets_of = sig.where("n_shingles > 0 and id is not null")
    first = sets_of.groupBy("set_hash", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    same = materialize(sets_of.select("id", "set_hash", "n_shingles").join(first.where("n > 1"), ["set_hash", "n_shingles"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")), "same")
    reps = sets_of.join(same.select(F.col("a").alias("id")).distinct(), "id", "left_anti").select("id", "n_shingles", "keys")

    half = reps.select("id", "n_shingles", F.posexplode("keys").alias("i", "h"))
    shared = half.groupBy("i", "h").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("i", "h")
    kept = materialize(half.join(shared, ["i", "h"], "left_semi").groupBy("id", "n_shingles").agg(F.collect_list(F.when(F.col("i") < halves, F.struct("i", "h"))).alias("u"), F.collect_list(F.when(F.col("i") >= halves, F.struct("i", "h"))).alias("v")).where("size(u) > 0 and size(v) > 0"), "halves")
    keys = kept.select("id", "n_shingles", F.explode("u").alias("u"), "v").select("id", "n_shingles", "u", F.explode("v").alias("v")).select("id", F.col("n_shingles").alias("m"), F.xxhash64("u.i", "u.h", "v.i", "v.h").alias("key"))
    buckets = keys.groupBy("key").agg(F.min(F.struct("id", "m")).alias("l"), F.max("id").alias("most")).where("l.id <> most").select("key", F.col("l.id").alias("least"), F.col("l.m").alias("least_m"))
    table = materialize(keys.join(buckets, "key").select("key", "least", "least_m", "id", "m").distinct(), "tables")

    ids = table.select("id").distinct()
    chosen = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi").dropDuplicates(["id"])
    sets = materialize(shingle_sets(chosen, id="id", text="text", size=size), "sets")
    # sizes alone rule many pairs out before any set moves
    star = table.where((F.col("id") != F.col("least")) & _alike(F.col("m"), F.col("least_m"), percent)).select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    one = materialize(confirmed(star, sets, percent), "stars")

    classes = components(one).select("id", F.col("component_id").alias("class"))
    placed = table.select("key", "id", "m").join(classes, "id", "left").select("key", "id", "m", F.coalesce("class", "id").alias("class"))
    open_ = placed.groupBy("key").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.count("*").alias("n")).where("c0 <> c1").select("key", "n")
    rest = materialize(placed.join(open_, "key"), "open")
    few = rest.where(F.col("n") <= block).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "class", "m"))).alias("s"))
    later = F.filter("s", lambda y: (y["id"] > F.col("x.id")) & (y["class"] != F.col("x.class")) & _alike(y["m"], F.col("x.m"), percent))
    small = few.select(F.explode("s").alias("x"), "s").select("x", F.explode(later).alias("y"))
    needed = least_tables(halves, width, percent)
    # a pair may share one small and one large bucket: whoever is in several stays in the large ones
    cross = small.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).groupBy("a", "b").agg(F.count("*").alias("k")).where(F.col("k") >= needed).select("a", "b")
    large = rest.where(F.col("n") > block).select("id", "class").distinct()
    if needed > 1:
        large = large.join(rest.groupBy("id").agg(F.count("*").alias("open")).where(F.col("open") >= needed).select("id"), "id", "left_semi")
    if not large.isEmpty():
        cross = cross.unionByName(_by_rare_shingles(large, sets, percent))
    two = materialize(confirmed(cross.distinct().join(star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti"), sets, percent), "crossed")
    return per_row, same.unionByName(one).unionByName(two)


def _common_shingles(members: DataFrame, share: float) -> np.ndarray:
    """Shingles that about ``share`` of the members or more hold; at most their mean set size / ``share``.

    Counts below two in a task are not told. The list only orders shingles, so results do not depend on it.
    """
    schema = pa.schema([("s", pa.int64()), ("c", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held, size, rows = [], 0, 0

        def told():
            s, c = np.unique(np.concatenate(held), return_counts=True)
            s, c = s[c > 1], c[c > 1]
            return batch_of(schema, s=s, c=c, n=np.zeros(len(s), np.int64))

        for batch in batches:
            held.append(batch.column("s").flatten().to_numpy())
            size, rows = size + len(held[-1]), rows + batch.num_rows
            if size > 2_000_000:
                yield told()
                held, size = [], 0
        if held:
            yield told()
        yield batch_of(schema, s=pa.array([None], pa.int64()), c=[0], n=[rows])

    counted = materialize(members.select("s").mapInArrow(run, "s long, c long, n long").groupBy("s").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "common")
    total = counted.where("s is null").agg(F.sum("n")).first()[0] or 0
    # any set would do, so long as it is one: the most frequent shingles first, as many as a task can hold
    found = counted.where(F.col("s").isNotNull() & (F.col("c") >= share * total)).orderBy(F.desc("c"), "s").limit(MOST_COMMON)
    return np.array(sorted(r.s for r in found.select("s").collect()), np.int64)


def _by_rare_shingles(large: DataFrame, sets: DataFrame, percent: int, share: float = 0.02) -> DataFrame:
    """Pairs of different classes in large buckets that can reach ``percent``: exact, by prefix and position.

    Shingles stand in one order, common ones last. For a pair with the smaller set of n and the
    larger of m shingles, the first common shingle must be among the first
    n - ceil(2t / (1 + t) * n) + 1 of the smaller and the first m - ceil(t * m) + 1 of the larger,
    and what stands behind it in both must suffice for the overlap t / (1 + t) * (n + m).
    """
    members = materialize(large.join(sets, "id"), "members")
    common = members.sparkSession.sparkContext.broadcast(_common_shingles(members, share))
    schema = pa.schema([("id", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("r", pa.int64())])

    def run(batches):
        for batch in batches:
            values, off = batch.column("s").flatten().to_numpy(), np.asarray(batch.column("s").offsets)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(off))
            order = np.lexsort((values, np.isin(values, common.value), owner))  # rows stay together
            n = np.diff(off).astype(np.int64)
            rank = np.arange(len(values)) - (off[:-1] - off[0])[owner] + 1
            first = rank <= (n - -(-n * percent // 100) + 1)[owner]
            keep = owner[first]
            ids, classes = batch.column("id").to_numpy(), batch.column("class").to_numpy()
            yield batch_of(schema, id=ids[keep], **{"class": classes[keep]}, n=n[keep], s=values[order][first], r=rank[first])

    prefix = materialize(members.mapInArrow(run, "id long, class long, n long, s long, r long"), "prefixes")
    open_ = prefix.groupBy("s").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 <> c1").select("s")
    prefix = prefix.join(open_, "s", "left_semi")
    n = F.col("n")
    small = prefix.where(F.col("r") <= n - F.ceil(n * 2 * percent / (100 + percent)) + 1).select(F.col("id").alias("a"), F.col("class").alias("ca"), F.col("n").alias("na"), F.col("r").alias("ra"), "s")
    large_ = prefix.select(F.col("id").alias("b"), F.col("class").alias("cb"), F.col("n").alias("nb"), F.col("r").alias("rb"), "s")
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    behind = 1 + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb"))
    enough = behind * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    return small.join(large_, "s").where((F.col("ca") != F.col("cb")) & order & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row per row of ``df``."""
    per_row, pairs = links(df, id=id, text=text, **options)
    found = components(pairs).withColumnRenamed("id", id)
    whole = per_row.join(found, id, "left").withColumn("component_id", F.coalesce("component_id", id))
    return whole.select(id, "n_shingles", "component_id", F.col(id).eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its class, or null; all columns stay."""
    gone = near_duplicates(df, id=id, text=text, **options).where("not kept").select(id).distinct()
    return df.join(gone, id, "left_anti")
