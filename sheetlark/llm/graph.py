"""Connected components as DataFrame rounds.

Each round hooks every vertex to the neighbour of least priority and contracts the
edges. Priorities are scrambled ids, so sorted chains shrink as fast as random ones
and the number of rounds is logarithmic. A vertex with very many edges is met only in
partial aggregates and in joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _priority(x: Column) -> Column:
    """A bijective scramble of 64-bit ids with shifts only (no overflow under ANSI)."""
    for salt in (0x1B873593, 0x5851F42D):
        x = x.bitwiseXOR(F.lit(salt))
        x = x.bitwiseXOR(F.shiftleft(x, 13))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
        x = x.bitwiseXOR(F.shiftleft(x, 17))
    return x


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(id, component_id)`` for every vertex of ``edges``; component_id is the smallest id reachable.

    Null ends and loops are ignored; repeated edges do no harm; no edges give no rows.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
        best = both.groupBy("id").agg(F.min(F.struct(_priority(F.col("to")).alias("p"), F.col("to").alias("id"))).alias("m"))
        own = F.struct(_priority(F.col("id")).alias("p"), F.col("id").alias("id"))
        parent = materialize(best.select("id", F.least(F.col("m"), own)["id"].alias("root")), "parents")
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("up"))
            labels = materialize(labels.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root")), "labels")
        pa, pb = (parent.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        edges = materialize(
            edges.join(pa, "a").join(pb, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(), "edges"
        )
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    smallest = labels.groupBy("root").agg(F.min("id").alias("component_id"))
    return labels.join(smallest, "root").select("id", F.least("id", "component_id").alias("component_id"))
