"""Joins and differences of ranges by boundary sweeps: no range is ever written out index by index.

Places are cut into stretches of ``width``. A range is handed to the stretches that it overlaps (at most 16
for the rows of a sheet at the default width, which the file format bounds at 1,048,576), clipped
to each, and a stretch is swept from its first boundary to its last in one sorted window. A sheet, or any other key,
may so hold any share of the rows.

Ranges with a null end or a null key, and ranges that end before they begin, hold nothing. Points with a null
key or place are in no range. Repeated ranges and points are no exception: every point comes out once for each
time that it comes in. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16


def _clipped(ranges: DataFrame, keys: list[str], lo: str, hi: str, width: int, *more: str) -> DataFrame:
    """Ranges cut at the bounds of stretches: keys, ``_stretch``, ``_lo``, ``_hi``."""
    known = F.col(lo) <= F.col(hi)
    for k in keys:
        known &= F.col(k).isNotNull()
    at = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    each = ranges.where(known).select(*keys, F.col(lo).cast("long").alias("_lo"), F.col(hi).cast("long").alias("_hi"), *more, F.explode(F.sequence(at(lo), at(hi))).alias("_stretch"))
    first = F.col("_stretch") * width
    return each.withColumns({"_lo": F.greatest("_lo", first), "_hi": F.least("_hi", first + width - 1)})


def covered(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, *, lo: str = "lo", hi: str = "hi", name: str = "covered", width: int = WIDTH) -> DataFrame:
    """``points`` with a boolean column ``name``: whether a range of the same keys holds ``at``."""
    names = [f"_k{i}" for i in range(len(keys))]
    kept = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    place = F.col(at).cast("long")
    known = F.col("_at").isNotNull()
    for n in names:
        known &= F.col(n).isNotNull()
    asks = points.select(F.struct(*points.columns).alias("_row"), *kept, place.alias("_at"))
    parts = _clipped(ranges.select(*kept, F.col(lo).alias("_from"), F.col(hi).alias("_to")), names, "_from", "_to", width)
    row = asks.schema["_row"].dataType
    # a range opens before the points at its first place; how far those opened so far reach decides
    lines = parts.select(*names, "_stretch", F.col("_lo").alias("_at"), F.lit(0).alias("_side"), F.col("_hi").alias("_reach"), F.lit(None).cast(row).alias("_row"))
    lines = lines.unionByName(asks.where(known).select(*names, F.floor(F.col("_at") / F.lit(width)).cast("long").alias("_stretch"), "_at", F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_reach"), "_row"))
    so_far = Window.partitionBy(*names, "_stretch").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = lines.select("_row", F.coalesce(F.max("_reach").over(so_far) >= F.col("_at"), F.lit(False)).alias(name)).where("_row IS NOT NULL")
    return swept.unionByName(asks.where(~known).select("_row", F.lit(False).alias(name))).select("_row.*", name)


def apart(ranges: DataFrame, keys: list[str], *, lo: str = "lo", hi: str = "hi", side: str = "side", width: int = WIDTH) -> DataFrame:
    """Where only one of the sides ``old`` and ``new`` holds: keys, ``in_new``, ``lo``, ``hi``.

    Neighbouring stretches are put together again, so a result is as long as it can be.
    """
    parts = _clipped(ranges, keys, lo, hi, width, side)
    step = lambda s: F.when(F.col(side) == s, 1).otherwise(0)
    opens = parts.select(*keys, "_stretch", F.col("_lo").alias("_at"), *(step(s).alias(s) for s in ("old", "new")))
    closes = parts.select(*keys, "_stretch", (F.col("_hi") + 1).alias("_at"), *((-step(s)).alias(s) for s in ("old", "new")))
    edges = opens.unionByName(closes).groupBy(*keys, "_stretch", "_at").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    along = Window.partitionBy(*keys, "_stretch").orderBy("_at")
    depth = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = edges.select(*keys, "_at", F.lead("_at").over(along).alias("_next"), *(F.sum(s).over(depth).alias(s) for s in ("old", "new")))
    pieces = open_.where("_next IS NOT NULL AND (old > 0) <> (new > 0)").select(*keys, (F.col("new") > 0).alias("in_new"), F.col("_at").alias("lo"), (F.col("_next") - 1).alias("hi"))
    # differences alone are put together; they touch where a stretch ends or a count changes
    line = Window.partitionBy(*keys, "in_new").orderBy("lo")
    fresh = pieces.withColumn("_new", F.coalesce(F.col("lo") > F.lag("hi").over(line) + 1, F.lit(True)).cast("long"))
    grouped = fresh.withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy(*keys, "in_new", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def named(lo: Column, hi: Column) -> Column:
    """A range as text: its place, or both ends."""
    return F.when(lo == hi, lo.cast("string")).otherwise(F.concat(lo.cast("string"), F.lit(":"), hi.cast("string")))
