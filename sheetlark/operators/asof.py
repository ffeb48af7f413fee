"""As-of join: every row of one table with the last row of another at or before it, by key.

Both tables meet in one sorted window (a union, then the last value that is not null), never in an
inequality join. A key may hold any share of the rows: keys are cut into stretches of ``width``, and each
stretch gets the last row before it handed in, so that stretches are worked on apart. With a ``tolerance``
of at most ``width`` the rows of a stretch are sent to the next one as well, and that is the only shuffle;
without one, what is handed in comes from one row for each key and stretch.

Of rows of the right table at one place the greatest (column by column) counts. Rows of the left table that are
repeated come out as often; those with a null key or place, or with nothing at or before them, get
nulls. Right rows with a null key or place match nothing. Empty tables are no exception.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], *, width: int, tolerance: int | None = None) -> DataFrame:
    """``left`` with the columns ``values`` of the last ``right`` row of the same ``by`` whose ``on`` is not greater.

    ``on`` is a whole number in both (microseconds for times) and ``width`` a stretch of it. With
    ``tolerance`` a row that lies further back than that does not count.
    """
    if width < 1 or (tolerance is not None and not 0 <= tolerance <= width):
        raise ValueError("width must be positive, and tolerance between 0 and width")
    keys = [f"_k{i}" for i in range(len(by))]
    place = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)] + [F.col(on).cast("long").alias("_at")]
    known = F.col("_at").isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    stretch = F.floor(F.col("_at") / F.lit(width)).cast("long").alias("_stretch")
    asks = left.select(F.struct(*left.columns).alias("_row"), *place)
    told = right.select(F.struct(F.col(on).cast("long").alias("_from"), *values).alias("_found"), *place).where(known)
    kind = told.schema["_found"].dataType
    there = told.select("*", stretch)
    if tolerance is not None:
        handed = there.withColumn("_stretch", F.explode(F.array(F.col("_stretch"), F.col("_stretch") + 1)))
    else:
        lasts = there.groupBy(*keys, "_stretch").agg(F.max(F.struct("_at", "_found")).alias("m")).select(*keys, "_stretch", "m")
        asked = asks.where(known).select(*keys, stretch).distinct().withColumn("m", F.lit(None).cast(lasts.schema["m"].dataType))
        before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row for each stretch
        summed = lasts.unionByName(asked).groupBy(*keys, "_stretch").agg(F.max("m").alias("m"), F.lit(True).alias("one"))
        carried = summed.select(*keys, "_stretch", F.last("m", ignorenulls=True).over(before).alias("m")).where("m IS NOT NULL")
        handed = there.unionByName(carried.select("m._found", *keys, "m._at", "_stretch"))
    lines = handed.select(*keys, "_stretch", "_at", F.lit(0).alias("_side"), "_found", F.lit(None).cast(asks.schema["_row"].dataType).alias("_row"))
    lines = lines.unionByName(asks.where(known).select(*keys, stretch, "_at", F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_found"), "_row"))
    so_far = Window.partitionBy(*keys, "_stretch").orderBy("_at", "_side", "_found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = lines.select("_row", "_at", F.last("_found", ignorenulls=True).over(so_far).alias("_found")).where("_row IS NOT NULL")
    if tolerance is not None:
        met = met.withColumn("_found", F.when(F.col("_at") - F.col("_found._from") <= tolerance, F.col("_found")))
    out = met.select("_row", "_found").unionByName(asks.where(~known).select("_row", F.lit(None).cast(kind).alias("_found")))
    return out.select("_row.*", *(f"_found.{v}" for v in values))
