"""Summaries of findings and cells that add up: sketches stored per file, rolled up without reading facts again.

:func:`profile` makes one row for each file and kind: the number of rows, a sketch of the different values (HyperLogLog) and one of
the numbers' quantiles (KLL). Such rows can be kept in a table and appended to as files come; :func:`rollup` merges them by any columns
and :func:`estimates` reads a merged row. Sketches have a fixed greatest size whatever they hold, so a merge of all files
moves a few kilobytes for each row of the profile.

``ERROR_DISTINCT`` bounds the relative error of the number of different values at three standard deviations; a quantile's rank is off by
less than ``ERROR_RANK``. Nulls count as rows, not as values; texts that are no number have no quantile. Repeated rows count
each, as one value. Merging in any order, or in steps, gives the same counts within these bounds. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_REGISTERS, KLL_SIZE = 12, 400
ERROR_DISTINCT = 3 * 1.04 / 2 ** (LOG_REGISTERS / 2)
ERROR_RANK = 0.01


def profile(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``(keys, n, distinct, numbers)``: partial aggregates travel, values do not."""
    number = F.try_cast(F.col(value), "double") if hasattr(F, "try_cast") else F.col(value).try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(value).cast("string"), LOG_REGISTERS).alias("distinct"), F.kll_sketch_agg_double(finite, KLL_SIZE).alias("numbers"))


def rollup(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Profiles merged by ``keys``, which are a part of theirs; with no keys, one row."""
    merged = [F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("numbers", KLL_SIZE).alias("numbers")]
    return profiles.groupBy(*keys).agg(*merged)


def estimates(profiles: DataFrame, *ranks: float) -> DataFrame:
    """The columns of ``profiles`` with ``n_distinct`` and ``q_<percent>`` for each of ``ranks`` in place of the sketches."""
    kept = [c for c in profiles.columns if c not in ("distinct", "numbers")]
    return profiles.select(*kept, F.hll_sketch_estimate("distinct").alias("n_distinct"), *(quantile(r).alias(f"q_{round(100 * r)}") for r in ranks))


def quantile(rank: float) -> Column:
    """The number at ``rank``; null where there is none."""
    return F.when(F.kll_sketch_get_n_double("numbers") > 0, F.kll_sketch_get_quantile_double("numbers", F.lit(rank)))
