"""Nested properties (JSON) flattened without a schema, and what differs between two versions of them.

A text becomes a VARIANT and is opened level by level until nothing nested is left: ``path`` (``$.a.b[2]``), ``type`` and ``value`` of every leaf.
Each level is written before the next is opened, so a deep text costs one step a level and no row is held whole beyond its own text.
:func:`differences` compares the leaves of both versions as property facts: a path that was added or lost, whose type changed, or whose value did.

Null texts have no leaves; texts that are no JSON are one leaf of type ``TEXT``; empty objects and arrays are leaves; a JSON null is a leaf of
type ``VOID``. Names are quoted in paths where they hold other signs than letters, digits and ``_``. Of rows that repeat a key the leaves count once,
the greatest value of a path. Null keys are keys. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def flatten(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """``(keys, path, type, value)``, one row for each leaf of the column ``json``."""
    spark = df.sparkSession
    level = df.where(F.col(json).isNotNull()).select(*keys, F.lit("$").alias("path"), F.try_parse_json(F.col(json)).alias("v"), F.col(json).alias("text"))
    leaves, depth = [], 0
    while True:
        kind = F.schema_of_variant("v")
        inner = kind.startswith("OBJECT<") & (F.to_json("v") != "{}") | kind.startswith("ARRAY<") & (F.to_json("v") != "[]")
        level = written(level.withColumns({"kind": kind, "nested": F.coalesce(inner, F.lit(False))}), f"level-{depth}")
        plain = F.when(F.col("v").isNull(), "TEXT").otherwise(F.regexp_extract("kind", "^[A-Z]+", 0))
        value = F.when(F.col("v").isNull(), F.col("text")).when(F.col("kind").rlike("^(OBJECT|ARRAY)"), F.to_json("v")).otherwise(F.try_variant_get("v", "$", "string"))
        leaves.append(level.where("NOT nested").select(*keys, "path", plain.alias("type"), value.alias("value")))
        if level.where("nested").isEmpty():
            break
        name = "CASE WHEN x.key IS NULL THEN concat('[', x.pos, ']') WHEN x.key RLIKE '^[A-Za-z_][A-Za-z0-9_]*$' THEN concat('.', x.key) ELSE concat('[\"', replace(x.key, '\"', '\\\\\\\\\"'), '\"]') END"
        level = spark.sql(f"SELECT {', '.join(f'l.`{k}`' for k in keys)}{',' if keys else ''} concat(l.path, {name}) AS path, x.value AS v, CAST(NULL AS STRING) AS text FROM {{level}} l, LATERAL variant_explode(l.v) x WHERE l.nested", level=level)
        depth += 1
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def differences(old: DataFrame, new: DataFrame, keys: list[str], json: str) -> DataFrame:
    """``(keys, category, path, old, new)``; categories prop_added, prop_lost, prop_retyped and prop_changed."""
    sides = {}
    for side, df in (("old", old), ("new", new)):
        one = flatten(df, keys, json).groupBy(*keys, "path").agg(F.max(F.struct("value", "type")).alias(side))
        sides[side] = one.withColumn(f"in_{side}", F.lit(True)).withColumnsRenamed({k: f"{k}_{side}" for k in keys} | {"path": f"path_{side}"})
    same = F.col("path_old") == F.col("path_new")
    for k in keys:
        same &= F.col(f"{k}_old").eqNullSafe(F.col(f"{k}_new"))
    met = sides["old"].join(sides["new"], same, "full_outer")
    category = F.when(F.col("in_old").isNull(), "prop_added").when(F.col("in_new").isNull(), "prop_lost").when(F.col("old.type") != F.col("new.type"), "prop_retyped").when(~F.col("old.value").eqNullSafe(F.col("new.value")), "prop_changed")
    told = lambda side: F.when(category == "prop_retyped", F.concat_ws(" ", f"{side}.type", f"{side}.value")).otherwise(F.col(f"{side}.value")).alias(side)
    return met.where(category.isNotNull()).select(*(F.when(F.col("in_old").isNull(), F.col(f"{k}_new")).otherwise(F.col(f"{k}_old")).alias(k) for k in keys), category.alias("category"), F.coalesce("path_old", "path_new").alias("path"), told("old"), told("new"))
