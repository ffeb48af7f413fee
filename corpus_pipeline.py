"""A training-corpus pipeline over ``documents``, one operator a stage.

1. language: texts without a letter, so without any language, go.
2. near_duplicates: of each class of near-duplicate texts the smallest doc_id stays.
3. repeats: byte strings of 200 or more that occur twice or more are cut from every text;
   texts of which nothing is left go, and n_chars follows the text.
4. packing: what is left is packed into sequences of 512 to 8192 words.

All stages but the last return the columns of ``documents``; further columns go along, whatever
their names. Null and empty texts go in the first stage. Rows with a null doc_id are kept by the
second, since they have no place in a class; rows that repeat a doc_id stay or go together, and
copies of a text under other ids leave their smallest doc_id. Rows are told apart by an internal key
in the third, so repeated rows lose their text to each other. An empty table passes every stage.
SQL cannot express the language model, so there is no oracle; the tests hold ``run`` against
brute-force stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlark.llm import common, langid, minhash, packing, suffix


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a language; the model learns from labelled rows of ``docs``."""
    common.release(spark)
    model = langid.fit(docs)
    held = {c: f"_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    found = langid.predict(docs, model, carry=tuple(F.col(c).alias(h) for c, h in held.items()), spans=False, keep_text=True)
    return found.where("lang_pred <> 'und'").select(*(F.col(held.get(c, c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)  # what earlier stages left has been written
    return minhash.drop_near_duplicates(docs).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    cut = suffix.remove_repeats(docs, spans=None).where("length(text) > 0")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    return packing.pack(docs).select("doc_id", "copy", "piece", "start", "length", "bin_id", "capacity", "offset")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.scratch_path(spark, f"stage-{name}", keep=True)
        made = stage(spark, docs, sf_dir)
        made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            common.delete(spark, before)  # its successor is written
        before = path
    common.release(spark)
    return docs
