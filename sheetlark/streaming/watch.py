"""Scan workbooks as they arrive in a folder, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.masking import reveal
from ..operators.findings import findings
from ..sources.workbook import FILES, facts_of_files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def workbook_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New ``.xlsx`` and ``.xlsm`` files below ``folder``, a bounded number at a time."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the masked findings of arriving workbooks to the Parquet table ``out``, each file once.

    A batch that runs again after a failure overwrites its own folder, so nothing is told twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        reveal(findings(facts_of_files(batch))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return workbook_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
