"""Incremental ingest (an extension): new page images are transcribed as they arrive, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom import schemas
from pageloom.functions.text import extension
from pageloom.plans.stages import transcribe

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def page_stream(spark: SparkSession, folder: str, per_trigger: int = 64) -> DataFrame:
    """New image files of a folder: page_id, path, content."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.filter(extension("path").isin(list(schemas.PAGE_EXTENSIONS))).select(F.xxhash64("path").alias("page_id"), "path", "content")


def transcribe_stream(pages: DataFrame, make_backend: Callable, prompt: str, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces its own folder of out, so that a batch that is run again leaves no copy."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transcribe(batch, make_backend, prompt).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(records: DataFrame, time: str = "modificationTime", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Pages per time window with a watermark for late files."""
    return records.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("pages"))
