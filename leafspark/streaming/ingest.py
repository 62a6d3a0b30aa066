"""A folder of documents as a stream. Conversion keeps no state, so it is the batch operator on the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import documents, markdown, pages

_KINDS = {"markdown": markdown, "documents": documents, "pages": pages}
SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_stream(spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """New files under ``path``, at most ``files_per_trigger`` in a micro-batch."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def convert_stream(stream: DataFrame, out: str, checkpoint: str, kind: str = "markdown", available_now: bool = False) -> StreamingQuery:
    """Append converted rows to the Parquet folder ``out``, exactly once by the checkpoint."""
    made = _KINDS[kind](stream, path_col="path")
    writer = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
