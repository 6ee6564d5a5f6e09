"""Drop folders: files are converted as they arrive, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.convert import convert

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, glob: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream of file_id, name, content."""
    stream = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.select(F.xxhash64("path").alias("file_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content")


def convert_arrivals(spark: SparkSession, folder: str, operation: str, out: str, checkpoint: str, glob: str = "*", once: bool = True, **parameters) -> StreamingQuery:
    """Converts arriving files into a Parquet folder of outputs, notes and errors. The file sink and the checkpoint together give
    every file exactly once. `once` handles what is there and ends; else the query goes on."""
    done = convert(arrivals(spark, folder, glob), operation, **parameters)
    writer = done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
