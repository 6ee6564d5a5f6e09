"""Files as rows, and rows as files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_list(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file_id, name, path, size, added_at; contents aren't read, as the column is pruned."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return found.select(F.xxhash64("path").alias("file_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("added_at"))


def read_files(spark: SparkSession, path: str, glob: str | None = None, most_bytes: int = 512 << 20) -> DataFrame:
    """file_id, name, path, size, added_at, content, error. A file over the limit is an error row without content: the limit and the
    choice of columns reach the scan, so it is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    known = (F.xxhash64("path").alias("file_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("added_at"))
    whole = found.where(F.col("length") <= most_bytes).select(*known, "content", F.lit(None).cast("string").alias("error"))
    return whole.unionByName(found.where(F.col("length") > most_bytes).select(*known, F.lit(None).cast("binary").alias("content"), F.lit("too_large").alias("error")))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes (file_id, part_no, name, content) into a folder that all executors share, and gives (path, size).

    A name holds the ids, so tasks never meet in one and a repeated task writes the same again; each file appears whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths, sizes = [], []
            for file_id, part_no, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                safe = "".join("_" if c in '<>:"/\\|?*' or c < " " else c for c in name or "file")
                path = os.path.join(folder, f"{file_id & 0xFFFFFFFFFFFFFFFF:016x}_{part_no}_{safe}")
                with open(path + ".part", "wb") as f:
                    f.write(content)
                os.replace(path + ".part", path)
                paths.append(path)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    return files.where(F.col("content").isNotNull()).select(F.col("file_id").cast("long"), F.col("part_no").cast("int"), "name", "content").mapInArrow(run, "path string, size long")
