"""Where intermediate tables go, and how Arrow batches are bounded."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Bytes of shuffled data that a task of a written table takes at least, where there is so much for each core: few files, not many small ones.
PART_BYTES = 32 << 20
#: Where the shared folder is a local one: files without checksum files beside them, each of which costs two more processes that set its mode.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: Paths of written tables that haven't been deleted: those that results still read.
_lying: set[str] = set()


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the input folder; the path is opened by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset and the master is local, as in tests, a temporary folder
    that is set as such. On a cluster it has to be set: a folder of one machine would lose rows."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def materialise(frame: DataFrame, name: str, sweep: bool = False) -> DataFrame:
    """Writes the frame as Parquet in the shared folder and reads it again: lineage is cut and a lost executor loses nothing.
    sweep: after a step that has shuffled much, its shuffle files go at once."""
    spark = frame.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    with _large_parts(spark):
        frame.write.options(**_PLAIN_FILES).parquet(path)
    schema = frame.schema
    del frame
    if sweep:
        release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._stored = path
    _lying.add(path)
    return out


@contextmanager
def _large_parts(spark: SparkSession) -> Iterator[None]:
    """Raises the size of coalesced partitions to PART_BYTES while a table is written; a larger size stays, and what was set comes back."""
    before = spark.conf.get(_ADVISORY)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    try:
        spark.conf.set(_ADVISORY, str(max(size, PART_BYTES)))
        yield
    finally:
        spark.conf.set(_ADVISORY, before)


def discard(*frames: DataFrame) -> None:
    """Deletes what materialise() wrote for these frames, once nothing that is still to run reads them."""
    for frame in frames:
        path = frame.__dict__.pop("_stored", None)
        if path:
            _delete(frame.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all written tables that still lie there: to be called when the results of the operators have been read or written."""
    for path in list(_lying):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _lying.discard(path)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all that are taken, whatever their case."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def release(spark: SparkSession) -> None:
    """Lets shuffle files of finished steps go: they do when the driver has collected its garbage, twice."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.1)
    spark._jvm.System.gc()


def bounded(spark: SparkSession, megabytes: int = 4) -> None:
    """Keeps the Arrow batches that go to Python at `megabytes`, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
