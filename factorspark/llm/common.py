"""Shared plumbing of the text operators: the shared folder, lineage cuts, and per-text Arrow maps."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _give_memory_back() -> None:
    """Have large blocks returned to the system when they are freed.

    A Python worker lives as long as its executor and runs task after task. By default the allocators keep what one task has
    freed, so that the largest moments of different operators would add up in the executor's memory.
    """
    if sys.platform.startswith("linux"):
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: blocks from 1 MB on are mapped one by one
    pa.set_memory_pool(pa.system_memory_pool())


_give_memory_back()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach: spark.checkpoint.dir. Where it is unset, a folder of our own if all run
    on this machine; a cluster must name one."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.gettempdir()}/factorspark-checkpoints")
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours under the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage; lost executors then re-read files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch on its way to a worker, unless the session sets its own bound: a batch is held by the JVM's vectors, by its
#: send buffer and by the worker at once, for each running task, and the memory allocators of the JVM keep what they had at most.
BATCH_BYTES = 4 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes."""
    conf = df.sparkSession.conf
    if conf.get(_BOUND) == "67108864b":  # Spark's own default
        conf.set(_BOUND, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One output batch for each Arrow batch of ``df``; nothing is held between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return arrow_map(df, run, schema)


def raw(text: str) -> bytes:
    """UTF-8 bytes; lone surrogates cannot come out of Spark strings, so strict encoding is safe."""
    return text.encode("utf-8")
