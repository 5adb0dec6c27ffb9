"""What the operators of this subpackage share: reading tables, written intermediate tables, small hashes.

Intermediate tables go under the folder that the session names in ``spark.checkpoint.dir``, which all
executors and the driver can reach; only where that is unset (tests) a folder of this machine is set.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Rows and bytes of one Arrow batch sent to Python; texts can be long, so batches are kept short.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def configure(spark: SparkSession) -> None:
    """Session settings the operators rely on for bounded memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_WORK: list[str] = [""]
_CLEAR: list = []


def on_change(clear) -> None:
    """``clear`` is called when a reused Python worker goes on to other work."""
    _CLEAR.append(clear)


def free(work: str) -> None:
    """Gives back what a worker's earlier work left: kept state, and memory that allocators hold."""
    if _WORK[0] != work:
        _WORK[0] = work
        for clear in _CLEAR:
            clear()
        trim()


def trim() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def tidy(work: str, run):
    """``run`` for ``mapInArrow``, with the worker's memory given back before other work and after each task."""

    def task(batches):
        free(work)
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def tidy_group(work: str, run):
    """``run`` of two arguments for ``applyInArrow``, with the worker's memory given back before other work and after each group."""

    def group(first, second):
        free(work)
        out = run(first, second)
        trim()  # what ``run`` held is free once it has returned
        return out

    return group


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textgauge-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/textgauge"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(doc_id) -> "F.Column":
    """crc32 of the decimal text of an id, mod 5: 0 marks the held-out rows."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def language(column: str) -> "F.Column":
    """The language's code in lower case; null is ``und``."""
    return F.coalesce(F.lower(F.col(column)), F.lit("und"))


def text_key(column: str) -> "F.Column":
    """A hash of a text; null is empty."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
