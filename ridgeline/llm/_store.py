"""Lineage cuts: tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows handed to Python at once, and bytes: texts may be long, so a batch stays small.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20
#: A writer gathers 16 MB before it writes them out, and looks at its sizes after 8 rows, not after 100: rows that are
#: whole index blocks or tiles would make pages of tens of MB, and codecs keep native buffers of the largest page.
WRITING = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 8, "parquet.page.size.row.check.min": 8}
_LIBC = ctypes.CDLL(None)


def _limits(rows: int) -> dict[str, int]:
    """What one Arrow batch, and one batch of the Parquet reader, holds at most: the reader's vectors grow to all bytes of
    its rows, and with thousands of texts or index blocks in each they fill an executor's heap."""
    arrow, reader = "spark.sql.execution.arrow", "spark.sql.parquet.columnarReaderBatchSize"
    return {f"{arrow}.maxRecordsPerBatch": rows, f"{arrow}.maxBytesPerBatch": ARROW_BYTES, reader: max(16, rows)}


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds batches for the rest of the session (never raises a setting): for an application whose results are computed
    later, after the operator has returned."""
    for key, value in _limits(rows).items():
        if int(spark.conf.get(key).rstrip("b")) > value:
            spark.conf.set(key, str(value))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows, and of ARROW_BYTES, at most, for what runs inside; then as before."""
    wanted = _limits(rows)
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def give_back() -> None:
    """Returns freed memory to the system: workers are used again, and what one stage needed mustn't stay with them."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, which gives its memory back when a task ends."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a local folder in local mode, else the warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return "file:///tmp/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Tables of one operator call. ``put`` writes one and reads it back; ``drop`` deletes those no longer needed.

    What a returned DataFrame still reads stays until the cluster clears the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = self.paths[name] = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**WRITING).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)
