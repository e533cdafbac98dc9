"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch. Texts can be long, so batches of documents are short.
BATCH_ROWS = 256
#: Folders that ``cut`` has made and ``release`` may delete.
_OWN: set[str] = set()
#: Of each module whose tasks leave something in the worker for the next ones, how it is forgotten.
_LEFT: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches short enough for long texts in a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a folder of our own only where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="skylocus-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str = "cut", codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later steps depend on files that every executor sees, so losing an executor never recomputes
    what lies before. Column pruning and size statistics work on the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _OWN.add(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Delete tables that ``cut`` returned and nothing reads any more.

    Only folders that ``cut`` made in this process are ever deleted; for any other frame this raises
    before anything is gone, so an input cannot be lost.
    """
    paths = [getattr(df, "_cut_path", None) for df in done]
    if not all(path in _OWN for path in paths):
        raise ValueError("only what cut() returned can be released")
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _OWN.discard(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Have executors delete shuffles that no plan refers to: they do once the driver's JVM finds so, which may else be long after."""
    gc.collect()
    spark._jvm.System.gc()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each given length, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def sliced(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut by bytes of text, with their texts, so that memory holds ``most`` bytes or one document."""
    for batch in batches:
        parts, at = texts(batch.column(column)), 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (size < most or end == at):
                size += len(parts[end])
                end += 1
            yield batch.slice(at, end - at), parts[at:end]
            at = end


def leaves(module: str, forget: Callable[[], None]) -> None:
    """``module`` keeps things in a worker from task to task; ``forget`` is called when the worker turns to another's tasks."""
    _LEFT[module] = forget


def turn(module: str) -> None:
    """Forget what tasks of other modules have left in this worker."""
    others = [forget for owner, forget in _LEFT.items() if owner != module]
    for forget in others:
        forget()
    if others:
        give_back()


def settle() -> None:
    """Once in a worker: what is there already, its modules above all, is left out of later collections, which else take longer than a small task."""
    if not gc.get_freeze_count():
        gc.freeze()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the C library, where it has it
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, before which the worker forgets what other operators keep in it, and after which it gives its memory back: workers are used again, also by later stages."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        turn(run.__module__)
        try:
            yield from run(batches)
        finally:
            give_back()

    return mapped


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
