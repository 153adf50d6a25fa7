"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import functools
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the five ASCII controls 9 to 13; ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Point reliable checkpoints at ``spark.checkpoint.dir``; a temporary folder only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="monsoonway-checkpoints-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with a reliable checkpoint.

    The rows are persisted while the checkpoint is written, as Spark otherwise computes the last
    stage twice. The files live in the shared folder, so a lost executor loses nothing.
    """
    use_shared_checkpoints(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def crc_remainder(column: str, divisor: int) -> F.Column:
    """crc32 of an id as text modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))


def bounded_sample(df: DataFrame, key: str, rows: int, salt: str, total: int | None = None) -> DataFrame:
    """About ``rows`` rows at most of ``total``, chosen by a hash of ``key``: the same ones in every run."""
    total = df.count() if total is None else total
    if total <= rows:
        return df
    share = rows / total
    return df.where(F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30)))


_WORKER: dict[str, Any] = {}


def worker_slot(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this worker process for later tasks until another key is asked for.

    A worker process serves one stage after another, so it holds one such object at a time.
    """
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


def free_worker() -> None:
    """Drop what an earlier stage keeps in this worker process."""
    _WORKER.clear()


def in_slices(batches: Iterator[pa.RecordBatch], column: int | str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most about ``most`` bytes of a text column, or of one row."""
    for batch in batches:
        at, size = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
            size += n or 0
            if size >= most:
                yield batch.slice(at, i + 1 - at)
                at, size = i + 1, 0
        if at < batch.num_rows:
            yield batch.slice(at)


#: Rows that a pipeline's stage sends to Python at once: whole texts, which a worker and its executor hold beside their heap.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_RUN: ContextVar[str] = ContextVar("run", default="")
_STAGE: ContextVar[int | None] = ContextVar("stage", default=None)
#: Tables that stages have written, by run and number of the stage; what is written outside of stages is not listed, and stays.
_WRITTEN: dict[tuple[str, int], list[str]] = {}


def _run() -> str:
    return _RUN.get() or f"thread {threading.get_ident()}"


def through_parquet(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, as each stage of a pipeline does."""
    spark = df.sparkSession
    use_shared_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _STAGE.get() is not None:
        _WRITTEN.setdefault((_run(), _STAGE.get()), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def pipeline_run() -> Iterator[None]:
    """Stages called inside are a run of their own: they remove what it has written, and nothing of any other."""
    held = _RUN.set(uuid.uuid4().hex)
    try:
        yield
    finally:
        for key in [k for k in _WRITTEN if k[0] == _RUN.get()]:
            del _WRITTEN[key]  # the result stays for its reader
        _RUN.reset(held)


@contextmanager
def at_stage(number: int) -> Iterator[None]:
    """What is written inside belongs to stage ``number``."""
    held = _STAGE.set(number)
    try:
        yield
    finally:
        _STAGE.reset(held)


def stage(number: int) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Marks a pipeline's stage. Before it starts, what earlier stages of the same run have written is removed.

    By then the result of the stage before has been written and read again, as the stages of a pipeline are. Stages called outside of ``pipeline_run`` are those of their thread's
    run; of two pipelines in one thread that take turns, each is to be a ``pipeline_run``. Tables of the last stage stay, as its result may read them.

    The session sends at most ``BATCH_ROWS`` rows to Python at once from then on, also after the stage, whose result is computed when it is asked for.
    """

    def marked(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(function)
        def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            for key in [k for k in _WRITTEN if k[0] == _run() and k[1] < number]:
                for path in _WRITTEN.pop(key):
                    at = jvm.org.apache.hadoop.fs.Path(path)
                    at.getFileSystem(conf).delete(at, True)
            # files of shuffles that nothing refers to any more
            gc.collect()
            jvm.System.gc()
            if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
                spark.conf.set(_BATCH, BATCH_ROWS)
            with at_stage(number):
                return function(spark, docs, sf_dir)

        return call

    return marked
