"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch where nobody has chosen otherwise: texts are long, and a
#: batch is held by the JVM and by Python at once.
BATCH_ROWS = 500
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_DEFAULT = "10000"


def small_batches(spark: SparkSession) -> None:
    """Makes Arrow batches fit texts, unless the session has its own number."""
    if spark.conf.get(BATCH_CONF, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


#: The A-Z to a-z part of lower-casing; other letters stay as they are.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where that is unset and there is a single machine, as in tests, a local
    folder is set in its place; on a cluster that would be a folder of its own on
    each machine, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sheetspark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage.

    The files live in the shared folder, so a lost executor loses none of them.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Gives memory that a task has freed back to the system; a worker process outlives its tasks, idle."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


class Scratch:
    """Tables in the shared folder that go when the work that needs them is done.

    What leaves the ``with`` block must be written elsewhere before.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, fresh_path(spark, "scratch"), 0

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        """Writes ``df`` and reads it back."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{tag}"
        df.write.parquet(path)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, below: str = "") -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root + below)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark drop the shuffle files of plans that nothing refers to any more; it does so after a collection of garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop()
        self.release()


def without(columns: list[str], names) -> list[str]:
    """The columns whose names, case ignored, are not among ``names``."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_arrow(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[..., list[pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds columns that a function makes from Arrow arrays, batch by batch.

    ``make`` runs once a task on the executor and returns the function; that gets
    the arrays of ``inputs`` and returns one array for each of ``fields``; if it has
    a ``close``, that is called when the task ends. The other columns pass unchanged. A new column replaces one of the same name.
    """
    names = [f.name for f in fields]
    kept = without(df.columns if keep is None else keep, names)
    extra = [c for c in inputs if c not in kept]
    # all travel under names without dots, which mapInArrow takes for fields
    source = df.select(*[F.col(quoted(c)).alias(f"\x01{i}") for i, c in enumerate([*kept, *extra])])
    at = [kept.index(c) if c in kept else len(kept) + extra.index(c) for c in inputs]
    schema = T.StructType([*[df.schema[c] for c in kept], *fields])
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = None
        try:
            for batch in batches:
                call = call or make()
                made = call(*[batch.column(i) for i in at])
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *made], names=[*kept, *names])
        finally:
            getattr(call, "close", lambda: None)()
            tidy()

    small_batches(df.sparkSession)
    return source.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a column; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def runs(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of the list of about ``limit`` characters each, so that work arrays stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
