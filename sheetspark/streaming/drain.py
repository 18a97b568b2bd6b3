"""Photos that arrive over time: each becomes a page once, and what is on disk says which are left.

A batch lists photos and pages anew and works on the difference, so it can stop
anywhere and a photo that was taken again, after its page was removed, is found.
The stream only says when to look. What failed is kept in a table of its own, by photo and
time of its file, so a restart knows it; it is tried again later, each time after twice the
wait, a few times, and at once when the file is a new one.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheetspark.operators import catalog
from sheetspark.plans import recipe
from sheetspark.sources import files

MOST_PHOTOS = 10_000  # of one batch: their names go to the driver
MOST_TRIES, WAIT_SECONDS = 5, 60.0
FAILURES = "scan_id string, num int, modified timestamp, tries int, retry_at double"
SCAN_AND_NUM = r"([^/]+)/(photo|page)/([0-9]{4})\.jpg$"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, scan_id, kind, num, length, modified of the photos and pages under ``root/<scan>/<kind>/NNNN.jpg``.

    Only names are listed: the contents aren't among the columns read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[0-9][0-9][0-9][0-9].jpg").load(root)
    part = lambda k: F.regexp_extract("path", SCAN_AND_NUM, k)
    return found.where(F.col("path").rlike(SCAN_AND_NUM)).select("path", part(1).alias("scan_id"), part(2).alias("kind"), part(3).cast("int").alias("num"), "length", F.col("modificationTime").alias("modified"))


class Failures:
    """The photos that failed: a row each, in a table that each change writes anew under the next number.

    Rows are those of photos that are still there; a table counts once it is whole, and the one before the last goes.
    """

    def __init__(self, spark: SparkSession, folder: str, most_tries: int = MOST_TRIES, wait: float = WAIT_SECONDS, now: Callable[[], float] = time.time):
        self.spark, self.folder, self.most_tries, self.wait, self.now = spark, folder.rstrip("/"), most_tries, wait, now

    def _at(self, text: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        path, system = self._at(f"{self.folder}/*/_SUCCESS")
        return max((int(f.getPath().getParent().getName()) for f in system.globStatus(path) or []), default=0)

    def read(self) -> DataFrame:
        n = self.version()
        return self.spark.read.schema(FAILURES).parquet(f"{self.folder}/{n}") if n else self.spark.createDataFrame([], FAILURES)

    def waiting(self) -> DataFrame:
        """Those that aren't tried now: too often already, or too lately."""
        return self.read().where((F.col("tries") >= self.most_tries) | (F.col("retry_at") > self.now()))

    def note(self, failed: set, listed: DataFrame) -> None:
        """Adds (scan_id, num) of photos that have just failed; those that meanwhile have a page are forgotten."""
        if not failed:
            return
        new = self.spark.createDataFrame(sorted(failed), "scan_id string, num int")
        left = listed.where("kind = 'photo'").select("scan_id", "num", "modified").join(catalog.unscanned(listed), ["scan_id", "num"], "left_semi")
        old = self.read()
        rows = new.withColumn("new", F.lit(1)).join(old.drop("modified", "retry_at"), ["scan_id", "num"], "full")
        tries = F.coalesce("tries", F.lit(0)) + F.coalesce("new", F.lit(0))
        rows = rows.select("scan_id", "num", "new", tries.alias("tries")).join(left, ["scan_id", "num"])
        same = old.select("scan_id", "num", F.col("modified").alias("was"), F.col("retry_at").alias("later"))
        rows = rows.join(same, ["scan_id", "num"], "left")
        # a new file begins anew
        tries = F.when(F.col("was").isNull() | (F.col("was") == F.col("modified")), F.col("tries")).otherwise(F.coalesce("new", F.lit(0)))
        rows = rows.withColumn("tries", tries.cast("int")).where("tries > 0")
        again = F.lit(self.now()) + F.lit(self.wait) * F.pow(F.lit(2.0), F.col("tries") - 1)
        rows = rows.select("scan_id", "num", "modified", "tries", F.when(F.col("new") == 1, again).otherwise(F.col("later")).alias("retry_at"))
        n = self.version()
        rows.write.mode("overwrite").parquet(f"{self.folder}/{n + 1}")
        path, system = self._at(f"{self.folder}/{n - 1}")
        system.delete(path, True)


def drain(spark: SparkSession, root: str, quality: int = 85, edge: int = 0, most: int = MOST_PHOTOS, failed: frozenset = frozenset(), failures: Failures | None = None, after: tuple[str, int] | None = None) -> DataFrame:
    """scan_id, num, jpeg and error of photos without a page: one batch, the first ``most`` by scan and number.

    Only those files are read. ``failed`` has (scan_id, num) of photos that aren't tried again; ``failures`` knows them from
    before, by the time of their files. A batch isn't all: ``drained`` goes through all of them, ``after`` the last of a batch.
    """
    return _batch(spark, root, quality, edge, most, failed, failures, after)[0]


def drained(spark: SparkSession, root: str, quality: int = 85, edge: int = 0, most: int = MOST_PHOTOS, failures: Failures | None = None) -> Iterator[DataFrame]:
    """All photos without a page, as batches of at most ``most``, whether or not their pages are written between."""
    after = None
    while True:
        pages, last = _batch(spark, root, quality, edge, most, frozenset(), failures, after)
        if last is None:
            return
        yield pages
        after = last


def _batch(spark, root, quality, edge, most, failed, failures, after) -> tuple[DataFrame, tuple[str, int] | None]:
    listed = listing(spark, root)
    left = catalog.unscanned(listed)
    photos = listed.where("kind = 'photo'").join(left, ["scan_id", "num"], "left_semi").select("path", "scan_id", "num", "modified")
    if after:
        photos = photos.where((F.col("scan_id") > after[0]) | (F.col("scan_id") == after[0]) & (F.col("num") > after[1]))
    if failures:
        photos = photos.join(failures.waiting().select("scan_id", "num", "modified"), ["scan_id", "num", "modified"], "left_anti")
    if failed:
        bad = spark.createDataFrame(sorted(failed), "scan_id string, num int")
        photos = photos.join(F.broadcast(bad), ["scan_id", "num"], "left_anti")
    wanted = photos.orderBy("scan_id", "num").limit(most).collect()  # names, as many as were asked for
    if not wanted:
        return spark.createDataFrame([], "scan_id string, num int, jpeg binary, error string"), None
    paths = [r["path"] for r in wanted]
    part = lambda k: F.regexp_extract("path", SCAN_AND_NUM, k)
    loaded = files.load_images(spark, paths).select(part(1).alias("scan_id"), part(3).cast("int").alias("num"), "image", F.col("error").alias("unread"))
    pages = recipe.scan_page(loaded, quality, edge, keep=["scan_id", "num", "unread"])
    return pages.select("scan_id", "num", "jpeg", F.coalesce("unread", "error").alias("error")), (wanted[-1]["scan_id"], wanted[-1]["num"])


def publish(spark: SparkSession, root: str, pages: DataFrame) -> tuple[int, set]:
    """Writes finished pages as files from the tasks that made them, each whole or not at all.

    Returns how many were written, and (scan_id, num) of those that failed. Only names come to the driver.
    """

    def write(batches):
        for batch in batches:
            for scan, num, data, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if error is None:
                    system, folder = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
                    system.create_dir(f"{folder}/{scan}/page", recursive=True)
                    name = f"{folder}/{scan}/page/{num:04d}"
                    part = f"{name}.{uuid.uuid4().hex}.part"
                    with system.open_output_stream(part) as sink:
                        sink.write(data)
                    system.move(part, f"{name}.jpg")
                yield pa.RecordBatch.from_pydict({"scan_id": pa.array([scan], pa.string()), "num": pa.array([num], pa.int32()), "error": pa.array([error], pa.string())})

    done = pages.select("scan_id", "num", "jpeg", "error").mapInArrow(write, "scan_id string, num int, error string").collect()
    return sum(r["error"] is None for r in done), {(r["scan_id"], r["num"]) for r in done if r["error"] is not None}


def watch(spark: SparkSession, root: str, checkpoint: str, done: Callable[[int], None] = lambda n: None, every: float | None = None, failures: Failures | None = None, **options) -> StreamingQuery:
    """Drains whenever new photos are seen; what a batch does depends on the listing alone, so running it twice does no harm.

    Without ``every`` it stops when it has seen all there is; with it, it stays on and looks every so many seconds, also for
    photos whose time to be tried again has come. Failures are kept beside the checkpoint, unless given.
    """
    known = failures or Failures(spark, f"{checkpoint.rstrip('/')}/failures")

    def batch(_: DataFrame, __: int) -> None:
        while True:
            n, bad = publish(spark, root, drain(spark, root, failures=known, **options))
            known.note(bad, listing(spark, root))
            if n or bad:
                done(n)
            if not n:  # what has just failed waits
                return

    if every is None:
        schema = spark.read.format("binaryFile").load(f"{root}/*/photo").schema
        seen = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "[0-9][0-9][0-9][0-9].jpg").load(f"{root}/*/photo").select("path")
        return seen.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint.rstrip('/')}/clock").trigger(processingTime=f"{every} seconds").start()
