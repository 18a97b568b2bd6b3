"""Deleting in order: a table of steps, each of which is taken only when the one before it is seen done.

What shows that work is finished goes first (a page before its photo, a document before its pages), so whenever
it stops, what is left on disk is a state that the catalog knows. Steps are files; a file that isn't there any more counts as
deleted, so a plan can be run again, from wherever it was stopped, and ends the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetspark.sources.documents import located

#: In this order the files of a page, or of a scan, go.
ORDER = ("pdf", "page", "state", "photo")


def place(kind: str, num: Column) -> Column:
    name = F.lpad(num.cast("string"), 4, "0")
    return {"pdf": F.lit("scan.pdf"), "page": F.concat(F.lit("page/"), name, F.lit(".jpg")), "state": F.concat(F.lit("state/"), name, F.lit(".txt")), "photo": F.concat(F.lit("photo/"), name, F.lit(".jpg"))}[kind]


def plan(rows: DataFrame, kinds: tuple[str, ...] = ORDER) -> DataFrame:
    """scan_id, step (from 1 on) and path for files (scan_id, kind, num) that are to go, the kinds in their order, then by number."""
    order = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind")).cast("int")
    path = F.coalesce(*[F.when(F.col("kind") == k, place(k, F.col("num"))) for k in ORDER])
    wanted = rows.where(F.col("kind").isin(*kinds)).select("scan_id", order.alias("first"), F.coalesce("num", F.lit(0)).alias("num"), path.alias("path")).distinct()
    listed = wanted.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("first", "num", "path"))).alias("l"))
    return listed.select("scan_id", F.posexplode("l").alias("step", "s")).select("scan_id", (F.col("step") + 1).alias("step"), "s.path")


def retakes(numbers: DataFrame) -> DataFrame:
    """The steps that make pages (scan_id, num) be taken anew: the document goes, then the page, what was stored of it, and the photo."""
    kinds = F.explode(F.array(*[F.lit(k) for k in ORDER]))
    rows = numbers.select("scan_id", "num", kinds.alias("kind")).withColumn("num", F.when(F.col("kind") != "pdf", F.col("num")))
    return plan(rows)


def run(steps: DataFrame, root: str) -> DataFrame:
    """Takes the steps of each scan under ``root/<scan>`` in their order; scan_id, step, path, gone and error for each.

    A step that fails stops those after it in its scan; other scans go on. Tasks delete, a scan in one task.
    """
    rows = steps.select(F.col("scan_id").cast("string").alias("scan_id"), "step", "path").repartition("scan_id").sortWithinPartitions("scan_id", "step")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = located(root)
        scan, stopped = None, None
        for batch in batches:
            gone, errors = [], []
            for s, path in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if s != scan:
                    scan, stopped = s, None
                error = stopped
                if not error:
                    try:
                        if ".." in path.split("/") or "/" in s or s in ("", ".", ".."):
                            raise ValueError(f"{s}/{path} leaves its folder")
                        target = f"{folder}/{s}/{path}"
                        if system.get_file_info(target).type == fs.FileType.File:
                            system.delete_file(target)
                        elif system.get_file_info(target).type != fs.FileType.NotFound:
                            raise ValueError(f"{path} is no file")
                    except (OSError, ValueError) as failed:
                        error, stopped = str(failed), "a step before it failed"
                gone.append(error is None)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gone), pa.array(errors, pa.string())], names=["scan_id", "step", "path", "gone", "error"])

    return rows.mapInArrow(work, "scan_id string, step int, path string, gone boolean, error string")
