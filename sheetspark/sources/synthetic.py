"""Images and scan catalogs that are closed forms of a page id, so that any engine can make them.

An image is a sheet with writing on a darker table, 64 by 64 pixels; sheet, margins
and tones depend on the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64


def image_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("image_id"))


def spread(ids: DataFrame) -> DataFrame:
    """Deals ids over the cluster by image, before anything is made of them.

    An id is eight bytes and an image is thousands of pixels, so this is the cheap
    place to shuffle, and sums by image need no other.
    """
    session = ids.sparkSession
    n = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return ids.repartition(n, "image_id")


def pixels(ids: DataFrame, side: int = SIDE) -> DataFrame:
    """image_id, x, y, v, r, g, b, sheet and writing for each pixel of each id.

    Pixels are made where they are used: nothing is shuffled and a later sum by
    image is complete within a task.
    """
    grid = spread(ids).select("image_id", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("y"))
    grid = grid.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("x"), "y")
    sheet, writing, value = tones_at(F.col("x"))
    flat = grid.withColumn("sheet", sheet).withColumn("writing", writing).withColumn("v", value)
    paper = F.col("sheet") & ~F.col("writing")
    return flat.withColumn("r", F.col("v") + F.when(paper, 12).otherwise(0)).withColumn("g", F.col("v")).withColumn("b", F.col("v") - F.when(paper, 10).otherwise(0))


def tones_at(x: Column) -> tuple[Column, Column, Column]:
    """Whether the place x of line y of an image is on the sheet and on writing, and its brightness."""
    i, y = F.col("image_id"), F.col("y")
    sheet = x.between(8 + i % 5, 55 - i % 3) & y.between(6 + i % 7, 57 - i % 4)
    writing = sheet & (y % 6 < 2) & x.between(14, 48) & y.between(15, 50)
    return sheet, writing, F.when(writing, 55 + i % 5).when(sheet, 150 + F.floor(x / 4) + i % 11).otherwise(20 + i % 9).cast("int")


def lines(ids: DataFrame, side: int = SIDE) -> DataFrame:
    """The same images as packed lines: image_id, y and the arrays v, r, g and b.

    An image has three kinds of lines: of table, of paper, and of writing. They are put together from stretches, once an image, and each
    line takes one of them; no place of it is reckoned by itself. Paper is a staircase four places to a step, of which an id that is one
    brighter begins one step further on.
    """
    i, y, n = F.col("image_id"), F.col("y"), max(side, SIDE)
    left, right = (8 + i % 5).cast("int"), (55 - i % 3).cast("int")
    table, ink, step = (20 + i % 9).cast("int"), (55 + i % 5).cast("int"), (4 * (i % 11)).cast("int")
    more = (("v", 0), ("r", 12), ("g", 0), ("b", -10))

    def kinds(add: int) -> tuple[Column, Column]:
        stairs = F.array(*[F.lit(150 + add + k // 4) for k in range(-40, n + 40)])
        paper = lambda a, b: F.slice(stairs, a + step + 41, b - a + 1)
        edge = lambda count: F.array_repeat(table, count)
        written = F.concat(edge(left), paper(left, F.lit(13)), F.array_repeat(ink, F.lit(35)), paper(F.lit(49), right), edge(n - 1 - right))
        return F.concat(edge(left), paper(left, right), edge(n - 1 - right)), written

    cut = lambda line: line if side == n else F.slice(line, 1, side)
    own = [cut(line).alias(f"{kind}_{k}") for k, add in more for kind, line in zip(("plain", "written"), kinds(add), strict=True)]
    rows = spread(ids).select("image_id", cut(F.array_repeat(table, F.lit(n))).alias("bare"), *own)
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    on = y.between(6 + i % 7, 57 - i % 4)
    pick = lambda k: F.when(on & (y % 6 < 2) & y.between(15, 50), F.col(f"written_{k}")).when(on, F.col(f"plain_{k}")).otherwise(F.col("bare"))
    return rows.select("image_id", "y", *[pick(k).alias(k) for k, _ in more])


def scan_files(ids: DataFrame) -> DataFrame:
    """scan_id, kind (photo, page or pdf), num and length: eight numbers to a scan, with gaps."""
    p = ids.select(F.col("image_id").alias("p")).withColumn("s", F.expr("p div 8")).withColumn("num", (F.col("p") % 8 + 1).cast("int"))
    photo = p.where("p % 17 <> 0 and s % 11 <> 10").select("s", F.lit("photo").alias("kind"), "num", (F.col("p") % 997 + 2000).alias("length"))
    page = p.where("(p % 5 <> 0 or s % 4 = 1) and s % 7 <> 5 and s % 11 <> 10").select("s", F.lit("page").alias("kind"), "num", (F.col("p") % 499 + 900).alias("length"))
    pdf = p.where("s % 3 = 0 and s % 7 <> 5 and s % 11 <> 10").select("s").distinct().select("s", F.lit("pdf").alias("kind"), F.lit(None).cast("int").alias("num"), (F.col("s") % 101 + 5000).alias("length"))
    return photo.unionByName(page).unionByName(pdf).withColumnRenamed("s", "scan_id")


def scans(ids: DataFrame) -> DataFrame:
    return ids.select(F.expr("image_id div 8").alias("scan_id")).distinct()


def drawn(image_id: int, width: int = 240, height: int = 320):
    """A photograph of a written sheet on a table, slightly aslant, as an array with red first."""
    import numpy as np

    # a column of lines and a row of places: what depends on one of them only is reckoned once
    y, x = np.arange(height, dtype=float)[:, None], np.arange(width, dtype=float)[None, :]
    lean = (image_id % 5 - 2) / 60
    left, right = 0.15 * width + lean * y, 0.85 * width - lean * y / 2
    top, low = 0.1 * height + lean * x / 2, 0.9 * height - lean * x / 3
    sheet = (x >= left) & (x <= right) & (y >= top) & (y <= low)
    writing = sheet & (y % 16 < 4) & (x >= left + 0.12 * width) & (x <= right - 0.12 * width) & (y > top + 20) & (y < low - 20)
    table = np.uint8(24 + image_id % 9)
    rgb = np.empty((height, width, 3), np.uint8)
    for k, (more, ink) in enumerate(((12, 58), (0, 55), (-10, 52))):
        paper = np.clip(170 + x / 8 + image_id % 11 + more, 0, 255).astype(np.uint8)
        rgb[..., k] = np.where(writing, np.uint8(ink), np.where(sheet, paper, table))
    return rgb


def photos(ids: DataFrame, width: int = 240, height: int = 320) -> DataFrame:
    """image_id and image: a drawn photo for each id."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    from sheetspark.operators import images

    kind = to_arrow_type(images.IMAGE)

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([images.to_image(drawn(i, width, height))], kind)], names=["image_id", "image"])

    return spread(ids.select("image_id")).mapInArrow(run, T.StructType([T.StructField("image_id", T.LongType()), T.StructField("image", images.IMAGE)]))
