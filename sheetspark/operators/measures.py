"""Measures over pixels (image_id, x, y, v or r, g, b) and histograms (image_id, value, n).

Sums are by image, so Spark sums before it shuffles and a hot image is no more than
its distinct values. Windows run over histograms (256 rows an image at most), never
over pixels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetspark.functions import tones
from sheetspark.operators.joined import beside, merged

#: Fixed values of the measures.
NOISE_SHARE = 100  # the darkest hundredth may be noise
BRIGHT_FROM = 64
HUMP_EDGE = 10
EDGE_SHARE, LEAST_STEP, TABLE_SHARE = 0.4, 14.0, 0.25
MOST_TILT = 10
CLEAR_LINES = 4.0
CURVE_LEAST = 50


def by_value(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("value")


def histogram(pixels: DataFrame, value: str = "v", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """How often each brightness occurs in each image."""
    return pixels.groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))


def channel_histograms(pixels: DataFrame, mask: DataFrame | Column | None = None) -> DataFrame:
    """The same for each channel (0 red, 1 green, 2 blue), only on the sheet if a mask tells it.

    A mask is a condition on the pixels' own columns, or a table of pixels (image_id, x, y) to join with.
    """
    if isinstance(mask, DataFrame):
        pixels = on_mask(pixels, mask)
    elif mask is not None:
        pixels = pixels.where(mask)
    # three whole numbers a pixel, whose place in the array is the channel: no row is made for each
    values = F.posexplode(F.array(*[F.col(c).cast("int") for c in "rgb"])).alias("channel", "value")
    return pixels.select("image_id", values).groupBy("image_id", "channel", "value").agg(F.count("*").alias("n"))


#: Columns that one number of a mask holds a bit for, and lines and columns of a picture that one row of it covers at most.
WORD, TILE = 64, 4096


def tiles(mask: DataFrame) -> DataFrame:
    """image_id, top, first, last and bits: a mask's pixels (image_id, x, y) as bits of numbers, a row a picture of up to 4096 lines and columns.

    ``bits`` has numbers for columns 64 ``first`` up to those of ``last``, line by line from ``top`` on. A row covers the box of its pixels only.
    """
    keys = ["image_id", "down", "over"]
    at = mask.where("image_id is not null and x is not null and y is not null").selectExpr("image_id", "cast(x as int) as x", "cast(y as int) as y")
    at = at.selectExpr("*", f"floor(y / {TILE}) as down", f"floor(x / {TILE}) as over", f"cast(floor(x / {WORD}) as int) as w")
    boxes = at.groupBy(*keys).agg(F.min("y").alias("top"), F.max("y").alias("low"), F.min("w").alias("first"), F.max("w").alias("last"))
    grid = boxes.withColumn("y", F.explode(F.sequence("top", "low"))).withColumn("w", F.explode(F.sequence("first", "last")))
    words = at.groupBy(*keys, "y", "w").agg(F.bit_or(F.expr(f"shiftleft(1L, pmod(x, {WORD}))")).alias("bits"))
    rows = merged(grid, words, [*keys, "y", "w"], "left").groupBy(*keys, "top", "first", "last")
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("y", "w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("l"))
    return listed.select("image_id", "top", "first", "last", F.col("l.bits").alias("bits"))


def on_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """The pixels that a mask (image_id, x, y) has.

    They meet the mask by picture alone, as bits, so they stay where they are if they are dealt by picture, unsorted, and only bits move.
    """
    word = f"cast(floor(x / {WORD}) as int)"
    bit = f"get(m.bits, (y - m.top) * (m.last - m.first + 1) + {word} - m.first)"
    on = F.expr(f"p.image_id = m.image_id and y >= m.top and {word} between m.first and m.last and shiftright({bit}, pmod(cast(x as int), {WORD})) & 1L = 1L")
    return beside(pixels.alias("p"), tiles(mask).alias("m"), on, "left_semi")


def walked(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts with what ink and paper are told by, from one sort: all windows have the same order, and a histogram is reckoned once.

    seen: how many pixels have this value or a lower one; total: how many there are; top: the most frequent bright value (the last one
    of equals); hump: whether a value lies below the top and is more than a tenth as frequent; rank: its place among such, from above.
    """
    so_far = by_value(keys).rowsBetween(Window.unboundedPreceding, 0)
    everything = by_value(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.max(F.when(F.col("value") >= BRIGHT_FROM, F.struct("n", "value"))).over(everything)
    rows = counts.withColumns({"seen": F.sum("n").over(so_far), "total": F.sum("n").over(everything), "top": top})
    hump = (F.col("value") < F.col("top.value")) & (F.col("n") > F.floor(F.col("top.n") / HUMP_EDGE))
    rows = rows.withColumn("hump", F.coalesce(hump, F.lit(False)).cast("int"))
    return rows.withColumn("rank", F.sum("hump").over(everything) - F.sum("hump").over(so_far) + 1)


def ink_of_walk() -> Column:
    passed = F.col("seen") > F.floor(F.col("total") / NOISE_SHARE)
    return F.coalesce(F.min(F.when(passed, F.col("value"))), F.lit(0))


def floor_of_walk() -> Column:
    # unbroken steps down from the top have value = top - rank; without a single bright pixel the walk starts at the last value
    step = (F.col("hump") == 1) & (F.col("value") == F.col("top.value") - F.col("rank"))
    return F.coalesce(F.min(F.when(step, F.col("value"))), F.max("top.value"), F.lit(255))


def darkest_ink(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, black: the first value by which more than a hundredth of all pixels is passed."""
    return walked(counts, keys).groupBy(*keys).agg(ink_of_walk().alias("black"))


def paper_floor(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, white: down from the most frequent bright value (the last one of equals) while the next lower is more than a tenth as frequent."""
    return walked(counts, keys).groupBy(*keys).agg(floor_of_walk().alias("white"))


def suggest_levels(pixels: DataFrame, mask: DataFrame | Column | None = None) -> DataFrame:
    """image_id, channel, black, white: what becomes 0 and 255; 0 and 255 where the two are too close."""
    keys = ["image_id", "channel"]
    counts = channel_histograms(pixels, mask).where("image_id is not null")
    both = walked(counts, keys).groupBy(*keys).agg(ink_of_walk().alias("black"), floor_of_walk().alias("white"))
    useful = F.col("white") - F.col("black") >= tones.LEAST_RANGE
    return both.select(*keys, F.when(useful, F.col("black")).otherwise(0).alias("black"), F.when(useful, F.col("white")).otherwise(255).alias("white"))


def otsu_threshold(counts: DataFrame, keys: list[str] = ["image_id"]) -> DataFrame:  # noqa: B006
    """keys, threshold: the split of dark and bright that are furthest apart, weighed by size; the first of equals, else 128."""
    w, everything = by_value(keys).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    mass = F.col("value") * F.col("n")
    c = counts.select(*keys, "value", F.sum("n").over(w).alias("dark"), F.sum(mass).over(w).alias("dark_sum"), F.sum("n").over(everything).alias("all_n"), F.sum(mass).over(everything).alias("all_sum"))
    gap = F.try_divide(F.col("dark_sum"), F.col("dark")) - F.try_divide(F.col("all_sum") - F.col("dark_sum"), F.col("all_n") - F.col("dark"))
    c = c.withColumn("apart", F.col("dark").cast("double") * (F.col("all_n") - F.col("dark")).cast("double") * gap * gap)
    best = F.max(F.when(F.col("apart") > 0, F.struct(F.col("apart"), (-F.col("value")).alias("v"))))
    return c.groupBy(*keys).agg(best.alias("best")).select(*keys, F.coalesce(-F.col("best.v"), F.lit(128)).alias("threshold"))


def middle_brightness(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, middle: the lower median of the counted values."""
    seen = counts.withColumn("seen", F.sum("n").over(by_value(keys).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    return seen.where("2 * seen >= total").groupBy(*keys).agg(F.min("value").alias("middle"))


def paper_and_table(pixels: DataFrame, inside: Column) -> DataFrame:
    """image_id, step, paper, table: what edges of the sheet must clear; no row where the inside isn't brighter."""
    return edge_levels(pixels.groupBy("image_id", inside.alias("inside"), F.col("v").alias("value")).agg(F.count("*").alias("n")))


def edge_levels(counts: DataFrame) -> DataFrame:
    """The same from counts (image_id, inside, value, n)."""
    middles = middle_brightness(counts, ["image_id", "inside"]).groupBy("image_id").pivot("inside", [True, False]).agg(F.first("middle"))
    gap = (F.col("true") - F.col("false")).cast("double")
    return middles.where(gap > 0).select("image_id", F.greatest(gap * EDGE_SHARE, F.lit(LEAST_STEP)).alias("step"), (F.col("false") + gap / 2).alias("paper"), (F.col("false") + gap * TABLE_SHARE).alias("table"))


def tilts(first: float, last: float, step: float) -> Column:
    n = round((last - first) / step)
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.round(F.lit(float(first)) + i * float(step), 6)))


def line_sharpness(pixels: DataFrame, sizes: DataFrame, angles: DataFrame) -> DataFrame:
    """image_id, tilt, sharpness for each row of ``angles`` (image_id, tilt); ``sizes`` has image_id, width, height.

    Pixels fall into bins along lines of that tilt; sharpness is how much the
    profile of mean darkness bends, over bins that cross the whole picture.
    """
    # one row an image and angle, joined to its pixels; the pixels stay where they are if the other side is small
    at = sizes.join(angles, "image_id").withColumn("sin", F.sin(F.radians("tilt"))).withColumn("cos", F.cos(F.radians("tilt")))
    at = at.withColumn("shift", F.when(F.col("sin") > 0, F.col("width") * F.col("sin")).otherwise(0.0))
    at = at.withColumn("last", F.ceil(F.round(F.col("height") * F.col("cos") + F.col("width") * F.abs("sin"), 9)).cast("int"))
    place = F.round(F.col("y") * F.col("cos") - F.col("x") * F.col("sin") + F.col("shift"), 9).cast("int")
    # an image's angles travel as one row, so pixels are matched once and spread after
    at = at.groupBy("image_id").agg(F.collect_list(F.struct("tilt", "sin", "cos", "shift", "last")).alias("angles"))
    spread = pixels.select("image_id", "x", "y", "v").join(at, "image_id").select("image_id", "x", "y", "v", F.explode("angles").alias("a")).select("image_id", "x", "y", "v", "a.*")
    bins = spread.groupBy("image_id", "tilt", F.least(place, "last").alias("bin"))
    return sharpness_of_bins(bins.agg(F.avg(255 - F.col("v")).alias("dark"), F.count("*").alias("n")))


def sharpness_of_bins(bins: DataFrame) -> DataFrame:
    """image_id, tilt, sharpness from each bin's mean darkness and number of pixels."""
    along = Window.partitionBy("image_id", "tilt").orderBy("bin")
    full = F.greatest(F.lit(1), F.floor(F.max("n").over(Window.partitionBy("image_id", "tilt")) * 9 / 10))
    bins = bins.withColumn("full", full)
    for name, move in (("before", F.lag), ("after", F.lead)):
        bins = bins.withColumn(name, move(F.struct("bin", "dark", "n")).over(along))
    whole = (F.col("n") >= F.col("full")) & (F.col("before.n") >= F.col("full")) & (F.col("after.n") >= F.col("full"))
    whole &= (F.col("before.bin") == F.col("bin") - 1) & (F.col("after.bin") == F.col("bin") + 1)
    bend = F.pow(F.col("after.dark") - 2 * F.col("dark") + F.col("before.dark"), 2)
    sums = bins.groupBy("image_id", "tilt").agg(F.sum(F.when(whole, bend)).alias("s"), F.count(F.when(whole, 1)).alias("k"))
    return sums.select("image_id", "tilt", F.when(F.col("k") >= 3, F.col("s") / F.col("k")).otherwise(0.0).alias("sharpness"))


def suggest_straightening(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id, degrees to turn clockwise: none for pictures under eight pixels or without clear lines."""
    return straightening(lambda angles: line_sharpness(pixels, sizes, angles), sizes)


def straightening(sharpness: Callable[[DataFrame], DataFrame], sizes: DataFrame) -> DataFrame:
    """The same from whatever tells the sharpness of each image's angles: whole degrees first, then tenths round the best."""
    large = sizes.where("width >= 8 and height >= 8")
    rough = sharpness(large.select("image_id", tilts(-MOST_TILT, MOST_TILT, 1).alias("tilt")))
    peak = rough.groupBy("image_id").agg(F.max(F.struct(F.round("sharpness", 9).alias("s"), "tilt")).alias("p")).where(F.col("p.s") >= CLEAR_LINES)
    near = peak.select("image_id", F.explode(F.sequence(F.lit(-10), F.lit(10))).alias("k"), "p").select("image_id", F.round(F.col("p.tilt") + F.col("k") / 10, 6).alias("tilt"))
    fine = sharpness(near)
    best = fine.groupBy("image_id").agg(F.max(F.struct(F.round("sharpness", 9).alias("s"), (-F.col("tilt")).alias("t"))).alias("b"))
    found = best.select("image_id", F.when(F.col("b.s") > 0, F.least(F.greatest(F.col("b.t"), F.lit(-10.0)), F.lit(10.0))).otherwise(0.0).alias("degrees"))
    return sizes.select("image_id").join(found, "image_id", "left").select("image_id", F.coalesce("degrees", F.lit(0.0)).alias("degrees"))


def tone_curve(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Mean value after for each value before, where at least fifty pixels have it."""
    pairs = merged(before.select(*keys, "x", "y", F.col("v").alias("value")), after.select(*keys, "x", "y", F.col("v").alias("to")), [*keys, "x", "y"])
    return pairs.groupBy(*keys, "value").agg(F.avg("to").alias("mean_after"), F.count("*").alias("n")).where(F.col("n") >= CURVE_LEAST)


def colour_summary(pixels: DataFrame) -> DataFrame:
    """Mean saturation, channel means and cast (how far red lies over blue) by image."""
    rgb = [F.col(c) for c in "rgb"]
    return pixels.groupBy("image_id").agg(F.avg(tones.saturation(*rgb)).alias("saturation"), *[F.avg(c).alias(f"mean_{c}") for c in "rgb"], F.avg(F.col("r") - F.col("b")).alias("cast"))


def detail(pixels: DataFrame) -> DataFrame:
    """Root mean square of the four-neighbour difference, over pixels that have all four."""
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(k).alias("k")) for dx, dy, k in ((0, 0, -4), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1))])
    spread = pixels.select("image_id", "x", "y", "v", F.explode(shifts).alias("s"))
    at = spread.groupBy("image_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")).agg(F.sum(F.col("v") * F.col("s.k")).alias("d"), F.count("*").alias("n"))
    return at.where("n = 5").groupBy("image_id").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("detail"))


def correlation(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pearson's correlation over every third row and column; 0 without spread."""
    third = "x % 3 = 0 and y % 3 = 0"
    pairs = merged(before.where(third).select("image_id", "x", "y", F.col("v").alias("a")), after.where(third).select("image_id", "x", "y", F.col("v").alias("b")), ["image_id", "x", "y"])
    n, a, b = F.count("*"), F.sum("a"), F.sum("b")
    top = n * F.sum(F.col("a") * F.col("b")) - a * b
    low = F.sqrt((n * F.sum(F.col("a") * F.col("a")) - a * a).cast("double")) * F.sqrt((n * F.sum(F.col("b") * F.col("b")) - b * b).cast("double"))
    return pairs.groupBy("image_id").agg(F.coalesce(F.try_divide(top.cast("double"), low), F.lit(0.0)).alias("correlation"))


def ranked_value(counts: DataFrame, share: float, keys: list[str] = ["image_id"]) -> DataFrame:  # noqa: B006
    """keys, value: the value at place round((n - 1) * share) of all sorted ones, from a histogram."""
    seen = counts.withColumn("seen", F.sum("n").over(by_value(keys).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    return seen.where(F.col("seen") > F.floor((F.col("total") - 1) * share + 0.5)).groupBy(*keys).agg(F.min("value").alias("value"))


def upper_median(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, middle and worst: element n div 2 of the sorted values (counted from 0), and the least.

    For short lists, as edge readings are; a list goes to one row.
    """
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("l"))
    return listed.select(*keys, F.element_at("l", F.expr("cast(size(l) div 2 + 1 as int)")).alias("middle"), F.element_at("l", 1).alias("worst"))
