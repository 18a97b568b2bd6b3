"""Acts on pixels: each takes and returns image_id, x, y and channels. Nothing here shuffles but flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetspark.functions import geometry, tones
from sheetspark.operators.joined import beside, merged


def rotate(pixels: DataFrame, degrees: int, width: Column, height: Column) -> DataFrame:
    """Turns by quarter turns, clockwise; other angles are refused."""
    x, y = F.col("x"), F.col("y")
    ways = {0: (x, y), 90: (height - 1 - y, x), 180: (width - 1 - x, height - 1 - y), 270: (y, width - 1 - x)}
    if degrees % 360 not in ways:
        raise ValueError(f"{degrees} degrees are no quarter turn")
    to = ways[degrees % 360]
    return pixels.withColumns({"x": to[0], "y": to[1]})


def crop(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The pixels of a box, counted from its corner. Whether it fits is for ``geometry.fits_inside``."""
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return pixels.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def to_grey(pixels: DataFrame) -> DataFrame:
    rest = [c for c in pixels.columns if c not in ("r", "g", "b", "v")]
    return pixels.select(*rest, tones.luma(F.col("r"), F.col("g"), F.col("b")).alias("v"))


def apply_levels(pixels: DataFrame, levels: DataFrame) -> DataFrame:
    """Stretches each channel by its levels (image_id, channel, black, white), then calms faint colour.

    An image's levels are one row of six numbers, which its pixels meet where they are dealt by image; a pixel is neither sorted nor
    carries more than these. Images without levels, or whose levels change nothing, stay as they are.
    """
    return stretched(beside(pixels, ends(levels), "image_id", "left")).select(*pixels.columns)


#: The columns that levels are in a row an image.
ENDS = [f"{end}_{c}" for c in "rgb" for end in ("black", "white")]


def ends(levels: DataFrame) -> DataFrame:
    """image_id, black_r, white_r and so on: a row an image of those whose levels change anything; null for a channel that stays."""
    changed = levels.where((F.col("black") != 0) | (F.col("white") != 255))
    return changed.groupBy("image_id").agg(*[F.max(F.when(F.col("channel") == k, F.col(end))).alias(f"{end}_{c}") for k, c in enumerate("rgb") for end in ("black", "white")])


def stretched(rows: DataFrame) -> DataFrame:
    """Pixels that go along with their image's ends, stretched and calmed.

    Each step stands in a projection of its own, and is used more than once by the next. Spark leaves such steps apart, so a pixel
    reckons each once, in methods that are short enough for Java to compile; as one expression they are repeated where they are used.
    """

    def spread(c: str) -> Column:
        v = F.col(c).cast("int")
        return F.when(F.col(f"white_{c}").isNotNull() & v.between(0, 255), tones.stretched(v, F.col(f"black_{c}"), F.col(f"white_{c}"))).otherwise(v)

    s = {c: F.col(f"s{c}") for c in "rgb"}
    rows = rows.withColumns({f"s{c}": spread(c) for c in "rgb"})
    rows = rows.withColumns({"high": F.greatest(*s.values()), "low": F.least(*s.values())})
    rows = rows.withColumns({"out": tones.colour_to_take(F.col("high"), F.col("low")), "grey": tones.grey_sum(*s.values())})
    stays = F.coalesce(*[F.col(f"white_{c}") for c in "rgb"]).isNull() | tones.colour_meant(F.col("high"), F.col("out"))
    rows = rows.withColumn("stays", stays)
    return rows.withColumns({c: F.when(F.col("stays"), v).otherwise(tones.towards(v, F.col("grey"), F.col("out"))) for c, v in s.items()})


def scanlines(pixels: DataFrame) -> DataFrame:
    """image_id, y, line and below: the colours of each line and of the next (of the last one, its own), in order of x.

    A colour is one whole number, red first. A line is the largest thing that a row holds; pictures
    must have all their pixels, once.
    """
    colour = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    lines = pixels.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct(F.col("x"), colour.cast("int").alias("c")))).alias("p"))
    lines = lines.select("image_id", "y", F.col("p.c").alias("line"))
    return lines.withColumn("below", F.coalesce(F.lead("line").over(Window.partitionBy("image_id").orderBy("y")), F.col("line")))


def flatten(pixels: DataFrame, corners: DataFrame) -> DataFrame:
    """Pulls sheets flat: image_id, x, y, r, g, b of the rectangles.

    ``corners`` has image_id, width, height and c0 to c7, the corners' x and y,
    clockwise from the top left. Each target pixel lies between two lines of the
    source; it meets both in one join on (image_id, y), by which both sides spread
    evenly, and takes its four neighbours from them by place.
    """
    c = [F.col(f"c{k}") for k in range(8)]
    w, h = geometry.flat_size(c)
    rows = corners.select("image_id", "width", "height", w.alias("w"), h.alias("h"), *[v.alias(k) for k, v in geometry.flatten_map(c).items()]).where("w >= 2 and h >= 2 and wa is not null")
    grid = rows.withColumn("y", F.explode(F.expr("sequence(0, h - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, w - 1)")))
    across, down = (F.col("x") + 0.5) / F.col("w"), (F.col("y") + 0.5) / F.col("h")
    weight = F.col("wa") * across + F.col("wb") * down + 1
    from_x = (F.col("ax") * across + F.col("bx") * down + F.col("x0")) / weight
    from_y = (F.col("ay") * across + F.col("by") * down + F.col("y0")) / weight
    held = lambda v, size: F.round(F.least(F.greatest(v, F.lit(0.0)), F.col(size) - 1.0), 6)
    grid = grid.select("image_id", F.col("x").alias("tx"), F.col("y").alias("ty"), held(from_x, "width").alias("fx"), held(from_y, "height").alias("fy"))
    met = merged(grid.withColumn("y", F.floor("fy").cast("int")), scanlines(pixels), ["image_id", "y"])
    left = F.floor("fx").cast("int")
    spots = {"a": ("line", left), "b": ("line", left + 1), "c": ("below", left), "d": ("below", left + 1)}
    # beyond the last pixel of a line its share is nothing
    met = met.select("image_id", "tx", "ty", (F.col("fx") - left).alias("sx"), (F.col("fy") - F.col("y")).alias("sy"), *[F.coalesce(F.get(line, at), F.lit(0)).alias(k) for k, (line, at) in spots.items()])
    shares = {"a": "(1 - sx) * (1 - sy)", "b": "sx * (1 - sy)", "c": "(1 - sx) * sy", "d": "sx * sy"}
    mixed = {n: F.expr("round(" + " + ".join(f"(shiftright({k}, {shift}) & 255) * {share}" for k, share in shares.items()) + ", 6)") for n, shift in (("r", 16), ("g", 8), ("b", 0))}
    return met.select("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"), *[tones.half_up(v).alias(n) for n, v in mixed.items()])


def digest(pixels: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """image_id, n_pixels and a sum that weighs each channel by where it stands; tells acts apart."""
    weighed = sum((F.col(c).cast("bigint") * (F.col("x") * 31 + F.col("y") * 17 + k + 1) for k, c in enumerate(channels)), F.lit(0).cast("bigint"))
    return pixels.groupBy("image_id").agg(F.count("*").alias("n_pixels"), F.sum(weighed).alias("weighed"))
