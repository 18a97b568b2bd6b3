"""The sheet in a picture, as relations: rays, side lines, quadrilaterals.

Pixels here are image_id, x, y, v, inside (on the rough sheet) and outside (table
that reaches the border).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetspark.functions import geometry
from sheetspark.kernels import paper
from sheetspark.operators import lines as packed
from sheetspark.operators.joined import beside, merged
from sheetspark.sources.scratch import Rounds

#: Fixed values of the search.
EDGE_SAMPLES, STAYS_DARK = 3, 10
CORNER_PART = 6
SPAN = 20
TRIM = 12
FEWEST_POINTS = 8
MOST_INWARD, MOST_LEAN = 60.0, 12
QUAD_ON_SHEET, SHEET_IN_QUAD, CARRIED_ON = 0.85, 0.90, 0.30
JUST_PAST, WELL_PAST = 4, 10
#: And of the second reading: how many places a side, how far each looks, how wide the step, what it loses for safety.
READINGS, REACH, GAP, FEWEST_READINGS, HAIR, INWARD = 29, 60, 2, 5, 1.5, 0.5
ENDS = {"left": ("c1", "c7"), "right": ("c3", "c5"), "top": ("c0", "c2"), "bottom": ("c6", "c4")}

SIDES = (("left", "y", "x", -1), ("right", "y", "x", 1), ("top", "x", "y", -1), ("bottom", "x", "y", 1))


def bounds(mask: DataFrame) -> DataFrame:
    """image_id, area and the box of a mask's pixels."""
    return mask.groupBy("image_id").agg(
        F.count("*").alias("area"), F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom")
    )


def runs_off(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id and whether the mask touches the border."""
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("width") - 1) | (F.col("y") == F.col("height") - 1)
    return mask.join(sizes, "image_id").groupBy("image_id").agg(F.bool_or(edge).alias("runs_off"))


def extreme_corners(mask: DataFrame) -> DataFrame:
    """The mask's pixels furthest to the four corners, clockwise; of equals the first row by row."""
    first = F.struct(F.col("y"), F.col("x"))
    order = lambda key: F.struct(key.alias("k"), first.alias("p"))
    s, d = F.col("x") + F.col("y"), F.col("x") - F.col("y")
    picks = mask.groupBy("image_id").agg(*[F.min(order(k)).alias(n) for n, k in (("tl", s), ("tr", -d), ("br", -s), ("bl", d))])
    return picks.select("image_id", *[F.col(f"{n}.p.{c}").alias(f"{n}_{c}") for n in ("tl", "tr", "br", "bl") for c in "xy"])


def middle_of_lines(pixels: DataFrame, along: str, across: str) -> DataFrame:
    """image_id, along, start: element n div 2 of the pixels inside on each line."""
    rank = Window.partitionBy("image_id", along).orderBy(across)
    ranked = pixels.where("inside").withColumn("k", F.row_number().over(rank) - 1).withColumn("n", F.count("*").over(Window.partitionBy("image_id", along)))
    return ranked.where(F.col("k") == F.expr("n div 2")).select("image_id", along, F.col(across).alias("start"))


def edge_points(pixels: DataFrame, levels: DataFrame, boxes: DataFrame) -> DataFrame:
    """image_id, side, along, across: where each ray from the middle of its line leaves the paper.

    A place counts where it is brighter within than beyond by a step, paper within,
    table beyond, and table for ten pixels more. Pixels are put together to lines as soon as they are met, and a line is read both ways
    at once; so the work spreads over lines, however large one image is. Pixels of lines that no ray begins on go no further.
    """
    of = merged(levels.select("image_id", "step", "paper", "table"), boxes.select("image_id", "left", "top", "right", "bottom"), "image_id")
    pixels = beside(pixels.select("image_id", "x", "y", "v", "inside", "outside"), of, "image_id")
    found = None
    for along, across, low, high in (("y", "x", "top", "bottom"), ("x", "y", "left", "right")):
        # the place in a line, and below it the brightness and whether it is inside and outside
        pixel = F.expr(f"shiftleft(cast({across} as long), 32) + shiftleft(cast(v as long), 2) + if(outside, 2, 0) + if(inside, 1, 0)")
        rows = pixels.where(rays_begin(along, F.col(low), F.col(high))).select("image_id", along, pixel.alias("p"), "step", "paper", "table")
        rows = rows.groupBy("image_id", along).agg(F.collect_list("p").alias("p"), *[F.first(c).alias(c) for c in ("step", "paper", "table")])
        edges = edges_in(rows, along, lambda p: (p << 32 >> 34, p & 1, p >> 1 & 1, p >> 32))
        found = edges if found is None else found.unionByName(edges)
    return found


def rays_begin(along: str, low: Column, high: Column) -> Column:
    """Whether rays begin on a line: not on those near the ends of the rough sheet."""
    size = high - low + 1
    skip = F.floor(size / CORNER_PART)
    return (F.col(along) >= low + skip) & (F.col(along) < low + size - skip)


def edges_in(rows: DataFrame, along: str, told: Callable[[np.ndarray], tuple]) -> DataFrame:
    """The edges of lines (image_id, along, an array, step, paper and table), those of one length together.

    ``told`` gives brightness, inside and outside of an array's elements, and their places, by which they are put in order, or None
    where elements stand at their places.
    """
    sides = [s for s, a, *_ in SIDES if a == along]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for n in np.unique(lengths):
                of = np.flatnonzero(lengths == n)
                part = batch.take(pa.array(of))
                v, inside, outside, place = told(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(of), n))
                if place is not None:
                    order = np.argsort(place, axis=1, kind="stable")
                    v, inside, outside, place = (np.take_along_axis(c, order, 1) for c in (v, inside, outside, place))
                inside = np.cumsum(inside, axis=1)
                some = inside[:, -1] > 0 if n else np.zeros(len(of), bool)
                if not some.any():
                    continue
                part, v, inside, outside = part.filter(pa.array(some)), v[some], inside[some], outside[some]
                # element n div 2 of the places inside; a ray that begins nearer to an end than three places can only find what lies further in
                starts = np.clip((inside > inside[:, -1:] // 2).argmax(axis=1), EDGE_SAMPLES - 1, n - EDGE_SAMPLES)
                levels = [part.column(k).to_numpy(zero_copy_only=False)[:, None] for k in (3, 4, 5)]
                for side, at, out in zip(sides, paper.leaving(v, outside, starts, levels), (-0.5, 0.5)):
                    found = np.flatnonzero(at >= 0)
                    where = at[found] if place is None else place[some][found, at[found]]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(found)), pa.array([side] * len(found), pa.string()), part.column(1).take(pa.array(found)), pa.array(where + out)], names=["image_id", "side", "along", "across"])

    return rows.mapInArrow(run, T.StructType([rows.schema["image_id"], *T.StructType.fromDDL("side string, along int, across double").fields]))


def edges_of_lines(lines: DataFrame, boxes: DataFrame, along: str) -> DataFrame:
    """``edge_points`` of the two sides that lines of pictures cross, from packed lines or columns (image_id, along, v).

    Values tell by ``runs.marked`` where the rough sheet and the table are. ``boxes`` has image_id, low and high (the first and last line of
    the rough sheet), step, paper and table. A line is read both ways where it is, lines of one length together.
    """
    rows = beside(lines.select("image_id", along, "v"), boxes.select("image_id", "low", "high", "step", "paper", "table"), "image_id")
    rows = rows.where(rays_begin(along, F.col("low"), F.col("high"))).select("image_id", along, "v", "step", "paper", "table")
    return edges_in(rows, along, lambda v: (v & 255, v >> 8 & 1, v >> 9 & 1, None))


def upper(value: str) -> Column:
    return F.expr(f"element_at(sort_array(collect_list({value})), cast(count({value}) div 2 + 1 as int))")


def fit_sides(points: DataFrame) -> DataFrame:
    """image_id, side, slope, offset: the line through the points of each side, strays trimmed.

    The median of slopes over pairs at least twenty apart gives the first line; the
    points within twelve of it, at least half of all, give the last by least squares.
    A side has a point a line of the small copy, so its pairs are bounded by that.
    """
    keys = ["image_id", "side"]
    enough = points.groupBy(*keys).agg(F.count("*").alias("total")).where(F.col("total") >= FEWEST_POINTS)
    points = points.join(enough, keys)
    a, b = points.alias("a"), points.alias("b")
    pairs = a.join(b, F.expr(f"a.image_id = b.image_id and a.side = b.side and b.along > a.along and abs(b.along - a.along) >= {SPAN}"))
    slopes = pairs.select("a.image_id", "a.side", F.expr("(b.across - a.across) / (b.along - a.along)").alias("s")).groupBy(*keys).agg(upper("s").alias("s0"))
    lined = points.join(slopes, keys).withColumn("o", F.expr("across - s0 * along"))
    lined = lined.join(lined.groupBy(*keys).agg(upper("o").alias("o0")), keys)
    kept = lined.where(f"abs(across - (s0 * along + o0)) <= {TRIM}").groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("total").alias("total"), F.regr_slope("across", "along").alias("slope"), F.regr_intercept("across", "along").alias("offset")
    )
    return kept.where("2 * n >= total and slope is not null").select(*keys, "slope", "offset")


def quadrilaterals(sides: DataFrame) -> DataFrame:
    """image_id, the four lines (ls, lo, rs, ro, ts, to, bs, bo) and the corners c0 to c7 where they cross."""
    wide = sides.groupBy("image_id").agg(*[F.max(F.when(F.col("side") == s, F.col(v))).alias(s[0] + v[0]) for s, *_ in SIDES for v in ("slope", "offset")]).dropna()
    corners: list[Column] = []
    for v, h in (("l", "t"), ("r", "t"), ("r", "b"), ("l", "b")):
        corners += geometry.crossing(F.col(f"{v}s"), F.col(f"{v}o"), F.col(f"{h}s"), F.col(f"{h}o"))
    return wide.select("*", *[c.alias(f"c{k}") for k, c in enumerate(corners)]).dropna()


def quad_shares(pixels: DataFrame, quads: DataFrame) -> DataFrame:
    """image_id, rough_area, quad_area, shared_area: pixels on the rough sheet, between the lines, and both.

    A picture's lines are one row of eight numbers, which its pixels meet where they are dealt by image.
    """
    between = F.expr("x >= ls * y + lo and x <= rs * y + ro and y >= ts * x + to and y <= bs * x + bo")
    lines = quads.select("image_id", *[f"{s[0]}{v}" for s, *_ in SIDES for v in "so"])
    return beside(pixels, lines, "image_id").groupBy("image_id").agg(F.count_if("inside").alias("rough_area"), F.count_if(between).alias("quad_area"), F.count_if(between & F.col("inside")).alias("shared_area"))


def carried_on(pixels: DataFrame, quads: DataFrame) -> DataFrame:
    """image_id, side, share: of each side's length, where the sheet goes on four to ten pixels beyond it."""
    asked = None
    for side, along, across, outward in SIDES:
        a, b = ENDS[side]
        line = F.expr(f"{side[0]}s * along + {side[0]}o")
        q = quads.withColumn("from", F.expr(f"cast(least({a}, {b}) as int)")).withColumn("upto", F.expr(f"cast(greatest({a}, {b}) as int)"))
        q = q.withColumn("along", F.explode(F.expr("sequence(from, upto)"))).withColumn("off", F.explode(F.sequence(F.lit(JUST_PAST), F.lit(WELL_PAST))))
        at = F.floor(line + outward * F.col("off")).cast("int")
        q = q.select("image_id", F.lit(side).alias("side"), "from", "upto", "along", F.col("along").alias(along), at.alias(across))
        asked = q if asked is None else asked.unionByName(q)
    # the pixels that all four sides ask for meet the mask once
    reach = merged(asked, pixels.where("inside").select("image_id", "x", "y", F.lit(1).alias("on")), ["image_id", "x", "y"], "left")
    reach = reach.groupBy("image_id", "side", "from", "upto", "along").agg(F.count("on").alias("n"))
    share = F.count_if(F.col("n") == WELL_PAST - JUST_PAST + 1) / F.greatest(F.lit(1), F.max(F.col("upto") - F.col("from") + 1))
    return reach.groupBy("image_id", "side").agg(share.alias("share"))


def leans(readings: DataFrame) -> DataFrame:
    """image_id, side, lean: of -12 to 12, the one that leaves the least bow; of equals the smaller, then the positive.

    ``readings`` has image_id, side, part (share of the side) and miss.
    """
    # a side's readings are one row, and its leans no rows at all
    rows = readings.where("part is not null and miss is not null").groupBy("image_id", "side").agg(F.collect_list(F.struct(F.col("part").cast("double").alias("part"), F.col("miss").cast("double").alias("miss"))).alias("l"))
    kind = T.StructType([rows.schema["image_id"], rows.schema["side"], *T.StructType.fromDDL("lean int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, of = packed.ends_of(batch.column(2)), batch.column(2).flatten()
            part, miss = (of.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            best = np.zeros(batch.num_rows, np.int32)
            sizes = np.diff(begin)
            for n in np.unique(sizes[sizes > 0]):  # sides with as many readings are tried together
                some = np.flatnonzero(sizes == n)
                for own in np.array_split(some, max(1, len(some) * int(n) * len(paper.LEANS) // packed.AT_ONCE)):
                    at = begin[own][:, None] + np.arange(n)
                    level = np.sort(miss[at][:, None, :] - paper.LEANS[:, None] * part[at][:, None, :], axis=2)
                    bow = np.floor((level[:, :, n // 2] - level[:, :, 0]) * 1e6 + 0.5)
                    best[own] = paper.LEANS[bow.argmin(axis=1)]  # the smaller stand first, and of them the positive
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(best)], names=["image_id", "side", "lean"])

    return rows.mapInArrow(run, kind)


def places(readings: DataFrame) -> DataFrame:
    """image_id, side, place: the innermost reading, but at most sixty inside of their median."""
    return readings.groupBy("image_id", "side").agg(F.greatest(F.min("miss"), upper("miss") - MOST_INWARD).alias("place"))


def feet(quads: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id, side, k, part, slope, offset, begin, end, and fx, fy: places along each side, as points of the photo.

    ``sizes`` has image_id, width and height of the photo, small_width and small_height of the copy that the sides are told on.
    """
    sides = []
    for side, along, _, outward in SIDES:
        a, b = ENDS[side]
        sides.append(F.struct(F.lit(side).alias("side"), F.lit(along == "y").alias("upright"), F.lit(outward).alias("outward"), F.col(f"{side[0]}s").alias("slope"), F.col(f"{side[0]}o").alias("offset"), F.col(a).alias("begin"), F.col(b).alias("end")))
    rows = quads.select("image_id", F.explode(F.array(*sides)).alias("s")).select("image_id", "s.*").join(sizes, "image_id")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(READINGS)))).withColumn("part", F.col("k") / (READINGS + 1))
    rows = rows.withColumn("along", F.col("begin") + (F.col("end") - F.col("begin")) * F.col("part"))
    rows = rows.withColumn("across", F.col("slope") * F.col("along") + F.col("offset"))
    x, y = F.when(F.col("upright"), F.col("across")).otherwise(F.col("along")), F.when(F.col("upright"), F.col("along")).otherwise(F.col("across"))
    return rows.withColumns({"fx": (x + 0.5) * F.col("width") / F.col("small_width"), "fy": (y + 0.5) * F.col("height") / F.col("small_height")})


def readings_in_photo(places: DataFrame, lines: DataFrame, steps: DataFrame) -> DataFrame:
    """image_id, side, part, miss: how far outward of each place the steepest fall in tone lies, where it is a ``step`` or more.

    A ray of an upright side is a stretch of one line, one of a level side a stretch of one column, and only the columns that are asked for
    are put together. A ray meets its line or column once, and takes its stretch along. Tones are means of three; a fall
    is from one mean to that six pixels on.
    """
    reach = REACH + GAP + 2
    whole = lambda c: F.floor(c).cast("int")
    ask = ["image_id", "side", "k", "outward"]
    upright = places.where("upright and fy >= 0 and fy < height").select(*ask, F.col("fx").alias("f"), whole("fy").alias("y"))
    level = places.where("not upright and fx >= 0 and fx < width").select(*ask, F.col("fy").alias("f"), whole("fx").alias("x"))
    some = level.groupBy("image_id").agg(F.sort_array(F.collect_set("x")).alias("asked"))
    turned = packed.columns(beside(lines.select("image_id", "y", *packed.RGB), some, "image_id"), asked="asked")
    rgb = lines.select("image_id", "y", *packed.RGB)
    first = F.greatest(F.lit(0), whole("f") - reach - 1)
    cut = [F.slice(c, F.col("first") + 1, 2 * reach + 4).alias(c) for c in packed.RGB]
    rays = None
    for rows, of, by in ((upright, rgb, "y"), (level, turned, "x")):
        met = merged(rows.withColumn("first", first), of, ["image_id", by]).select(*ask, "f", "first", F.size("r").alias("n"), *cut)
        rays = met if rays is None else rays.unionByName(met)
    apart = 2 * GAP + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outward, f, first, n = (batch.column(k).to_numpy(zero_copy_only=False)[:, None] for k in (3, 4, 5, 6))
            spot = f + outward * np.arange(-reach, reach + 1)[None, :]
            on = (spot >= 0) & (spot < n)
            begin = packed.ends_of(batch.column(7))[:-1, None]
            at = (begin + np.floor(spot).astype(np.int64) - first)[on]
            r, g, b = (c.flatten().to_numpy(zero_copy_only=False)[at] for c in batch.columns[7:])
            tones = np.full(spot.shape, np.nan)  # NaN off the picture
            tones[on] = np.round(0.299 * r + 0.587 * g + 0.114 * b, 6)
            mean = (tones[:, :-2] + tones[:, 1:-1] + tones[:, 2:]) / 3
            fall = np.round(np.nan_to_num(mean[:, : 2 * REACH + 1] - mean[:, apart : apart + 2 * REACH + 1], nan=0.0), 6)
            steepest = fall.argmax(axis=1)
            best = fall[np.arange(len(fall)), steepest]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best), pa.array((steepest - REACH).astype(float))], names=["image_id", "side", "k", "fall", "miss"])

    best = rays.mapInArrow(run, T.StructType([*[rays.schema[c] for c in ("image_id", "side", "k")], *T.StructType.fromDDL("fall double, miss double").fields]))
    best = merged(best, steps, "image_id").where("fall > 0 and fall >= step")
    return best.select("image_id", "side", (F.col("k") / (READINGS + 1)).alias("part"), "miss")


def sides_read_again(quads: DataFrame, lines: DataFrame, sizes: DataFrame, steps: DataFrame) -> DataFrame:
    """image_id, side, slope, offset: the sides where the photo has them, on the small copy.

    Where too few places of a side can be read, it moves inward by half a pixel instead.
    """
    places_of = feet(quads, sizes)
    # what is read in the photo goes into the result by several ways, and is read once
    read = Rounds(lines.sparkSession, "readings").write(readings_in_photo(places_of, lines, steps))
    enough = read.groupBy("image_id", "side").agg(F.count("*").alias("n")).where(F.col("n") >= FEWEST_READINGS)
    read = read.join(enough, ["image_id", "side"])
    sides = places_of.where("k = 1").select("image_id", "side", "upright", "outward", "slope", "offset", "begin", "end", "width", "height", "small_width", "small_height")
    long = sides.where("abs(end - begin) >= 1").select("image_id", "side")
    lean = leans(read.join(long, ["image_id", "side"], "left_semi"))
    level = read.join(lean, ["image_id", "side"], "left").withColumn("lean", F.coalesce("lean", F.lit(0))).withColumn("miss", F.col("miss") - F.col("lean") * F.col("part"))
    placed = places(level).join(level.groupBy("image_id", "side").agg(F.first("lean").alias("lean")), ["image_id", "side"])
    rows = sides.join(placed, ["image_id", "side"], "left")
    unit = F.col("outward") * F.when(F.col("upright"), F.col("small_width") / F.col("width")).otherwise(F.col("small_height") / F.col("height"))
    rate = F.when(F.abs(F.col("end") - F.col("begin")) >= 1, F.col("lean") / (F.col("end") - F.col("begin"))).otherwise(0.0)
    read_at = F.col("place").isNotNull()
    slope = F.when(read_at, F.col("slope") + unit * rate).otherwise(F.col("slope"))
    offset = F.when(read_at, F.col("offset") + unit * (F.col("place") - HAIR - rate * F.col("begin"))).otherwise(F.col("offset") - F.col("outward") * INWARD)
    return rows.select("image_id", "side", slope.alias("slope"), offset.alias("offset"))
