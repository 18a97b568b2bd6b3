"""Pictures as packed lines (image_id, y, an array for each channel): filters, sizes, tilts and flattening.

A line is a row, so a neighbour across is an element and a neighbour down is another row of a small window;
what moves between tasks is lines, never pixels. A picture's lines are all there, once, from 0 on.
Sums are whole numbers, rounded once, halves upwards, at the end, so any engine finds the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from sheetspark.functions import geometry, tones
from sheetspark.operators import acts, measures
from sheetspark.operators.joined import beside, merged
from sheetspark.sources.scratch import Rounds

RGB = ("r", "g", "b")
MOST_RADIUS = 20
#: Lines of a picture that go to one task where neighbours are worked on together.
BAND = 4096
#: What is added before a bin is cut to a whole number: places are exact to nine digits.
NINTH = 5e-10


def packed(pixels: DataFrame, values: tuple[str, ...] = RGB) -> DataFrame:
    """Lines from pixels (image_id, x, y and values)."""
    rows = pixels.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", *values))).alias("l"))
    return rows.select("image_id", "y", *[F.col(f"l.{c}").alias(c) for c in values])


def unpacked(lines: DataFrame, values: tuple[str, ...] = RGB) -> DataFrame:
    """image_id, x, y and values of each pixel."""
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in values])
    rows = lines.select("image_id", "y", F.posexplode(zipped).alias("x", "p"))
    return rows.select("image_id", "x", "y", *[F.col(f"p.{c}").alias(c) for c in values])


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over as many tasks as the session has: a line is few bytes and much work, so tasks mustn't be merged by bytes."""
    session = df.sparkSession
    return df.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), *keys)


def divided(total: Column, by: Column | int) -> Column:
    """A whole sum over a whole weight, rounded, halves upwards."""
    by = by if isinstance(by, Column) else F.lit(by)
    return F.floor((2 * total + by) / (2 * by).cast("double")).cast("int")


# ---- filters


def gaussian(radius: float, scale: int = 256) -> list[int]:
    """A bell of this standard deviation as whole weights, cut at twice of it."""
    reach = max(1, math.ceil(2 * radius))
    return [math.floor(scale * math.exp(-(x * x) / (2 * radius * radius)) + 0.5) for x in range(-reach, reach + 1)]


def with_neighbours(lines: DataFrame, values: tuple[str, ...], reach: int, work: Callable[[np.ndarray, int, int], np.ndarray], more: list[str], kind: str) -> DataFrame:
    """Lines with ``values`` replaced by what ``work`` makes of them (arrays of ``kind``); the columns ``more`` go along as they are.

    Work takes a table of lines of one picture that follow one another, and from which to which of them it is asked for; ``reach`` lines
    before and after those are there, as far as the picture has them. A task holds the lines of an Arrow batch and those beside it.
    """
    out = T.StructType([*[lines.schema[c] for c in ("image_id", "y", *more)], *T.StructType.fromDDL(", ".join(f"{c} array<{kind}>" for c in values)).fields])
    n = len(values)

    def made(rows: pa.RecordBatch, a: int, b: int) -> pa.RecordBatch:
        tables = []
        for c in rows.columns[rows.num_columns - n :]:
            width = c.value_lengths().to_numpy()
            if (width != width[0]).any():
                raise ValueError("the lines of a picture have one width")
            tables.append(work(c.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(rows.num_rows, width[0]), a, b))
        return pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in rows.columns[: rows.num_columns - n]], *map(lists, tables)], schema=to_arrow_schema(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0  # lines of a picture that may go on, and how many of them are through
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            cuts = stretches([rows.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()])
            for a, b in zip(cuts, cuts[1:-1]):
                yield made(rows.slice(a, b - a), done, int(b - a))
                done = 0
            held = rows.slice(int(cuts[-2]))
            ready = held.num_rows - reach
            if ready > done:
                yield made(held, done, ready)
                past = max(ready - reach, 0)
                held, done = held.slice(past), ready - past
        if held is not None:
            yield made(held, done, held.num_rows)

    rows = dealt(lines.select("image_id", "y", *more, *values), "image_id").sortWithinPartitions("image_id", "y")
    return rows.mapInArrow(run, out)


def blurred(table: np.ndarray, weights: list[int], first: int, last: int) -> np.ndarray:
    """The weighted sums of neighbours across and down of the lines from ``first`` to ``last``, edges repeated."""
    reach, (height, width) = len(weights) // 2, table.shape
    most = max(abs(int(table.min())), abs(int(table.max()))) if table.size else 0
    table = table.astype(np.int32 if most * sum(map(abs, weights)) ** 2 < 1 << 31 else np.int64)
    low, high = max(first - reach, 0), min(last + reach, height)
    padded = np.pad(table[low:high], ((0, 0), (reach, reach)), mode="edge") if width else table[low:high]
    total = 0
    for axis in (1, 0):
        if axis == 0:
            before, after = reach - (first - low), reach - (high - last)
            padded = np.pad(total, ((before, after), (0, 0)), mode="edge")
        total = np.zeros((high - low, width) if axis else (last - first, width), table.dtype)
        for k, weight in enumerate(weights):
            if weight:
                total += (padded[:, k : k + width] if axis else padded[k : k + last - first]) * table.dtype.type(weight)
    return total


def filtered(lines: DataFrame, weights: list[int], values: tuple[str, ...] = RGB) -> DataFrame:
    """Lines with ``values`` replaced by the weighted sums of their neighbours across and down (long), edges repeated.

    ``weights`` goes from the left (or above) to the right, with the pixel itself in the middle. A picture's lines come to a task in
    order, which holds as many of them as there are weights beside those of an Arrow batch.
    """
    reach = len(weights) // 2
    if len(weights) != 2 * reach + 1 or sum(weights) <= 0:
        raise ValueError("weights have a middle, and are more than nothing together")
    return with_neighbours(lines, values, reach, lambda table, a, b: blurred(table, weights, a, b).astype(np.int64), [], "bigint")


def sharpened(lines: DataFrame, radius: float, values: tuple[str, ...] = RGB) -> DataFrame:
    """Adds back what a blur takes away, cut to 0 to 255."""
    if not 0 < radius <= MOST_RADIUS:
        raise ValueError(f"the radius is over 0 and at most {MOST_RADIUS} pixels, not {radius}")
    weights = gaussian(radius)
    by = sum(weights) ** 2

    def crisp(table: np.ndarray, a: int, b: int) -> np.ndarray:
        soft = (2 * blurred(table, weights, a, b).astype(np.int64) + by) // (2 * by)
        return np.clip(2 * table[a:b] - soft, 0, 255).astype(np.int32)

    return with_neighbours(lines, values, len(weights) // 2, crisp, [], "int")


# ---- sizes


@lru_cache(maxsize=256)
def weights(kind: str, size: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the target (of ``to``) the places of the source (of ``size``) that may count, and how much, as whole numbers.

    box: how much of the source pixel lies under the target pixel. triangle: falls off evenly from the middle of the
    target pixel, over a target pixel's width each way, or a source pixel's if those are wider. lanczos: three such widths.
    """
    if kind not in ("box", "triangle", "lanczos"):
        raise ValueError(f"a filter is box, triangle or lanczos, not {kind}")
    wide = max(size, to)
    over = {"box": 0, "triangle": 1, "lanczos": 3}[kind] * wide
    target = np.arange(to, dtype=np.int64)[:, None]
    taps = int((size + 2 * over) // to) + 2
    source = (target * size - over) // to + np.arange(taps, dtype=np.int64)[None, :]
    if kind == "box":
        share = np.minimum((target + 1) * size, (source + 1) * to) - np.maximum(target * size, source * to)
    else:
        apart = np.abs((2 * source + 1) * to - (2 * target + 1) * size)
        if kind == "triangle":
            share = 2 * wide - apart
        else:
            d = apart / float(2 * wide) * math.pi
            bell = np.divide(3 * np.sin(d) * np.sin(d / 3), d * d, out=np.ones_like(d), where=d > 0)
            share = np.floor(np.where(d >= 3 * math.pi, 0.0, bell) * 4096 + 0.5).astype(np.int64)
    share = share if kind == "lanczos" else np.maximum(share, 0)
    return np.clip(source, 0, size - 1), np.where((source >= 0) & (source < size), share, 0)


def lists(values: np.ndarray) -> pa.Array:
    """Rows of a table of numbers as an Arrow array of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, max(width, 1), dtype=np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32), pa.array(np.ascontiguousarray(values).ravel()))


def stretches(keys: list[np.ndarray]) -> np.ndarray:
    """Where rows begin that differ from the one before in any key, and the end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.append(np.flatnonzero(new), n)


#: Values of lines that are worked on together.
AT_ONCE = 1 << 20


def resized(lines: DataFrame, sizes: DataFrame, kind: str = "box", values: tuple[str, ...] = RGB) -> DataFrame:
    """Lines of pictures in another size; ``sizes`` has image_id, width, height, to_width and to_height.

    Across, lines shrink where they are, and those of a picture that are in one Arrow batch are summed for each target line that they count
    for. What moves on is those sums, one or a few for a target line, which adds up what it gets.
    """
    four = ("width", "height", "to_width", "to_height")
    weights(kind, 1, 1)  # refuses a filter that there isn't
    rows = beside(lines.select("image_id", "y", *values), sizes.select("image_id", *[F.col(c).cast("int").alias(c) for c in four]), "image_id")
    rows = rows.select("image_id", "y", *four, *values)
    key = lines.schema["image_id"]
    long = ", ".join(f"{c} array<bigint>" for c in values)
    parts = T.StructType([key, *T.StructType.fromDDL(f"t int, width int, to_width int, down bigint, {long}").fields])

    def summed(batch: pa.RecordBatch, a: int, b: int, y: np.ndarray, w: int, h: int, tw: int, th: int) -> pa.RecordBatch:
        """What lines a to b of one picture are for the target lines that they count for."""
        at, share = weights(kind, w, tw)
        made = []
        for c in batch.columns[6:]:
            line = c.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b - a, w)
            made.append(sum(line[:, at[:, k]] * share[:, k] for k in range(at.shape[1])))
        own = y[a:b].astype(np.int64)
        place, down = weights(kind, h, th)
        # the target lines that any of the lines counts for, and how much each of them does
        table = np.zeros((h, len(own)), np.int64)
        table[own, np.arange(len(own))] = 1
        some = np.flatnonzero(((place >= own.min()) & (place <= own.max()) & (down != 0)).any(axis=1))
        share = sum(down[some, k, None] * table[place[some, k]] for k in range(place.shape[1]))
        some, share = some[(share != 0).any(axis=1)], share[(share != 0).any(axis=1)]
        n = len(some)
        plain = [pa.repeat(batch.column(0)[a], n), pa.array(some.astype(np.int32)), pa.array(np.full(n, w, np.int32)), pa.array(np.full(n, tw, np.int32)), pa.array(share.sum(axis=1))]
        return pa.RecordBatch.from_arrays([*plain, *[lists(share @ m) for m in made]], names=parts.names)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(0).dictionary_encode().indices.to_numpy()
            y, *sides = (c.to_numpy() for c in batch.columns[1:6])
            cuts = stretches([of])
            for a, b in zip(cuts, cuts[1:]):
                w, h, tw, th = (int(s[a]) for s in sides)
                step = max(1, AT_ONCE // max(w, tw))
                for k in range(a, b, step):
                    yield summed(batch, k, min(b, k + step), y, w, h, tw, th)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Whole target lines, from sums that follow one another."""
            of = table.column(0).dictionary_encode().indices.to_numpy()
            t, w, tw, share = (c.to_numpy() for c in table.columns[1:5])
            # lines of one width and target width are worked on together
            sizes_of = (w.astype(np.int64) << 32) + tw
            for size in np.unique(sizes_of):
                rows_of = np.flatnonzero(sizes_of == size)
                width, to = int(size >> 32), int(size & 0xFFFFFFFF)
                starts = stretches([of[rows_of], t[rows_of]])[:-1]
                by = np.add.reduceat(share[rows_of], starts)[:, None] * weights(kind, width, to)[1].sum(axis=1)[None, :]
                own, out = table.take(pa.array(rows_of)), []
                for c in own.columns[5:]:
                    total = np.add.reduceat(c.flatten().to_numpy().reshape(len(rows_of), to), starts, axis=0)
                    out.append(lists(np.clip(np.floor((2 * total + by) / (2 * by).astype(float)), 0, 255).astype(np.int32)))
                first = pa.array(rows_of[starts])
                yield pa.RecordBatch.from_arrays([table.column(0).take(first), table.column(1).take(first), *out], names=made.names)

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.concat_batches([held, batch])
            t, of = whole.column(1).to_numpy(), whole.column(0).dictionary_encode().indices.to_numpy()
            last = int(stretches([of, t])[-2])  # the next batch may go on with the last line
            if last:
                yield from added(whole.slice(0, last))
            held = whole.slice(last)
        if held is not None:
            yield from added(held)

    made = T.StructType([key, *T.StructType.fromDDL("y int, " + ", ".join(f"{c} array<int>" for c in values)).fields])
    sums = rows.mapInArrow(across, parts)
    return dealt(sums, "image_id", "t").sortWithinPartitions("image_id", "t").mapInArrow(down, made)


# ---- tones


def stretched(lines: DataFrame, levels: DataFrame) -> DataFrame:
    """Pixels (image_id, x, y, r, g, b) of lines, stretched by levels (image_id, channel, black, white) and calmed, as ``acts.apply_levels`` does.

    An image's ends, six numbers, meet lines, not pixels, where lines are dealt by image; what a pixel then costs is compiled.
    """
    rows = beside(lines.select("image_id", "y", *RGB), acts.ends(levels), "image_id", "left")
    # a line has as many values of each channel
    first, *more = RGB
    flat = rows.select("image_id", "y", *more, *acts.ENDS, F.posexplode(first).alias("x", first))
    flat = flat.withColumns({c: F.get(c, F.col("x")) for c in more})
    return acts.stretched(flat).select("image_id", "x", "y", *RGB)


def detail(lines: DataFrame, values: str = "v") -> DataFrame:
    """Root mean square of the four-neighbour difference, over pixels that have all four: a line with the one above and below."""
    down = Window.partitionBy("image_id").orderBy("y")
    rows = lines.select("image_id", "y", F.col(values).alias("v")).withColumns({"up": F.lag("v").over(down), "low": F.lead("v").over(down)})
    rows = rows.where("up is not null and low is not null and size(v) > 2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            for width in np.unique(size):  # lines of one width at once
                at = pa.array(np.flatnonzero(size == width))
                part = batch.take(at)
                v, up, low = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), width) for c in part.columns[1:])
                d = v[:, :-2] + v[:, 2:] + up[:, 1:-1] + low[:, 1:-1] - 4 * v[:, 1:-1]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((d * d).sum(axis=1)), pa.array(np.full(len(at), width - 2, np.int64))], names=["image_id", "s", "n"])

    bends = rows.select("image_id", "v", "up", "low").mapInArrow(run, T.StructType([lines.schema["image_id"], *T.StructType.fromDDL("s bigint, n bigint").fields]))
    return bends.groupBy("image_id").agg(F.sqrt(F.sum("s") / F.sum("n")).alias("detail"))


def in_grey(lines: DataFrame) -> DataFrame:
    """image_id, y, v: brightness by the weights of a grey image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, g, b = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[2:])
            v = (r * 2126 + g * 7152 + b * 722) // 10000
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(ends_of(batch.column(2)), pa.array(v.astype(np.int32)))], names=["image_id", "y", "v"])

    return lines.select("image_id", "y", *RGB).mapInArrow(run, T.StructType([lines.schema["image_id"], lines.schema["y"], *T.StructType.fromDDL("v array<int>").fields]))


def ends_of(lists: pa.Array) -> np.ndarray:
    """Where each list of a column begins among all its elements, and the end."""
    return np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int32)


def counted(lines: DataFrame, values: str = "v") -> DataFrame:
    """image_id, value, n: how often each value occurs in each picture. An Arrow batch is counted where it is, and Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0).dictionary_encode(), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(v):
                continue
            size = int(v.max()) + 1
            n = np.bincount(np.repeat(ids.indices.to_numpy(), np.diff(ends_of(batch.column(1)))) * np.int64(size) + v)
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(found // size)), pa.array((found % size).astype(np.int32)), pa.array(n[found])], names=["image_id", "value", "n"])

    parts = lines.select("image_id", values).mapInArrow(run, T.StructType([lines.schema["image_id"], *T.StructType.fromDDL("value int, n bigint").fields]))
    return parts.groupBy("image_id", "value").agg(F.sum("n").alias("n"))


def columns(lines: DataFrame, values: tuple[str, ...] = RGB, asked: str | None = None) -> DataFrame:
    """image_id, x and an array down each column for each value; only those of the array ``asked``, if that is named.

    Lines are dealt by picture and by bands, and those that follow one another in an Arrow batch are turned together; what moves is
    pieces of columns, never pixels.
    """
    key = lines.schema["image_id"]
    rows = dealt(lines.withColumn("band", F.floor(F.col("y") / BAND)), "image_id", "band").select("image_id", "y", *values, *([asked] if asked else [])).sortWithinPartitions("image_id", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, y, width = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy(), np.diff(ends_of(batch.column(2)))
            cuts = stretches([of, y - np.arange(len(y)), width])
            for a, b in zip(cuts, cuts[1:]):
                w = int(width[a])
                at = np.array([x for x in batch.column(2 + len(values))[a].as_py() if 0 <= x < w], np.int32) if asked else np.arange(w, dtype=np.int32)
                if not len(at):
                    continue
                parts = [lists(c.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(b - a, w)[:, at].T) for c in batch.columns[2 : 2 + len(values)]]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[a], len(at)), pa.array(at), pa.array(np.full(len(at), y[a], np.int32)), *parts], names=["image_id", "x", "y", *values])

    pieces = rows.mapInArrow(run, T.StructType([key, *T.StructType.fromDDL("x int, y int, " + ", ".join(f"{c} array<int>" for c in values)).fields]))
    whole = pieces.groupBy("image_id", "x").agg(F.sort_array(F.collect_list(F.struct("y", *values))).alias("l"))
    return whole.select("image_id", "x", *[F.flatten(F.col(f"l.{c}")).alias(c) for c in values])


def turned(lines: DataFrame, sizes: DataFrame, degrees: DataFrame) -> DataFrame:
    """Lines of pictures turned clockwise by small angles (image_id, degrees), without empty corners; those with 0 stay as they are."""
    rows = sizes.join(degrees.where("degrees <> 0"), "image_id")
    c = geometry.straighten_corners(F.col("width"), F.col("height"), F.col("degrees"))
    corners = Rounds(lines.sparkSession, "corners").write(rows.select("image_id", "width", "height", *[v.alias(f"c{k}") for k, v in enumerate(c)]))
    stay = lines.select("image_id", "y", *RGB).join(corners.select("image_id"), "image_id", "left_anti")
    return flattened(lines, corners).unionByName(stay)


def sizes_of(lines: DataFrame, values: str = "r") -> DataFrame:
    """image_id, width and height of the pictures that lines make."""
    return lines.groupBy("image_id").agg(F.max(F.size(values)).alias("width"), (F.max("y") + 1).alias("height"))


# ---- tilts


def darkness_sums(lines: DataFrame, sizes: DataFrame, values: str = "v") -> DataFrame:
    """image_id, y and v: the lines whose darkness ``line_sharpness`` sums."""
    return lines.select("image_id", "y", F.col(values).alias("v"))


#: Pixels of a picture up to which it is remembered where a tilt's bins cross its lines.
REMEMBERED = 1 << 14


def crossings(first: int, height: int, width: int, sin: float, cos: float, shift: float, last: int) -> tuple[np.ndarray, ...]:
    """The stretches of lines from ``first`` on that lie in one bin each, in order of bins: starts and stops in a table of running sums.

    With them where each bin begins among the stretches, the bins, and how many pixels each has.
    """
    y, x = np.arange(first, first + height)[:, None], np.arange(width)[None, :]
    bins = np.minimum(np.floor(y * cos + shift + NINTH - x * sin), last).astype(np.int64)
    begins = np.ones(bins.shape, bool)
    begins[:, 1:] = bins[:, 1:] != bins[:, :-1]
    at = np.flatnonzero(begins)
    start = at + at // width  # a line of running sums has one more than pixels
    stop = start + np.diff(np.append(at, height * width))
    of = bins.ravel()[at]
    order = np.argsort(of, kind="stable")
    found, firsts = np.unique(of[order], return_index=True)
    return start[order], stop[order], firsts, found, np.add.reduceat((stop - start)[order], firsts)


@lru_cache(maxsize=512)
def remembered(*place) -> tuple[np.ndarray, ...]:
    return crossings(*place)


def sharpness_of(dark: np.ndarray, found: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``measures.sharpness_of_bins`` of pictures, a row each, that have the same bins: sums of darkness, the bins and their pixels."""
    full = max(1, int(n.max()) * 9 // 10)
    mean, ok = dark / n, n >= full
    ok = ok[:-2] & ok[1:-1] & ok[2:] & (found[1:-1] - found[:-2] == 1) & (found[2:] - found[1:-1] == 1)
    k = int(ok.sum())
    if k < 3:
        return np.zeros(len(dark))
    return ((mean[:, 2:] - 2 * mean[:, 1:-1] + mean[:, :-2]) ** 2)[:, ok].sum(axis=1) / k


def line_sharpness(sums: DataFrame, sizes: DataFrame, angles: DataFrame) -> DataFrame:
    """``measures.line_sharpness`` from packed lines (image_id, y, v): image_id, tilt, sharpness for each row of ``angles``.

    A picture's angles are one row that meets its lines, which come to a task in order. Running sums along lines tell how dark a stretch is,
    so a bin costs a place for each line that it crosses; pictures of an Arrow batch that have one size are told together. Of a picture that
    goes on in the next batch the task keeps its bins, and no row is made for a bin.
    """
    at = merged(sizes, angles, "image_id").withColumn("sin", F.sin(F.radians("tilt"))).withColumn("cos", F.cos(F.radians("tilt")))
    at = at.withColumn("shift", F.when(F.col("sin") > 0, F.col("width") * F.col("sin")).otherwise(0.0))
    at = at.withColumn("last", F.ceil(F.round(F.col("height") * F.col("cos") + F.col("width") * F.abs("sin"), 9)).cast("int"))
    names = ["tilt", "sin", "cos", "shift", "last"]
    at = at.groupBy("image_id").agg(F.flatten(F.collect_list(F.array(*[F.col(c).cast("double") for c in names]))).alias("angles"))
    rows = dealt(sums.select("image_id", "y", "v"), "image_id").sortWithinPartitions("image_id", "y")
    rows = dealt(beside(rows, at, "image_id").select("image_id", "y", "v", "angles"), "image_id")
    out = T.StructType([sums.schema["image_id"], *T.StructType.fromDDL("tilt double, sharpness double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, {}  # the picture that may go on, and sums and counts of its bins for each tilt

        def told(ids: pa.Array, tilts: list, values: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, pa.array(tilts, pa.float64()), pa.array(values, pa.float64())], schema=to_arrow_schema(out))

        def done() -> pa.RecordBatch:
            of = {t: (np.flatnonzero(n), s, n) for t, (s, n) in held.items()}
            return told(pa.repeat(own, len(of)), list(of), [float(sharpness_of(s[None, f], f, n[f])[0]) for f, s, n in of.values()])

        for batch in batches:
            if not batch.num_rows:
                continue
            of, y = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            begin, given = ends_of(batch.column(2)), ends_of(batch.column(3))
            dark = 255 - batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            listed = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            cuts, whole = stretches([of]), {}
            parts = stretches([of, y - np.arange(len(y)), np.diff(begin)])
            for a, b in zip(cuts, cuts[1:]):
                goes_on = own is not None and batch.column(0)[int(a)] == own
                if own is not None and not goes_on:
                    if held:
                        yield done()
                    own, held = None, {}
                tilts = {t[0]: tuple(t[1:]) for t in listed[given[a] : given[a + 1]].reshape(-1, 5).tolist()}
                inner = parts[(parts > a) & (parts < b)]
                width = int(begin[a + 1] - begin[a])
                if not goes_on and b < len(of) and not len(inner) and width:
                    for t, more in tilts.items():
                        whole.setdefault((int(y[a]), int(b - a), width, t, *more), []).append(int(a))
                    continue
                own = batch.column(0)[int(a)]
                for p, q in zip([a, *inner], [*inner, b]):
                    width = int(begin[p + 1] - begin[p])
                    if width:
                        sums_of = np.pad(dark[begin[p] : begin[q]].reshape(q - p, width).cumsum(axis=1), ((0, 0), (1, 0))).ravel()
                        for t, (sin, cos, shift, last) in tilts.items():
                            start, stop, firsts, found, n = crossings(int(y[p]), int(q - p), width, sin, cos, shift, int(last))
                            s, k = held.setdefault(t, (np.zeros(int(last) + 1, np.int64), np.zeros(int(last) + 1, np.int64)))
                            s[found] += np.add.reduceat(sums_of[stop] - sums_of[start], firsts)
                            k[found] += n
            tables: dict[tuple, tuple[np.ndarray, dict]] = {}
            for first, height, width in {k[:3] for k in whole}:
                lines_of = sorted({a for k, of_key in whole.items() if k[:3] == (first, height, width) for a in of_key})
                table = dark[(begin[lines_of][:, None] + np.arange(height * width)[None, :])].reshape(-1, height, width).cumsum(axis=2)
                tables[first, height, width] = np.pad(table, ((0, 0), (0, 0), (1, 0))).reshape(len(lines_of), -1), {a: k for k, a in enumerate(lines_of)}
            for (first, height, width, tilt, sin, cos, shift, last), at_of in whole.items():
                table, place = tables[first, height, width]
                look = remembered if height * width <= REMEMBERED else crossings
                start, stop, firsts, found, n = look(first, height, width, sin, cos, shift, int(last))
                table = table if len(at_of) == len(table) else table[[place[a] for a in at_of]]
                total = np.add.reduceat(np.take(table, stop, axis=1) - np.take(table, start, axis=1), firsts, axis=1)
                yield told(batch.column(0).take(pa.array(at_of)), [tilt] * len(at_of), sharpness_of(total, found, n))
        if held:
            yield done()

    return rows.mapInArrow(run, out)


def named(value: Column, use) -> Column:
    """What ``use`` makes of a value that is reckoned once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_place(guess: Column, holds) -> Column:
    """The first place from which on ``holds`` is true, one off the guess at most."""
    return named(guess, lambda g: F.when(holds(g - 1), g - 1).when(holds(g), g).otherwise(g + 1))


def suggest_straightening(lines: DataFrame, sizes: DataFrame, values: str = "v") -> DataFrame:
    """image_id, degrees to turn clockwise, as ``measures.suggest_straightening`` tells them."""
    sums = darkness_sums(lines, sizes, values)
    return measures.straightening(lambda angles: line_sharpness(sums, sizes, angles), sizes)


# ---- flattening


def flattened(lines: DataFrame, corners: DataFrame) -> DataFrame:
    """Pulls sheets flat: lines (image_id, y, r, g, b) of the rectangles, as ``acts.flatten`` tells their pixels.

    A target line is a straight stretch of the source, so between two source lines it runs for one stretch of its own. Those stretches
    meet the pair of source lines that they lie between, once, take their pixels from it, and are put together in order.
    """
    c = [F.col(f"c{k}") for k in range(8)]
    w, h = geometry.flat_size(c)
    rows = corners.select("image_id", "width", "height", w.alias("w"), h.alias("h"), *[v.alias(k) for k, v in geometry.flatten_map(c).items()]).where("w >= 2 and h >= 2 and wa is not null")
    # a row a picture, reckoned once: in one plan with all that follows, code for it would be generated over and over
    rows = Rounds(lines.sparkSession, "maps").write(rows)
    rows = rows.withColumn("ty", F.explode(F.expr("sequence(0, h - 1)"))).withColumn("down", (F.col("ty") + 0.5) / F.col("h"))
    rows = rows.withColumns({"share": F.col("wb") * F.col("down") + 1, "left": F.col("bx") * F.col("down") + F.col("x0"), "top": F.col("by") * F.col("down") + F.col("y0")})
    width, wa, ay = F.col("w"), F.col("wa"), F.col("ay")
    held = lambda v, size: F.round(F.least(F.greatest(v, F.lit(0.0)), F.col(size) - 1.0), 6)
    across = lambda x: (x + 0.5) / width
    fx = lambda x: held((F.col("ax") * across(x) + F.col("left")) / (wa * across(x) + F.col("share")), "width")
    fy = lambda x: held((ay * across(x) + F.col("top")) / (wa * across(x) + F.col("share")), "height")
    line = lambda x: F.floor(fy(x)).cast("int")
    rows = rows.withColumns({"first": line(F.lit(0)), "last": line(width - 1)})
    rises = F.col("first") <= F.col("last")

    def begin(y: Column) -> Column:
        """The first place of the target line that lies on source line y, or one beyond; the equation of the place, then a look beside it."""
        edge = F.when(rises, y).otherwise(y + 1) - 5e-7  # places are rounded to six digits
        at = F.try_divide(edge * F.col("share") - F.col("top"), ay - edge * wa) * width - 0.5
        guess = F.ceil(F.least(F.greatest(at, F.lit(0.0)), width + 1.0)).cast("int")
        found = first_place(guess, lambda x: F.when(rises, line(x) >= y).otherwise(line(x) <= y))
        return F.when(y == F.col("first"), 0).otherwise(F.least(F.greatest(found, F.lit(0)), width))

    step = F.when(rises, 1).otherwise(-1)
    piece = lambda y: F.struct(y.alias("y"), begin(y).alias("from"), F.when(y == F.col("last"), width).otherwise(begin(y + step)).alias("to"))
    rows = rows.withColumn("s", F.explode(F.transform(F.sequence(F.col("first"), F.col("last")), piece))).where("s.from < s.to")
    spots = F.transform(F.sequence(F.col("s.from"), F.col("s.to") - 1), lambda x: F.struct(fx(x).alias("fx"), fy(x).alias("fy")))
    rows = rows.select("image_id", "ty", "s.y", "s.from", spots.alias("places"))

    pairs = lines.select("image_id", "y", *RGB)
    below = Window.partitionBy("image_id").orderBy("y")
    pairs = pairs.withColumns({f"{k}_low": F.coalesce(F.lead(k).over(below), F.col(k)) for k in RGB})
    met = dealt(rows, "image_id", "y").join(dealt(pairs, "image_id", "y"), ["image_id", "y"])

    def mixed(k: str) -> Column:
        def one(p: Column) -> Column:
            left = F.floor(p["fx"]).cast("int")
            sx, sy = p["fx"] - left, p["fy"] - F.col("y")
            # beyond the last pixel of a line its share is nothing
            a, b, d, e = (F.coalesce(F.get(v, i), F.lit(0)) for v, i in ((F.col(k), left), (F.col(k), left + 1), (F.col(f"{k}_low"), left), (F.col(f"{k}_low"), left + 1)))
            return tones.half_up(F.round(a * (1 - sx) * (1 - sy) + b * sx * (1 - sy) + d * (1 - sx) * sy + e * sx * sy, 6))

        return F.transform("places", one)

    parts = met.select("image_id", "ty", "from", *[mixed(k).alias(k) for k in RGB])
    whole = parts.groupBy("image_id", "ty").agg(F.sort_array(F.collect_list(F.struct("from", *RGB))).alias("l"))
    return whole.select("image_id", F.col("ty").alias("y"), *[F.flatten(F.col(f"l.{k}")).alias(k) for k in RGB])


def digest(lines: DataFrame, values: tuple[str, ...] = RGB) -> DataFrame:
    """image_id, n_pixels and the sum of ``acts.digest``: the lines of an Arrow batch are summed where they are, and Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, begin, own = batch.column(1).to_numpy().astype(np.int64), ends_of(batch.column(2)), ends_of(batch.column(2))
            total = np.zeros(batch.num_rows, np.int64)
            # at place x channel k weighs 31 x + 17 y + k + 1
            for k, c in enumerate(batch.columns[2:]):
                own = begin if k == 0 else ends_of(c)
                v, size = c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(own)
                x = np.arange(len(v)) - np.repeat(own[:-1], size)
                sums = np.append(0, np.cumsum(v * (31 * x + np.repeat(17 * y + k + 1, size))))
                total += sums[own[1:]] - sums[own[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(begin).astype(np.int64)), pa.array(total)], names=["image_id", "n", "s"])

    rows = lines.select("image_id", "y", *values).mapInArrow(run, T.StructType([lines.schema["image_id"], *T.StructType.fromDDL("n bigint, s bigint").fields]))
    return rows.groupBy("image_id").agg(F.sum("n").alias("n_pixels"), F.sum("s").alias("weighed"))
