"""Whole pictures as rows: Arrow-batched functions whose result is a value or an error, never a failed job.

A picture is the struct that Spark's image source reads (origin, height, width,
nChannels, mode, data with blue first). Functions see one picture at a time, so a
task holds the working planes of one, beside its Arrow batch: that has the bytes of
some rows, at least of one, within Spark's limits for batches.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sheetspark.kernels import jpeg, paper, raster

IMAGE = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("height", "width", "nChannels", "mode")] + [T.StructField("data", T.BinaryType())]
)
MODES = {1: 0, 3: 16, 4: 24}


def to_array(image: dict) -> np.ndarray:
    """Bytes with red first, (h, w) for one channel; transparency is dropped."""
    if image is None or image["width"] is None or image["width"] <= 0 or image["height"] <= 0:
        raise ValueError("the file is no picture that can be read")
    n = image["nChannels"]
    flat = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], n)
    return flat[..., 0] if n == 1 else swapped(flat)


def swapped(pixels: np.ndarray) -> np.ndarray:
    """The first three channels in the other order, a channel at a time: a copy pixel by pixel takes several times as long."""
    out = np.empty((*pixels.shape[:2], 3), pixels.dtype)
    for k in range(3):
        out[..., k] = pixels[..., 2 - k]
    return out


def to_image(array: np.ndarray) -> dict:
    n = 1 if array.ndim == 2 else 3
    data = array if n == 1 else swapped(array)
    return {"height": array.shape[0], "width": array.shape[1], "nChannels": n, "mode": MODES[n], "data": np.ascontiguousarray(data).tobytes()}


def apply(df: DataFrame, inputs: list[str], work: Callable, kind: T.DataType, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Adds ``value`` and ``error``: what ``work`` returns for the inputs of a row, or what went wrong.

    A null input is an error as well. ``keep`` names the columns that stay.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in (value, "error")]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(value, kind), T.StructField("error", T.StringType())])
    source = df.select(*keep, *[F.col(c).alias(f"\x01{k}") for k, c in enumerate(inputs)])
    n, arrow = len(keep), to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                try:
                    given = [c[0].as_py() for c in row.columns[n:]]
                    if any(g is None for g in given):
                        raise ValueError("an input is missing")
                    out, error = work(*given), None
                except (ValueError, ArithmeticError, LookupError, TypeError, struct.error) as failed:
                    out, error = None, str(failed) or type(failed).__name__
                yield pa.RecordBatch.from_arrays([*row.columns[:n], pa.array([out], arrow), pa.array([error], pa.string())], names=[*keep, value, "error"])

    return source.mapInArrow(run, schema)


PIXELS = "x int, y int, v int, r int, g int, b int"
PIXEL_ROWS = 1 << 16


def to_pixels(df: DataFrame, key: str = "image_id", image: str = "image") -> DataFrame:
    """key, x, y, v (brightness), r, g and b of each pixel: what the measures and acts over pixels take.

    A picture comes out in batches of lines, so none of them grows with it. Pictures that can't be read give no rows.
    """
    kind = df.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                try:
                    rgb = raster.as_rgb(to_array(batch.column(1)[k].as_py()))
                except (ValueError, TypeError):
                    continue
                h, w = rgb.shape[:2]
                lines = max(1, PIXEL_ROWS // w)
                for top in range(0, h, lines):
                    part = rgb[top : top + lines].reshape(-1, 3).astype(np.int32)
                    n = len(part)
                    at = np.arange(n, dtype=np.int32)
                    grey = (part @ np.array([2126, 7152, 722], np.int64) // 10000).astype(np.int32)
                    ids = pa.repeat(batch.column(0)[k], n)
                    yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (at % w, at // w + np.int32(top), grey, *np.ascontiguousarray(part.T)))], names=[key, "x", "y", "v", "r", "g", "b"])

    schema = T.StructType([kind, *T.StructType.fromDDL(PIXELS).fields])
    return df.select(key, image).mapInArrow(run, schema)


def from_pixels(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """key, image and error: pictures from their pixels (key, x, y, r, g, b), which must all be there, once; else the error says so.

    What moves is the pixels of a picture that are in one Arrow batch, as one row of bytes; a task holds the pixels of one picture at a time.
    """
    kind = pixels.schema[key]
    rows = pixels.select(key, *[F.col(c).cast("int").alias(c) for c in "xyrgb"])
    parts = T.StructType([kind, T.StructField("part", T.BinaryType())])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int32) for c in batch.columns[1:]], axis=1)
            of = batch.column(0).dictionary_encode().indices
            of = of.fill_null(-1).to_numpy()
            order = np.argsort(of, kind="stable")
            cuts = [*np.flatnonzero(np.diff(of[order], prepend=-2)), len(of)]
            first = pa.array(order[cuts[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(first), pa.array([table[order[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=parts.names)

    rows = rows.mapInArrow(gathered, parts).repartition(key).sortWithinPartitions(key)
    arrow = to_arrow_type(IMAGE)

    def picture(parts: list[np.ndarray]) -> dict:
        table = np.concatenate(parts)
        w, h = table[:, 0].max() + 1, table[:, 1].max() + 1
        at = table[:, 1].astype(np.int64) * w + table[:, 0]
        order = np.argsort(at, kind="stable")
        table, at = table[order], at[order]
        if len(table) != int(w) * int(h) or table[:, :2].min() < 0 or (np.diff(at) != 1).any():
            raise ValueError(f"{len(table)} pixels are no picture of {w} by {h}")
        return to_image(table[:, 2:].astype(np.uint8).reshape(h, w, 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None

        def done() -> pa.RecordBatch:
            try:
                made, error = picture(held), None
            except ValueError as failed:
                made, error = None, str(failed)
            return pa.RecordBatch.from_arrays([pa.array([own.as_py()], own.type), pa.array([made], arrow), pa.array([error], pa.string())], names=[key, "image", "error"])

        for batch in batches:
            for k in range(batch.num_rows):
                if held and batch.column(0)[k].as_py() != own.as_py():
                    yield done()
                    held = []
                held.append(np.frombuffer(batch.column(1)[k].as_py(), np.int32).reshape(-1, 5))
                own = batch.column(0)[k]
        if held:
            yield done()

    return rows.mapInArrow(run, T.StructType([pixels.schema[key], T.StructField("image", IMAGE), T.StructField("error", T.StringType())]))


POINTS = T.ArrayType(T.FloatType())
PAPER = T.StructType(
    [
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("corners", POINTS),
        T.StructField("runs_off", T.BooleanType()),
        T.StructField("whole", T.BooleanType()),
    ]
)
LEVELS = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("black", "white")])


def paper_row(array: np.ndarray) -> dict | None:
    found = paper.find_paper(array)
    if found is None:
        return None
    x, y, w, h = found.bounds
    return {"x": x, "y": y, "width": w, "height": h, "corners": [float(v) for v in found.corners.ravel()], "runs_off": found.runs_off, "whole": found.whole}


def find_paper(df: DataFrame, image: str = "image", keep: list[str] | None = None) -> DataFrame:
    """Adds ``paper``, null where there is none, and ``error``."""
    return apply(df, [image], lambda i: paper_row(to_array(i)), PAPER, "paper", keep)


def suggest_levels(df: DataFrame, image: str = "image", keep: list[str] | None = None) -> DataFrame:
    return apply(df, [image], lambda i: dict(zip(("black", "white"), paper.suggest_levels(to_array(i)), strict=True)), LEVELS, "levels", keep)


def suggest_straightening(df: DataFrame, image: str = "image", keep: list[str] | None = None) -> DataFrame:
    return apply(df, [image], lambda i: raster.suggest_straightening(to_array(i)), T.DoubleType(), "degrees", keep)


def act(df: DataFrame, work: Callable[[np.ndarray], np.ndarray], image: str = "image", keep: list[str] | None = None) -> DataFrame:
    """Any act of the raster kernels on a picture column, into ``value``."""
    return apply(df, [image], lambda i: to_image(work(to_array(i))), IMAGE, "value", keep)


def encode(df: DataFrame, quality: int = 85, image: str = "image", keep: list[str] | None = None) -> DataFrame:
    """Adds ``jpeg``: one channel stays one, all else is three."""
    return apply(df, [image], lambda i: jpeg.encode(to_array(i), quality), T.BinaryType(), "jpeg", keep)


def rebuild_tables(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Adds ``smaller``: the same picture with better Huffman tables, or the bytes as they were."""
    return apply(df, [content], jpeg.smallest, T.BinaryType(), "smaller", keep)


SHAPE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("grey", T.BooleanType()), T.StructField("orientation", T.IntegerType())])


def headers(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Adds ``shape``: size, whether there is one channel, and the EXIF orientation, from the header alone."""

    def work(data: bytes) -> dict:
        w, h, grey = jpeg.shape(data)
        return {"width": w, "height": h, "grey": grey, "orientation": jpeg.orientation(data)}

    return apply(df, [content], work, SHAPE, "shape", keep)


def gradients(g: np.ndarray) -> np.ndarray:
    f = g.astype(np.float32)
    return np.abs(np.diff(f, axis=1, append=f[:, -1:])) + np.abs(np.diff(f, axis=0, append=f[-1:]))


def best_offset(whole: np.ndarray, part: np.ndarray, xs: range, ys: range) -> tuple[int, int]:
    """Where the part's edges lie best in the whole's; the first of equals."""
    h, w = part.shape
    left, top = max(0, xs.start), max(0, ys.start)
    over, down = min(xs.stop, whole.shape[1] - w + 1) - left, min(ys.stop, whole.shape[0] - h + 1) - top
    if over <= 0 or down <= 0:
        return 0, 0
    a = whole[top : top + h + down - 1, left : left + w + over - 1].astype(float)
    b, n = part.astype(float), h * w

    def sums(of: np.ndarray) -> np.ndarray:
        """Sums over the part's box at each offset."""
        s = np.pad(of.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]

    # the products at all offsets at once; edges are whole numbers, so their sums are rounded to what they are
    both = np.fft.irfft2(np.fft.rfft2(a) * np.conj(np.fft.rfft2(b, a.shape)), a.shape)[:down, :over]
    x, y = sums(a), b.sum()
    apart = np.sqrt(np.maximum(sums(a * a) - x * x / n, 0) * (np.square(b).sum() - y * y / n))
    c = np.divide(np.rint(both) - x * y / n, apart, out=np.zeros_like(apart), where=apart > 0)
    at = int(c.argmax())
    return left + at % over, top + at // over


def find_crop_offset(whole: np.ndarray, part: np.ndarray, coarse: int = 8) -> tuple[int, int]:
    """The place a picture was cut from: searched on eighth-size copies, then round the answer at full size."""
    a, b = raster.grey(whole), raster.grey(part)
    if b.shape[0] > a.shape[0] or b.shape[1] > a.shape[1]:
        raise ValueError("the cut is larger than the picture")
    if min(b.shape) >= 8 * coarse:
        shrink = lambda g: raster.resampled(g, max(1, g.shape[1] // coarse), max(1, g.shape[0] // coarse), "box")
        sa, sb = shrink(a), shrink(b)
        x, y = best_offset(gradients(sa), gradients(sb), range(sa.shape[1] - sb.shape[1] + 1), range(sa.shape[0] - sb.shape[0] + 1))
        xs, ys = range(x * coarse - coarse, x * coarse + 2 * coarse), range(y * coarse - coarse, y * coarse + 2 * coarse)
    else:
        xs, ys = range(a.shape[1] - b.shape[1] + 1), range(a.shape[0] - b.shape[0] + 1)
    return best_offset(gradients(a), gradients(b), xs, ys)


def edge_miss(g: np.ndarray, x: int, y: int, dx: int, dy: int, reach: int = 60, step: int = 30) -> int | None:
    """How far from a place, along a direction, brightness falls by at least a step within two pixels each way."""
    best, found = step - 1, None
    for off in range(-reach, reach):
        ax, ay, bx, by = x + dx * (off - 2), y + dy * (off - 2), x + dx * (off + 2), y + dy * (off + 2)
        if all(0 <= u < g.shape[1] for u in (ax, bx)) and all(0 <= v < g.shape[0] for v in (ay, by)):
            fall = int(g[ay, ax]) - int(g[by, bx])
            if fall > best:
                best, found = fall, off
    return found


def overlay(image: np.ndarray, found: paper.Paper) -> np.ndarray:
    """The picture with what is off the sheet darkened and crosses on the corners."""
    rgb = raster.as_rgb(image).copy()
    on = found.contains(rgb.shape[1], rgb.shape[0])
    rgb[~on] //= 3
    for x, y in np.rint(found.corners).astype(int).tolist():
        rgb[max(0, y - 6) : y + 7, min(max(x, 0), rgb.shape[1] - 1)] = (255, 0, 0)
        rgb[min(max(y, 0), rgb.shape[0] - 1), max(0, x - 6) : x + 7] = (255, 0, 0)
    return rgb
