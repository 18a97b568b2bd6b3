"""Column functions for boxes, corners, pages and the map that flattens a sheet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An A4 page in millimetres, the least share of a picture that a sheet has, and the least determinant of two crossing sides.
A4_SHORT, A4_LONG = 210.0, 297.0
LEAST_AREA, LEAST_SIDE = 0.15, 0.25
LEAST_DET = 0.5
MOST_EDGE = 3000
LEAST_EDGE = 600


def half_away(value: Column) -> Column:
    return F.signum(value) * F.floor(F.abs(value) + 0.5)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def flat_size(c: list[Column]) -> tuple[Column, Column]:
    """Width and height of a flattened sheet, from x and y of its corners, clockwise from the top left."""
    width = (distance(c[0], c[1], c[2], c[3]) + distance(c[6], c[7], c[4], c[5])) / 2
    height = (distance(c[0], c[1], c[6], c[7]) + distance(c[2], c[3], c[4], c[5])) / 2
    return half_away(width).cast("int"), half_away(height).cast("int")


def flatten_map(c: list[Column]) -> dict[str, Column]:
    """Coefficients that take (across, down) in the unit square to the photo; null where three corners are in line.

    x = (ax * across + bx * down + x0) / (wa * across + wb * down + 1), y alike.
    """
    x0, y0, x1, y1, x2, y2, x3, y3 = c
    px, py, qx, qy = x1 - x2, y1 - y2, x3 - x2, y3 - y2
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    area = px * qy - qx * py
    plain = (sx == 0) & (sy == 0)
    ok = F.abs(area) >= 2.0**-23
    wa = F.when(plain, F.lit(0.0)).when(ok, F.try_divide(sx * qy - qx * sy, area))
    wb = F.when(plain, F.lit(0.0)).when(ok, F.try_divide(px * sy - sx * py, area))
    return {"wa": wa, "wb": wb, "ax": x1 - x0 + wa * x1, "ay": y1 - y0 + wa * y1, "bx": x3 - x0 + wb * x3, "by": y3 - y0 + wb * y3, "x0": x0, "y0": y0}


def straighten_corners(width: Column, height: Column, degrees: Column) -> list[Column]:
    """Corners of the largest box, turned by the angle, that stays inside the picture."""
    turn = F.radians(-degrees)
    sin, cos = F.sin(turn), F.cos(turn)
    fits = F.least(width / (width * F.abs(cos) + height * F.abs(sin)), height / (height * F.abs(cos) + width * F.abs(sin)))
    out: list[Column] = []
    for right, low in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
        a, d = width / 2 * right, height / 2 * low
        out += [width / 2 + (a * cos - d * sin) * fits, height / 2 + (a * sin + d * cos) * fits]
    return out


def fits_inside(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Whether a crop box is neither empty nor reaches outside; sums in 64 bits, so none wraps."""
    return (w > 0) & (h > 0) & (x >= 0) & (y >= 0) & (x.cast("bigint") + w <= width) & (y.cast("bigint") + h <= height)


def crop_range(start: Column, length: Column, size: Column) -> tuple[Column, Column]:
    """First pixel and number of pixels of a cut told in shares of a side, held inside."""
    at = F.least(half_away(F.greatest(start, F.lit(0.0)) * size).cast("int"), size)
    return at, F.least(half_away(F.greatest(length, F.lit(0.0)) * size).cast("int"), size - at)


def upright_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """The size of a picture that stands as its EXIF orientation asks; from 5 on its sides change places."""
    lies = orientation >= 5
    return F.when(lies, height).otherwise(width), F.when(lies, width).otherwise(height)


def fitted_size(width: Column, height: Column, edge: Column) -> tuple[Column, Column]:
    """The size of a picture whose longest side is at most ``edge``, sides in proportion; nothing is enlarged. Previews are such."""
    longest = F.greatest(width, height)
    side = lambda v: F.when(longest <= edge, v).otherwise(F.greatest(F.lit(1), half_away(v * edge / longest).cast("int")))
    return side(width), side(height)


def small_size(width: Column, height: Column, most: int = 400) -> tuple[Column, Column]:
    """The size of the copy that searches work on: at most so wide, height in proportion, cut to a whole number."""
    wide = width > most
    return F.when(wide, F.lit(most)).otherwise(width), F.when(wide, F.greatest(F.lit(1), F.floor(height * most / width).cast("int"))).otherwise(height)


def mask_place(x: Column, y: Column, full: tuple[Column, Column], small: tuple[Column, Column]) -> tuple[Column, Column]:
    """The pixel of a small mask that stands for a pixel of the full picture."""
    return F.floor(x * small[0] / full[0]).cast("int"), F.floor(y * small[1] / full[1]).cast("int")


def page_is_wide(width: Column, height: Column) -> Column:
    return width > height


def placed(width: Column, height: Column) -> dict[str, Column]:
    """Page size and where a picture stands on it, whole and centred, in millimetres."""
    wide = page_is_wide(width, height)
    pw = F.when(wide, A4_LONG).otherwise(A4_SHORT)
    ph = F.when(wide, A4_SHORT).otherwise(A4_LONG)
    scale = F.least(pw / width, ph / height)
    return {"page_w": pw, "page_h": ph, "scale": scale, "left": (pw - width * scale) / 2, "bottom": (ph - height * scale) / 2}


def believable(area: Column, box_w: Column, box_h: Column, width: Column, height: Column) -> Column:
    return (area >= width * height * LEAST_AREA) & (box_w >= width * LEAST_SIDE) & (box_h >= height * LEAST_SIDE)


def scaled_box(x: Column, y: Column, w: Column, h: Column, small: tuple[Column, Column], full: tuple[Column, Column]) -> dict[str, Column]:
    """A box of a small copy on the full picture, rounded outwards and held inside."""
    across, down = full[0] / small[0], full[1] / small[1]
    left = F.least(F.floor(x * across), full[0] - 1).cast("int")
    top = F.least(F.floor(y * down), full[1] - 1).cast("int")
    return {
        "x": left,
        "y": top,
        "w": F.least(F.ceil(w * across), full[0] - left).cast("int"),
        "h": F.least(F.ceil(h * down), full[1] - top).cast("int"),
    }


def crossing(v_slope: Column, v_offset: Column, h_slope: Column, h_offset: Column) -> tuple[Column, Column]:
    """Where x = v_slope y + v_offset and y = h_slope x + h_offset meet; null where the two are nearly one line."""
    det = F.lit(1.0) - v_slope * h_slope
    x = F.when(F.abs(det) >= LEAST_DET, F.try_divide(v_slope * h_offset + v_offset, det))
    return x, h_slope * x + h_offset


def convex(c: list[Column]) -> Column:
    """Whether four corners turn the same way all round."""
    turns = []
    for k in range(4):
        (ax, ay), (bx, by), (cx, cy) = ((c[2 * (k + j) % 8], c[(2 * (k + j) + 1) % 8]) for j in range(3))
        turns.append((bx - ax) * (cy - by) - (by - ay) * (cx - bx))
    return (F.least(*turns) > 0) | (F.greatest(*turns) < 0)


def corner_points(flat: Column) -> Column:
    """Four points (x, y) from the eight numbers of an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(F.get(flat, 2 * k).alias("x"), F.get(flat, 2 * k + 1).alias("y")))


def box_of_corners(xs: Column, ys: Column, width: Column, height: Column) -> dict[str, Column]:
    """The box round corners (arrays of pixels), in shares of the picture, each held in 0 to 1."""
    share = lambda values, size: F.transform(values, lambda v: F.least(F.greatest(v / size, F.lit(0.0)), F.lit(1.0)))
    sx, sy = share(xs, width), share(ys, height)
    left, top = F.array_min(sx), F.array_min(sy)
    return {"x": left, "y": top, "w": F.array_max(sx) - left, "h": F.array_max(sy) - top}


def resize_choice(width: Column, height: Column, edge: Column) -> Column:
    """How a page gets its size: by an asked edge, by the memory cap, or not at all."""
    longest = F.greatest(width, height)
    return F.when((edge > 0) & (longest <= edge), "keep").when(edge > 0, "edge").when(longest > MOST_EDGE, "cap").otherwise("keep")


def rung_error(quality: Column, edge: Column) -> Column:
    """What is wrong with a quality and a longest edge, or null."""
    return (
        F.when(~quality.between(1, 100), F.concat(F.lit("quality is from 1 to 100, not "), quality.cast("string")))
        .when((edge < 0) | (edge > MOST_EDGE), F.concat(F.lit("the edge is from 0 to 3000, not "), edge.cast("string")))
        .when((edge > 0) & (edge < LEAST_EDGE), F.concat(F.lit("the edge is 0 or at least 600, not "), edge.cast("string")))
    )


def composed_crop(old: list[Column], turned: Column, new: list[Column]) -> list[Column]:
    """A stored cut (x, y, w, h in shares) after more quarter turns, with a new cut inside it if there is one.

    Each quarter turn clockwise takes (x, y, w, h) to (1 - y - h, x, h, w).
    """
    x, y, w, h = old
    k = (turned % 4 + 4) % 4
    ways = [(x, y, w, h), (1 - y - h, x, h, w), (1 - x - w, 1 - y - h, w, h), (y, 1 - x - w, h, w)]
    now = [F.when(k == 0, ways[0][i]).when(k == 1, ways[1][i]).when(k == 2, ways[2][i]).otherwise(ways[3][i]) for i in range(4)]
    has_old, has_new = (w > 0) & (h > 0), (new[2] > 0) & (new[3] > 0)
    nested = [now[0] + new[0] * now[2], now[1] + new[1] * now[3], new[2] * now[2], new[3] * now[3]]
    return [F.when(has_old & has_new, nested[i]).when(has_new, new[i]).when(has_old, now[i]).otherwise(F.lit(0.0)) for i in range(4)]
