"""Areas as runs and pictures as packed lines, against pixels, NumPy and the pixel tier."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetspark.functions import tones
from sheetspark.kernels import raster
from sheetspark.operators import acts, lines, measures, runs, sheet


def mask_rows(masks):
    return [(k, int(x), int(y)) for k, m in enumerate(masks) for y, x in zip(*np.nonzero(m), strict=True)]


def sizes_of(spark, arrays):
    return spark.createDataFrame([(k, a.shape[1], a.shape[0]) for k, a in enumerate(arrays)], "image_id long, width int, height int")


def line_rows(spark, arrays, names="v"):
    rows = []
    for k, a in enumerate(arrays):
        for y in range(a.shape[0]):
            planes = [a[y]] if a.ndim == 2 else [a[y, :, c] for c in range(3)]
            rows.append((k, y, *[p.astype(int).tolist() for p in planes]))
    return spark.createDataFrame(rows, "image_id long, y int, " + ", ".join(f"{n} array<int>" for n in names))


def areas_of(mask):
    """Each area as (pixels), found by walking, in order of first pixels."""
    seen, out = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        todo, own = deque([(y, x)]), []
        seen[y, x] = True
        while todo:
            a, b = todo.popleft()
            own.append((int(b), int(a)))
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    todo.append((c, d))
        out.append(own)
    return out


def spiral(n):
    m = np.zeros((n, n), bool)
    x, y, dx, dy = 0, 0, 1, 0
    m[0, 0] = True
    for _ in range(n * n):
        a, b = x + dx, y + dy
        ahead = (x + 2 * dx, y + 2 * dy)
        if not (0 <= a < n and 0 <= b < n) or m[b, a] or (0 <= ahead[0] < n and 0 <= ahead[1] < n and m[ahead[1], ahead[0]]):
            dx, dy = -dy, dx
            a, b = x + dx, y + dy
            if not (0 <= a < n and 0 <= b < n) or m[b, a]:
                break
        x, y = a, b
        m[y, x] = True
    return m


def test_areas_by_walking(spark):
    rng = np.random.default_rng(1)
    comb = np.zeros((12, 40), bool)
    comb[:, ::2] = True
    comb[-1] = True
    masks = [rng.random((14, 17)) < p for p in (0.3, 0.5, 0.62, 0.8)] + [spiral(25), comb, comb[::-1], np.ones((3, 4), bool), np.array([[1, 0, 1], [1, 0, 1]], bool)]
    of = runs.runs_of_pixels(spark.createDataFrame(mask_rows(masks), "image_id long, x int, y int"))
    got = runs.labelled(of).collect()
    pixels = {}
    for r in got:
        pixels.setdefault((r["image_id"], r["label"]), set()).update((x, r["y"]) for x in range(r["x0"], r["x1"] + 1))
    for k, m in enumerate(masks):
        want = [set(a) for a in areas_of(m)]
        assert sorted(map(sorted, want)) == sorted(sorted(v) for (i, _), v in pixels.items() if i == k)
        for a in want:  # the label is where the area begins, line by line
            y, x = min((y, x) for x, y in a)
            assert pixels[k, (y << 32) + x] == a
    best = {}
    for r in runs.largest(runs.labelled(of)).collect():
        best.setdefault(r["image_id"], (r["area"], r["left"], r["top"], r["right"], r["bottom"], set()))[5].update((x, r["y"]) for x in range(r["x0"], r["x1"] + 1))
    for k, m in enumerate(masks):
        top = max(areas_of(m), key=len)  # of equals the first
        xs, ys = [p[0] for p in top], [p[1] for p in top]
        assert best[k] == (len(top), min(xs), min(ys), max(xs), max(ys), set(top))


def test_what_reaches_the_border_and_what_is_left(spark):
    rng = np.random.default_rng(2)
    pictures = [np.where(rng.random((15, 19)) < p, 20, 200) for p in (0.2, 0.55, 0.8)] + [np.full((4, 5), 200), np.full((4, 5), 20)]
    of = sizes_of(spark, pictures)
    dark = runs.runs_of_lines(line_rows(spark, pictures), lambda v: v <= 100)
    flat = lambda df: {(r["image_id"], x, r["y"]) for r in df.collect() for x in range(r["x0"], r["x1"] + 1)}
    assert flat(dark) == {(k, int(x), int(y)) for k, p in enumerate(pictures) for y, x in zip(*np.nonzero(p <= 100), strict=True)}
    outside = set()
    for k, p in enumerate(pictures):
        for a in areas_of(p <= 100):
            if any(x in (0, p.shape[1] - 1) or y in (0, p.shape[0] - 1) for x, y in a):
                outside |= {(k, x, y) for x, y in a}
    assert flat(runs.reaching_the_border(dark, of)) == outside
    everything = {(k, x, y) for k, p in enumerate(pictures) for y in range(p.shape[0]) for x in range(p.shape[1])}
    assert flat(runs.complement(runs.reaching_the_border(dark, of), of)) == everything - outside
    assert runs.labelled(dark.limit(0)).count() == 0 and runs.complement(dark.limit(0), of.limit(0)).count() == 0


def test_quadrilaterals_line_by_line(spark):
    rng = random.Random(3)
    quads, w, h = [], 40, 33
    for k in range(60):
        slope = lambda: rng.choice([0.0, rng.uniform(-0.3, 0.3), rng.uniform(-3, 3), 0.25, -0.5])
        quads.append((k, slope(), rng.uniform(-5, 15), slope(), rng.uniform(20, 45), slope(), float(rng.randint(-4, 12)), slope(), rng.uniform(15, 40)))
    df = spark.createDataFrame(quads, "image_id long, ls double, lo double, rs double, ro double, ts double, to double, bs double, bo double")
    of = spark.createDataFrame([(k, w, h) for k in range(60)], "image_id long, width int, height int")
    got = {(r["image_id"], r["y"]): (r["x0"], r["x1"]) for r in runs.lines_of_quads(df, of).collect()}
    y, x = np.mgrid[0:h, 0:w].astype(float)
    for k, ls, lo, rs, ro, ts, to, bs, bo in quads:
        inside = (x >= ls * y + lo) & (x <= rs * y + ro) & (y >= ts * x + to) & (y <= bs * x + bo)
        for line in range(h):
            at = np.flatnonzero(inside[line])
            assert got.get((k, line)) == ((at[0], at[-1]) if len(at) else None)


def test_carrying_on_over_runs_is_that_over_pixels(spark):
    rng = np.random.default_rng(4)
    masks, quads = [], []
    for k in range(12):
        m = np.zeros((70, 60), bool)
        m[8:60, 9:50] = True
        m |= rng.random(m.shape) < 0.08 * (k % 3)
        masks.append(m)
        s = rng.uniform(-0.06, 0.06, 4)
        quads += [(k, "left", s[0], 14.0), (k, "right", s[1], 44.0 - k), (k, "top", s[2], 12.0 + k % 4), (k, "bottom", s[3], 50.0)]
    shape = sheet.quadrilaterals(spark.createDataFrame([(k, n, float(a), float(b)) for k, n, a, b in quads], "image_id long, side string, slope double, offset double"))
    pixels = spark.createDataFrame(mask_rows(masks), "image_id long, x int, y int").withColumn("inside", F.lit(True))
    key = lambda df: {(r["image_id"], r["side"]): round(r["share"], 9) for r in df.collect()}
    want, got = key(sheet.carried_on(pixels, shape)), key(runs.carried_on(runs.runs_of_pixels(pixels), shape))
    assert got == want and len(set(got.values())) > 6


def test_filters_against_numpy(spark):
    rng = np.random.default_rng(5)
    pictures = [rng.integers(0, 256, s) for s in ((9, 11), (1, 7), (6, 1), (30, 4))]
    weights = [1, 5, 9, 2, 3]  # not the same both ways
    got = {(r["image_id"], r["y"]): r["v"] for r in lines.filtered(line_rows(spark, pictures), weights, ("v",)).collect()}
    for k, p in enumerate(pictures):
        pad = np.pad(p, 2, mode="edge")
        across = sum(wt * pad[:, i : i + p.shape[1]] for i, wt in enumerate(weights))
        both = sum(wt * across[i : i + p.shape[0]] for i, wt in enumerate(weights))
        assert all(got[k, y] == both[y].tolist() for y in range(p.shape[0]))
    with pytest.raises(ValueError, match="middle"):
        lines.filtered(line_rows(spark, pictures), [1, 2], ("v",))


@pytest.mark.parametrize("radius", [0.6, 1.0, 3.5])
def test_sharpening_is_near_the_kernel(spark, radius):
    rng = np.random.default_rng(6)
    p = np.clip(np.cumsum(rng.integers(-20, 21, (24, 20, 3)), axis=1) + 128, 0, 255).astype(np.uint8)
    got = np.array([[r["r"], r["g"], r["b"]] for r in lines.sharpened(line_rows(spark, [p], "rgb"), radius).orderBy("y").collect()]).transpose(0, 2, 1)
    assert np.abs(got.astype(int) - raster.sharpen(p, radius).astype(int)).max() <= 2
    with pytest.raises(ValueError, match="radius"):
        lines.sharpened(line_rows(spark, [p], "rgb"), 21)


@pytest.mark.parametrize("kind", ["box", "triangle"])
def test_sizes_against_whole_weights(spark, kind):
    rng = np.random.default_rng(7)
    to = [(7, 5), (4, 9), (1, 1), (26, 21), (13, 3)]
    pictures = [rng.integers(0, 256, (10, 13)) for _ in to]
    of = spark.createDataFrame([(k, 13, 10, w, h) for k, (w, h) in enumerate(to)], "image_id long, width int, height int, to_width int, to_height int")
    got = {}
    for r in lines.resized(line_rows(spark, pictures), of, kind, ("v",)).collect():
        got.setdefault(r["image_id"], {})[r["y"]] = r["v"]

    def table(n, m):
        t, s = np.mgrid[0:m, 0:n]
        if kind == "box":
            return np.maximum(0, np.minimum((t + 1) * n, (s + 1) * m) - np.maximum(t * n, s * m))
        return np.maximum(0, 2 * max(n, m) - np.abs((2 * s + 1) * m - (2 * t + 1) * n))

    for k, (w, h) in enumerate(to):
        across, down = table(13, w), table(10, h)
        total, share = down @ pictures[k] @ across.T, np.outer(down.sum(1), across.sum(1))
        want = (2 * total + share) // (2 * share)
        assert [got[k][y] for y in range(h)] == want.tolist()
        if w <= 13 and h <= 10:
            assert np.abs(want - raster.resampled(pictures[k].astype(np.uint8), w, h, kind).astype(int)).max() <= 1
    with pytest.raises(ValueError, match="box, triangle or lanczos"):
        lines.resized(line_rows(spark, pictures), of, "sharp", ("v",))


def test_tilts_cost_lines_and_say_the_same(spark):
    rng = np.random.default_rng(8)
    pictures = [rng.integers(0, 256, s) for s in ((20, 33), (40, 9))]
    text = np.full((90, 120), 220)
    yy, xx = np.mgrid[0:90, 0:120]
    text[((yy - xx * np.tan(np.radians(4))) % 12 < 4)] = 40
    pictures.append(text)
    of, packed = sizes_of(spark, pictures), line_rows(spark, pictures)
    pixels = lines.unpacked(packed, ("v",))
    angles = of.select("image_id", F.explode(F.array(*[F.lit(t) for t in (-10.0, -3.3, -0.1, 0.0, 0.1, 2.0, 7.7, 10.0)])).alias("tilt"))
    key = lambda df: {(r["image_id"], r["tilt"]): round(r["sharpness"], 6) for r in df.collect()}
    assert key(lines.line_sharpness(lines.darkness_sums(packed, of), of, angles)) == key(measures.line_sharpness(pixels, of, angles))
    turned = {r["image_id"]: r["degrees"] for r in lines.suggest_straightening(packed, of).collect()}
    assert turned == {r["image_id"]: r["degrees"] for r in measures.suggest_straightening(pixels, of).collect()} and abs(turned[2] + 4) < 0.3


def test_flattening_lines_is_flattening_pixels(spark):
    rng = np.random.default_rng(9)
    pictures = [rng.integers(0, 256, (40, 50, 3)) for _ in range(7)]
    corners = [
        (5, 5, 40, 8, 44, 35, 3, 30), (0, 0, 49, 0, 49, 39, 0, 39), (25, 1, 48, 20, 24, 38, 2, 19), (40, 4, 44, 34, 8, 36, 6, 3),
        (3.5, 30.25, 40.5, 2.5, 47, 20, 12, 38), (-6, -3, 55, 2, 52, 45, -2, 41), (10, 10, 30, 10, 30, 30, 10, 30),
    ]
    quads = spark.createDataFrame([(k, 50, 40, *map(float, c)) for k, c in enumerate(corners)], "image_id long, width int, height int, " + ", ".join(f"c{k} double" for k in range(8)))
    packed = line_rows(spark, pictures, "rgb")
    got = lines.flattened(packed, quads)
    key = lambda df: {(r["image_id"], r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in df.collect()}
    assert key(lines.unpacked(got)) == key(acts.flatten(lines.unpacked(packed), quads))
    assert {tuple(r) for r in lines.digest(got).collect()} == {tuple(r) for r in acts.digest(lines.unpacked(got)).collect()}


def test_levels_and_detail_of_lines(spark):
    rng = np.random.default_rng(10)
    pictures = [rng.integers(0, 256, (8, 9, 3)) for _ in range(3)]
    levels = spark.createDataFrame([(0, c, 20 * c, 200 + c) for c in range(3)] + [(1, c, 0, 255) for c in range(3)], "image_id long, channel int, black int, white int")
    packed = line_rows(spark, pictures, "rgb")
    key = lambda df: {(r["image_id"], r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in df.collect()}
    assert key(lines.stretched(packed, levels)) == key(acts.apply_levels(lines.unpacked(packed), levels))
    grey = packed.select("image_id", "y", F.col("g").alias("v"))
    of = {r["image_id"]: round(r["detail"], 9) for r in lines.detail(grey).collect()}
    assert of == {r["image_id"]: round(r["detail"], 9) for r in measures.detail(lines.unpacked(grey, ("v",))).collect()}
    assert lines.packed(lines.unpacked(packed)).orderBy("image_id", "y").collect() == packed.orderBy("image_id", "y").collect()


def test_values_of_sliders(spark):
    row = spark.range(1).select(F.array(F.lit(0), F.lit(250), F.lit(100)).alias("c")).select(tones.moved(F.col("c"), F.lit(-10.0)).alias("down"), tones.moved(F.col("c"), F.lit(10.0)).alias("up"), tones.percent(F.col("c")).alias("p")).first()
    assert row["down"] == [0, 224, 74] and row["up"] == [26, 255, 126] and abs(row["p"] - 350 / 3 / 2.55) < 1e-9
