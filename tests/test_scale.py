"""What grows with the pictures is merged, not broadcast; and the kernels' quick ways tell what the plain ones tell."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetspark.functions import tones
from sheetspark.kernels import jpeg, paper, raster
from sheetspark.operators import acts, images, lines, measures, runs, sheet
from sheetspark.queries import QUERIES, framed
from sheetspark.sources import scratch, synthetic


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j2_histogram_on_a_mask", "a16_tone_curve", "a19_correlation", "p11_flatten", "p16_on_paper", "g13_carried_on", "g13_carried_on_over_runs"])
def test_pixels_and_runs_are_merged_and_never_broadcast(name, spark, sf):
    found = plan(QUERIES[name](spark, sf))
    assert "SortMergeJoin" in found and "Broadcast" not in found


@pytest.mark.parametrize("name", ["g12_quad_shares"])
def test_pixels_meet_a_row_a_picture_where_they_are(name, spark, sf):
    found = plan(QUERIES[name](spark, sf))
    assert "Broadcast" not in found and "SortMergeJoin" not in found
    assert found.count("ShuffledHashJoin") == 1 and "Sort [" not in found


def test_pixels_stay_where_they_are_to_meet_a_mask(spark, sf):
    found = plan(QUERIES["j2_histogram_on_a_mask"](spark, sf))
    assert found.count("ShuffledHashJoin [image_id") == 1
    moved = [line for line in found.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("x#" not in line for line in moved)


def test_masks_as_bits(spark):
    """Masks of odd shapes: off the picture, with the last bit of a number, over several rows, with gaps, twice the same, of no picture."""
    rng = np.random.default_rng(12)
    own = {0: [(x, y) for x in range(-70, 140, 3) for y in (-5, 0, 1, 4095, 4096)], 1: [(63, 0), (64, 0), (127, 9), (4095, 3), (4096, 3), (9000, 20000)], 2: [(5, 5)] * 3, 3: [], None: [(0, 0)]}
    own[4] = [(int(x), int(y)) for x, y in rng.integers(0, 300, (2000, 2))]
    masked = [(i, x, y) for i, of in own.items() for x, y in of] + [(0, None, 1), (7, 1, 1)]
    pixels = {(i, x + dx, y + dy) for i, x, y in masked if i != 7 and x is not None for dx in (-1, 0, 1, 64) for dy in (0, 1)} | {(3, 0, 0), (8, 1, 1)}
    rows = [(*p, k) for k, p in enumerate(sorted(pixels, key=repr))] + [(0, None, 1, -1), (2, 5, 5, -2)]
    a, b = spark.createDataFrame(rows, "image_id long, x int, y int, k int"), spark.createDataFrame(masked, "image_id long, x int, y int")
    got = sorted(tuple(r) for r in measures.on_mask(a, b).collect())
    assert got == sorted(tuple(r) for r in a.join(b, ["image_id", "x", "y"], "left_semi").collect()) and len(got) > 2000


@pytest.mark.parametrize("name, counts, draws", [("a3_suggest_levels", 1, 1), ("p4_apply_levels", 1, 2)])
def test_levels_come_of_one_count_of_pixels_and_meet_them_unsorted(name, counts, draws, spark, sf):
    found = plan(QUERIES[name](spark, sf))
    assert "Broadcast" not in found and "SortMergeJoin" not in found
    assert found.count("Generate posexplode(array(r") == counts and found.count("FileScan") == draws
    assert found.count("Sort [") == 1 and found.count("ShuffledHashJoin") == draws - 1


def test_levels_of_odd_histograms(spark):
    """Ink and paper as walked value by value: no bright pixel, one value, gaps, equal tops, a hump down to the last value."""
    rng = np.random.default_rng(41)
    shapes = [{5: 900, 60: 100}, {200: 50}, {63: 10, 64: 10}, {0: 1, 1: 99, 255: 500}, {64: 40, 65: 40, 66: 40, 67: 3}, {k: 10 for k in range(256)}, {100: 11, 101: 1, 102: 10, 103: 100, 104: 100}]
    shapes += [{int(v): int(n) for v, n in zip(rng.choice(256, 40, False), rng.integers(1, 60, 40), strict=True)} for _ in range(20)]
    rows = [(k, 0, v, n) for k, shape in enumerate(shapes) for v, n in shape.items()]
    counts = spark.createDataFrame(rows, "image_id long, channel int, value int, n long")

    def black(shape):
        seen, total = 0, sum(shape.values())
        for v in sorted(shape):
            seen += shape[v]
            if seen > total // 100:
                return v
        return 0

    def white(shape):
        bright = [(n, v) for v, n in shape.items() if v >= 64]
        if not bright:
            return 255
        most, v = max(bright)
        while shape.get(v - 1, 0) > most // 10:
            v -= 1
        return v

    keys = ["image_id", "channel"]
    assert {r["image_id"]: r["black"] for r in measures.darkest_ink(counts, keys).collect()} == {k: black(s) for k, s in enumerate(shapes)}
    assert {r["image_id"]: r["white"] for r in measures.paper_floor(counts, keys).collect()} == {k: white(s) for k, s in enumerate(shapes)}
    pixels = counts.selectExpr("image_id", "explode(sequence(1, cast(n as int))) as x", "0 as y", "value as r", "255 - value as g", "null as b").union(spark.sql("select null, 1, 0, 9, 9, 9"))
    found = {(r["image_id"], r["channel"]): (r["black"], r["white"]) for r in measures.suggest_levels(pixels).collect()}
    useful = lambda s: (black(s), white(s)) if white(s) - black(s) >= 16 else (0, 255)
    turned = [{255 - v: n for v, n in s.items()} for s in shapes]
    want = {(k, c): useful(s) for c, of in ((0, shapes), (1, turned)) for k, s in enumerate(of)}
    assert want.items() <= found.items() and {c for _, c in found} == {0, 1, 2} and None not in {i for i, _ in found}


def test_stretching_by_ends_is_stretching_by_tables(spark):
    """Every value of a channel, values that no table has, channels without levels, ends that are equal or stand the wrong way."""
    values = [*range(256), -1, 256, None]
    rng = np.random.default_rng(42)
    some = lambda: [values[i] for i in rng.permutation(len(values))]
    rows = [(i, x, 0, *rgb, i) for i in range(6) for x, rgb in enumerate(zip(values, some(), some(), strict=True))]
    pixels = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, kept int")
    ends = {0: [(0, 20, 200), (1, 30, 190), (2, 7, 255)], 1: [(1, 90, 90)], 2: [(0, 0, 255), (1, 0, 255), (2, 0, 255)], 3: [(0, 200, 20), (2, 0, 255)], 4: [(0, 17, 152), (1, 16, 141), (2, 11, 126)]}
    levels = spark.createDataFrame([(i, *e) for i, of in ends.items() for e in of], "image_id long, channel int, black int, white int")
    made = acts.apply_levels(pixels, levels)
    got = {(r["image_id"], r["x"]): tuple(r[c] for c in "rgb") for r in made.collect()}
    assert made.columns == pixels.columns and len(got) == len(rows)
    tables = levels.where("black <> 0 or white <> 255").withColumn("t", tones.stretch_table(F.col("black"), F.col("white")))
    tables = tables.groupBy("image_id").agg(*[F.first(F.when(F.col("channel") == k, F.col("t")), True).alias(f"t{c}") for k, c in enumerate("rgb")])
    looked = pixels.join(tables, "image_id", "left").withColumns({c: F.coalesce(F.get(f"t{c}", c), c) for c in "rgb"})
    calm, changes = tones.calmed(*map(F.col, "rgb")), F.coalesce("tr", "tg", "tb").isNotNull()
    want = looked.select("image_id", "x", *[F.when(changes, calm[c]).otherwise(F.col(c)).alias(c) for c in "rgb"])
    assert got == {(r["image_id"], r["x"]): tuple(r[c] for c in "rgb") for r in want.collect()}
    for i, x, _, *rgb, _ in rows:
        of = {c: (b, w) for c, b, w in ends.get(i, []) if (b, w) != (0, 255)}
        if of and all(v is not None and 0 <= v <= 255 for v in rgb):
            put = [raster.stretch_table(*of[k])[v] if k in of else v for k, v in enumerate(rgb)]
            assert got[i, x] == tuple(raster.calm(np.array([[put]], np.uint8))[0, 0].tolist())


def test_sharpening_takes_the_lines_along(spark, sf):
    assert "Join" not in plan(QUERIES["p8_sharpened_lines"](spark, sf))


def test_labels_of_runs_are_merged_and_never_broadcast(spark, sf, monkeypatch):
    plans, write = [], scratch.Rounds.write

    def seen(self, df):
        plans.append(plan(df))
        return write(self, df)

    monkeypatch.setattr(scratch.Rounds, "write", seen)
    ids = synthetic.image_ids(spark, sf).where("image_id < 3")
    dark = runs.runs_of_lines(synthetic.lines(ids), lambda v: v <= 100)
    plans.append(plan(runs.largest(runs.labelled(dark))))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


# ---- kernels: work that grows with what they look for, not with every pixel anew


def by_pixels(g, tilt):
    """The sharpness of a tilt with a bin for each pixel."""
    h, w = g.shape
    sin, cos = np.sin(np.float32(math.radians(tilt))), np.cos(np.float32(math.radians(tilt)))
    n = int(math.ceil(h * cos + w * abs(sin))) + 1
    y, x = np.mgrid[0:h, 0:w].astype(np.float32)
    bins = np.clip((y * cos - x * sin + (np.float32(w) * sin if sin > 0 else np.float32(0))).astype(int), 0, n - 1).ravel()
    count = np.bincount(bins, minlength=n)
    mean = np.bincount(bins, 255.0 - g.ravel(), n) / np.maximum(count, 1)
    whole = count >= max(1, count.max() * 9 // 10)
    ok = whole[:-2] & whole[1:-1] & whole[2:]
    bend = (mean[2:] - 2 * mean[1:-1] + mean[:-2]) ** 2
    return float(bend[ok].mean()) if ok.sum() >= 3 else 0.0


@pytest.mark.parametrize("tilt", [-10, -3.3, 0, 0.1, 7])
def test_a_tilt_costs_the_bins_that_lines_cross(tilt):
    g = raster.grey(synthetic.drawn(3))
    assert raster.line_sharpness(g, tilt) == by_pixels(g, tilt)
    assert len(raster.crossings(*g.shape, tilt)[0]) < g.size / 5


def test_all_rays_of_a_side_are_read_at_once(monkeypatch):
    calls, plain = [], paper.leaving
    monkeypatch.setattr(paper, "leaving", lambda *given: calls.append(1) or plain(*given))
    assert paper.find_paper(synthetic.drawn(2)) is not None
    assert len(calls) == 2


def test_all_offsets_of_a_cut_are_tried_at_once():
    a = np.random.default_rng(2).integers(0, 256, (60, 70, 3)).astype(np.uint8)
    whole, part = images.gradients(raster.grey(a)), images.gradients(raster.grey(a[11:41, 23:61]))

    def alike(y, x):
        return np.corrcoef(whole[y : y + 30, x : x + 38].ravel(), part.ravel())[0, 1]

    best = max(((alike(y, x), -y, -x) for y in range(31) for x in range(33)))
    assert images.best_offset(whole, part, range(33), range(31)) == (-best[2], -best[1]) == (23, 11)
    assert not hasattr(images, "correlation")  # none is reckoned an offset at a time
    assert images.best_offset(whole, part, range(40, 50), range(31)) == (0, 0)


def test_resizing_takes_neighbours_where_they_are():
    at, share = raster.weights(64, 20, "lanczos")
    assert len(raster.bands(64, 20, "lanczos")) == 20
    for k, (first, used) in enumerate(raster.bands(64, 20, "lanczos")):
        places = np.flatnonzero(share[k])
        assert at[k][places].tolist() == list(range(first, first + len(used))) and share[k][places].tolist() == used.tolist()


def test_tilts_of_lines_move_bins_and_not_stretches(spark, sf):
    found = plan(QUERIES["a9_line_sharpness"](spark, sf))
    assert "MapInArrow" in found and "Broadcast" not in found and "Generate sequence" not in found


def test_rays_are_read_in_batches(spark, sf):
    found = plan(QUERIES["g9_edges_across_sides"](spark, sf))
    assert "MapInArrow" in found and "BroadcastHashJoin [image_id#" not in found.split("MapInArrow")[0]


@pytest.mark.parametrize("name", ["p10_resized_by_boxes", "p22_resized_by_triangles"])
def test_sizes_move_sums_of_lines_and_sort_no_lines(name, spark, sf):
    found = plan(QUERIES[name](spark, sf))
    assert "MapInArrow" in found and "Broadcast" not in found and "SortMergeJoin" not in found and "collect_list" not in found


@pytest.mark.parametrize("kind", ["box", "triangle", "lanczos"])
def test_a_target_line_adds_up_what_lines_in_any_batches_are_for_it(kind, spark):
    ids = spark.range(7).withColumnRenamed("id", "image_id")
    rows = synthetic.lines(ids).select("image_id", "y", "v")
    to = ids.selectExpr("image_id", "64 as width", "64 as height", "cast(9 + image_id as int) as to_width", "70 as to_height")
    tell = lambda df: sorted(tuple(map(str, r)) for r in lines.resized(df, to, kind, ("v",)).collect())
    whole = tell(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert tell(rows) == whole == tell(rows.repartition(5, "y"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_detail_is_reckoned_in_batches(spark, sf):
    found = plan(QUERIES["a18_detail"](spark, sf))
    assert "MapInArrow" in found and "lambdafunction" not in found


def test_drawn_lines_are_stretches_and_no_lambdas(spark, sf):
    found = synthetic.lines(synthetic.image_ids(spark, sf))
    assert "lambdafunction" not in plan(found)
    pixels = synthetic.pixels(synthetic.image_ids(spark, sf))
    keys = ("image_id", "x", "y", "r", "g", "b")
    assert lines.unpacked(found).select(*keys).exceptAll(pixels.select(*keys)).count() == 0


def test_a_blur_copies_no_neighbours(monkeypatch):
    a = synthetic.drawn(1)
    want = raster.sharpen(a, 1.0)
    monkeypatch.setattr(np, "take", lambda *_, **__: pytest.fail("neighbours are copied"))
    assert (raster.sharpen(a, 1.0) == want).all()


def test_a_scan_is_read_by_looked_up_steps(monkeypatch):
    calls, plain = [], jpeg.windows
    monkeypatch.setattr(jpeg, "windows", lambda raw, at: calls.append(len(at)) or plain(raw, at))
    whole = jpeg.encode(synthetic.drawn(3), 85, jpeg.even_lengths)
    want = jpeg.encode(synthetic.drawn(3), 85)
    assert jpeg.rebuilt(whole) == want and len(calls) < 20
    monkeypatch.setattr(jpeg, "AHEAD", 3 * jpeg.BLOCK_BITS)
    assert jpeg.rebuilt(whole) == want
    with pytest.raises(jpeg.NotBaseline):
        jpeg.rebuilt(whole[: len(whole) // 2])


def test_pictures_are_gathered_before_pixels_move(spark):
    pixels = synthetic.pixels(spark.range(3).withColumnRenamed("id", "image_id"))
    found = plan(images.from_pixels(pixels.repartition(3, "x")))
    assert found.count("MapInArrow") == 2
    made = {r["image_id"]: r for r in images.from_pixels(pixels.repartition(3, "x")).collect()}
    assert made == {r["image_id"]: r for r in images.from_pixels(pixels).collect()} and all(r["error"] is None for r in made.values())


def test_runs_of_pixels_sort_words_and_no_pixels(spark):
    places = [*range(3, 40), *range(62, 66), 95, *range(127, 193)]
    mask = spark.createDataFrame([(1, x, 5) for x in places] + [(2, 0, 0)], "image_id bigint, x int, y int")
    found = runs.runs_of_pixels(mask)
    assert sorted(map(tuple, found.collect())) == [(1, 5, 3, 39), (1, 5, 62, 65), (1, 5, 95, 95), (1, 5, 127, 192), (2, 0, 0, 0)]
    assert plan(found).count("bit_or") > 0


def test_areas_that_one_task_has_whole_take_no_rounds(spark, sf, monkeypatch):
    tags, write = [], scratch.Rounds.write
    monkeypatch.setattr(scratch.Rounds, "write", lambda self, df: tags.append(self.root.rsplit("/", 1)[-1].split("-")[0]) or write(self, df))
    dark = runs.runs_of_lines(synthetic.lines(synthetic.image_ids(spark, sf).where("image_id < 3")), lambda v: v <= 100)
    tell = lambda df: sorted(map(tuple, df.select("image_id", "y", "x0", "x1", "label").collect()))
    whole = tell(runs.labelled(dark))
    assert whole and "labels" not in tags
    monkeypatch.setattr(lines, "BAND", 5)  # areas are cut, and put together in rounds
    assert tell(runs.labelled(dark)) == whole and "labels" in tags


def test_edges_of_lines_are_those_of_pixels(spark, sf):
    keep = lambda df: scratch.Rounds(spark, "test").write(df)
    grey = keep(framed(spark, sf).where("image_id < 3").select("image_id", "y", F.col("g").alias("v")))
    dark = runs.dark_runs(grey.withColumn("threshold", F.lit(100)))
    assert dark.exceptAll(runs.runs_of_lines(grey, lambda v: v <= 100)).count() == 0 and dark.count() > 300
    of = grey.select("image_id").distinct().selectExpr("image_id", "88 as width", "88 as height")
    outside = runs.reaching_the_border(dark, of)
    rough = keep(runs.largest(runs.labelled(runs.complement(outside, of))))
    told = keep(runs.marked(grey, rough, outside))
    pixels = keep(lines.unpacked(told, ("v",)).selectExpr("image_id", "x", "y", "v & 255 as v", "v & 256 <> 0 as inside", "v & 512 <> 0 as outside"))
    counts = lines.counted(told).selectExpr("image_id", "value & 256 <> 0 as inside", "value & 255 as value", "n")
    levels, boxes = keep(measures.paper_and_table(pixels, F.col("inside"))), keep(rough.select("image_id", "left", "top", "right", "bottom").distinct())
    assert measures.edge_levels(counts).exceptAll(levels).count() == 0 and levels.count() == grey.select("image_id").distinct().count()
    both = boxes.join(levels, "image_id")
    found = sheet.edges_of_lines(told, both.withColumnsRenamed({"top": "low", "bottom": "high"}), "y")
    found = found.unionByName(sheet.edges_of_lines(lines.columns(told, ("v",)), both.withColumnsRenamed({"left": "low", "right": "high"}), "x"))
    tell = lambda df: sorted(map(tuple, df.select("image_id", "side", "along", "across").collect()))
    assert tell(found) == tell(sheet.edge_points(pixels, levels, boxes)) and found.count() > 100


def test_columns_are_put_together_from_bands(spark, monkeypatch):
    rows = synthetic.lines(spark.range(3).withColumnRenamed("id", "image_id")).select("image_id", "y", "v")
    monkeypatch.setattr(lines, "BAND", 7)
    turned = lines.columns(rows, ("v",)).withColumnsRenamed({"x": "y"})
    assert lines.columns(turned, ("v",)).withColumnsRenamed({"x": "y"}).exceptAll(rows).count() == 0
    some = lines.columns(rows.withColumn("asked", F.array(F.lit(3), F.lit(70))), ("v",), "asked")
    assert some.select("x").distinct().collect() == [(3,)] and some.count() == 3


def test_edge_points_read_lines_and_no_windows_of_pixels(spark):
    """Lines with gaps, off the picture's corner and brighter than a byte, their pixels in any order, as they are read one by one."""
    rng = np.random.default_rng(2)
    rows, levels, boxes = [], {}, {}
    for i in range(3):
        x, y, at = np.arange(-7, 60), np.arange(-3, 50), (i, i + 20)
        inside = (x[None, :] >= 13) & (x[None, :] <= 39 - i) & (y[:, None] >= 12) & (y[:, None] <= 34)
        v = np.where(inside, 300, 20) + rng.integers(0, 9, inside.shape)
        gone = rng.random(inside.shape) < (0.03 if i else 0)
        rows += [(i, int(x[b]), int(y[a]), int(v[a, b]), bool(inside[a, b]), bool(not inside[a, b] and b + a != 70 + at[0])) for a, b in zip(*np.nonzero(~gone))]
        levels[i], boxes[i] = (40.0, 150.0, 90.0), (13, 12, 39 - i, 34)
    pixels = spark.createDataFrame(rows, "image_id long, x int, y int, v int, inside boolean, outside boolean").repartition(5, "x").sortWithinPartitions(F.hash("x", "y"))
    of = spark.createDataFrame([(i, *v) for i, v in levels.items()], "image_id long, step double, paper double, table double")
    box = spark.createDataFrame([(i, *v) for i, v in boxes.items()], "image_id long, left int, top int, right int, bottom int")
    want = set()
    for side, along, _, outward in sheet.SIDES:
        for i, (step, level, table) in levels.items():
            low, high = (boxes[i][1], boxes[i][3]) if along == "y" else (boxes[i][0], boxes[i][2])
            skip = (high - low + 1) // 6
            for a in range(low + skip, high + 1 - skip):
                line = sorted((r[1], *r[3:]) if along == "y" else (r[2], *r[3:]) for r in rows if r[0] == i and r[2 if along == "y" else 1] == a)
                on = [p[0] for p in line if p[2]]
                ray = line[::outward]
                for k in range(2, len(ray) - 13):
                    mean = lambda n, m, k=k, ray=ray: sum(p[1] for p in ray[k + n : k + m]) / (m - n)
                    near, past = mean(-2, 1), mean(1, 4)
                    if on and (ray[k][0] - on[len(on) // 2]) * outward >= 0 and near - past >= step and near >= level and past <= table and mean(4, 14) <= table and all(p[3] for p in ray[k + 4 : k + 14]):
                        want.add((i, side, a, ray[k][0] + 0.5 * outward))
                        break
    found = sheet.edge_points(pixels, of, box)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 100
    assert "Window" not in plan(found)


def test_kinds_of_lines_are_put_together_once_an_image(spark):
    ids = spark.range(40).withColumnRenamed("id", "image_id")
    for side in (64, 50):
        found = synthetic.lines(ids, side)
        drawn = plan(found)
        assert drawn.index("Generate explode") < drawn.index("array_repeat")  # which stands below, before lines are spread
        keys = ("image_id", "x", "y", "v", "r", "g", "b")
        got = lines.unpacked(found, ("v", "r", "g", "b")).select(*keys)
        want = synthetic.pixels(ids, side).select(*keys)
        assert got.exceptAll(want).count() == 0 and got.count() == 40 * side * side


def test_tilts_make_no_row_a_bin_in_any_batches(spark, monkeypatch):
    """Pictures of two sizes, one that lacks a line, in batches of a few lines; and the plan adds up no bins."""
    ids = spark.range(6).withColumnRenamed("id", "image_id")
    rows = synthetic.lines(ids).select("image_id", "y", F.when(F.col("image_id") % 2 == 0, F.col("v")).otherwise(F.slice("v", 5, 31)).alias("v"))
    rows = rows.where("image_id <> 4 or y <> 20")
    of = ids.selectExpr("image_id", "if(image_id % 2 = 0, 64, 31) as width", "64 as height")
    angles = of.select("image_id", F.explode(F.array(*[F.lit(t) for t in (-10.0, -0.4, 0.0, 3.0, 9.9)])).alias("tilt"))
    tell = lambda df: {(r["image_id"], r["tilt"]): round(r["sharpness"], 7) for r in df.collect()}
    found = lines.line_sharpness(lines.darkness_sums(rows, of), of, angles)
    assert "bin#" not in plan(found) and "lambdafunction" not in plan(found)
    whole = tell(found)
    assert whole == tell(measures.line_sharpness(lines.unpacked(rows, ("v",)), of, angles)) and len(whole) == 30
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert tell(lines.line_sharpness(lines.darkness_sums(rows.repartition(3, "y"), of), of, angles)) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_leans_are_tried_in_batches(spark):
    rng = np.random.default_rng(7)
    of = {(i, side): [(k / 30, float(m)) for k, m in zip(range(1, n + 1), rng.integers(-60, 61, n))] for i, n in enumerate((1, 2, 5, 29, 29, 28, 3)) for side in ("left", "top")}
    of[9, "top"] = [(k / 30, 4.0) for k in range(1, 30)]  # even
    of[9, "left"] = [(k / 30, -7.0 * k / 30) for k in range(1, 30)]
    of[8, "left"] = [(0.2, 1.0), (0.6, 1.0)]  # leans of both signs leave the same bow
    want = {}
    for key, readings in of.items():
        tried = []
        for lean in range(-12, 13):
            level = sorted(m - lean * p for p, m in readings)
            tried.append((round(level[len(level) // 2] - level[0], 6), abs(lean), -lean))
        want[key] = -min(tried)[2]
    rows = [(*key, p, m) for key, readings in of.items() for p, m in readings]
    found = sheet.leans(spark.createDataFrame(rows, "image_id long, side string, part double, miss double").repartition(3))
    assert {(r["image_id"], r["side"]): r["lean"] for r in found.collect()} == want
    assert "Generate" not in plan(found) and "sort_array" not in plan(found)


def test_channels_are_swapped_a_channel_at_a_time():
    for n in (3, 4):
        a = np.random.default_rng(n).integers(0, 256, (5, 7, n)).astype(np.uint8)
        image = {"height": 5, "width": 7, "nChannels": n, "mode": 16, "data": a.tobytes()}
        got = images.to_array(image)
        assert got.flags.c_contiguous and got.flags.writeable and (got == a[..., 2::-1]).all()
        assert images.to_array(images.to_image(got)).tolist() == got.tolist()
    assert (images.swapped(a) == a[..., 2::-1]).all()
