"""Registered queries of the document-image operators, over images and scans made from the page ids."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetspark.functions import geometry, tones
from sheetspark.kernels import jpeg, raster
from sheetspark.operators import acts, catalog, images, lines, measures, runs, sheet
from sheetspark.operators.joined import merged
from sheetspark.plans import pages, recipe
from sheetspark.sources import deletes, documents, pictures, synthetic
from sheetspark.sources.files import images_to_pdf, load_images
from sheetspark.sources.scratch import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SIDE = synthetic.SIDE

#: The synthetic images, for the independent engine.
PX = """with px as (
    select *, v + case when sheet and not writing then 12 else 0 end as r, v as g, v - case when sheet and not writing then 10 else 0 end as b from (
    select *, (case when writing then 55 + image_id % 5 when sheet then 150 + x // 4 + image_id % 11 else 20 + image_id % 9 end)::int as v from (
    select *, sheet and y % 6 < 2 and x between 14 and 48 and y between 15 and 50 as writing from (
    select page_id as image_id, tx.x::int as x, ty.y::int as y,
        tx.x between 8 + page_id % 5 and 55 - page_id % 3 and ty.y between 6 + page_id % 7 and 57 - page_id % 4 as sheet
    from pages, range(64) tx(x), range(64) ty(y))))
)"""
CH = PX + """, chan as (
    select image_id, 0 as channel, r::int as value from px union all select image_id, 1, g::int from px union all select image_id, 2, b::int from px
), counts as (select image_id, channel, value, count(*) as n from chan group by all)"""
LEVELS = CH + """, seen as (
    select *, sum(n) over (partition by image_id, channel order by value) as s, sum(n) over (partition by image_id, channel) as t from counts
), ink as (select image_id, channel, min(value) as black from seen where s > t // 100 group by all),
top as (select image_id, channel, arg_max(value, n * 1000 + value) as peak, max(n) as peak_n from counts where value >= 64 group by all),
full_range as (select image_id, channel, v::int as value from top, range(256) q(v)),
gap as (
    select f.image_id, f.channel, max(f.value) as stop from full_range f join top t using (image_id, channel) left join counts c using (image_id, channel, value)
    where f.value < t.peak and coalesce(c.n, 0) <= t.peak_n // 10 group by all
), levels as (
    select i.image_id, i.channel, case when coalesce(g.stop + 1, 0) - black >= 16 then black else 0 end::int as black,
        case when coalesce(g.stop + 1, 0) - black >= 16 then coalesce(g.stop + 1, 0) else 255 end::int as white
    from ink i join top using (image_id, channel) left join gap g using (image_id, channel)
)"""
FILES = """with p as (select page_id as p, page_id // 8 as scan_id, (page_id % 8 + 1)::int as num from pages),
files as (
    select scan_id, 'photo' as kind, num, p % 997 + 2000 as length from p where p % 17 <> 0 and scan_id % 11 <> 10
    union all select scan_id, 'page', num, p % 499 + 900 from p where (p % 5 <> 0 or scan_id % 4 = 1) and scan_id % 7 <> 5 and scan_id % 11 <> 10
    union all select distinct scan_id, 'pdf', null::int, scan_id % 101 + 5000 from p where scan_id % 3 = 0 and scan_id % 7 <> 5 and scan_id % 11 <> 10
), photo as (select scan_id, num from files where kind = 'photo'), page as (select scan_id, num from files where kind = 'page'),
unscanned as (select scan_id, num from photo except select scan_id, num from page), skipped as (select scan_id, num from page except select scan_id, num from photo),
states as (
    select *, (last_num + 1)::int as next_num, case when has_pdf then 'done' when photos = 0 and pages = 0 then 'empty' when pages = 0 then 'shooting' when unscanned = 0 then 'ready' else 'scanning' end as state
    from (select s.scan_id, count(*) filter (where kind = 'photo') as photos, count(*) filter (where kind = 'page') as pages, coalesce(bool_or(kind = 'pdf'), false) as has_pdf,
        coalesce(max(num), 0)::int as last_num, coalesce(sum(length) filter (where kind = 'photo'), 0)::bigint as photo_bytes, coalesce(sum(length) filter (where kind = 'pdf'), 0)::bigint as pdf_bytes,
        any_value(coalesce(u.n, 0)) as unscanned, any_value(u.first)::int as first_unscanned
    from (select distinct scan_id from p) s left join files f using (scan_id) left join (select scan_id, count(*) as n, min(num) as first from unscanned group by 1) u using (scan_id) group by s.scan_id)
)"""
DIGEST = """ select image_id, count(*) as n_pixels, sum({0})::bigint as weighed from {1} group by image_id"""
RGB = "r::bigint * (x * 31 + y * 17 + 1) + g::bigint * (x * 31 + y * 17 + 2) + b::bigint * (x * 31 + y * 17 + 3)"


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.image_ids(spark, sf_dir)


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.pixels(ids(spark, sf_dir))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(spark, sf_dir).select("image_id", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.lines(ids(spark, sf_dir))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).where("sheet").select("image_id", "x", "y")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.scan_files(ids(spark, sf_dir))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.states(synthetic.scans(ids(spark, sf_dir)), files(spark, sf_dir))


# ---- measures


@query(PX + " select image_id, v as value, count(*) as n from px group by all")
def a1_brightness_histogram(spark, sf_dir):
    return measures.histogram(px(spark, sf_dir))


SHEET_SQL = PX + """ select image_id, channel, value, count(*) as n from (select image_id, 0 as channel, r::int as value from px where sheet union all select image_id, 1, g::int from px where sheet union all select image_id, 2, b::int from px where sheet) group by all"""


@query(SHEET_SQL)
def a2_channel_histograms(spark, sf_dir):
    return measures.channel_histograms(px(spark, sf_dir), F.col("sheet"))


@query(SHEET_SQL)
def j2_histogram_on_a_mask(spark, sf_dir):
    return measures.channel_histograms(px(spark, sf_dir), mask(spark, sf_dir))


@query(LEVELS + " select * from levels")
def a3_suggest_levels(spark, sf_dir):
    return measures.suggest_levels(px(spark, sf_dir))


@query(LEVELS + " select image_id, channel, black from ink")
def a4_darkest_ink(spark, sf_dir):
    return measures.darkest_ink(measures.channel_histograms(px(spark, sf_dir)), ["image_id", "channel"])


@query(LEVELS + " select t.image_id, t.channel, coalesce(g.stop + 1, 0)::int as white from top t left join gap g using (image_id, channel)")
def a5_paper_floor(spark, sf_dir):
    return measures.paper_floor(measures.channel_histograms(px(spark, sf_dir)), ["image_id", "channel"])


@query(PX + """, h as (select image_id, v as value, count(*) as n from px group by all), c as (
    select image_id, value, sum(n) over w as d, sum(n * value) over w as ds, sum(n) over (partition by image_id) as t, sum(n * value) over (partition by image_id) as ts
    from h window w as (partition by image_id order by value)
), s as (select image_id, value, row_number() over (partition by image_id order by d::double * (t - d)::double * power(ds::double / d - (ts - ds)::double / (t - d), 2) desc, value) as k from c where t > d)
select image_id, value as threshold from s where k = 1""")
def a6_otsu_threshold(spark, sf_dir):
    return measures.otsu_threshold(measures.histogram(px(spark, sf_dir)))


MIDDLES = PX + """, h as (select image_id, sheet, v as value, count(*) as n from px group by all), m as (
    select image_id, sheet, min(value) as mid from (select *, sum(n) over (partition by image_id, sheet order by value) as s, sum(n) over (partition by image_id, sheet) as t from h) where 2 * s >= t group by all
), lv as (select image_id, greatest((max(mid) filter (where sheet) - max(mid) filter (where not sheet)) * 0.4::double, 14.0::double) as step,
    max(mid) filter (where not sheet) + (max(mid) filter (where sheet) - max(mid) filter (where not sheet)) / 2.0::double as paper,
    max(mid) filter (where not sheet) + (max(mid) filter (where sheet) - max(mid) filter (where not sheet)) * 0.25::double as "table"
    from m group by image_id having max(mid) filter (where sheet) > max(mid) filter (where not sheet))"""


@query(MIDDLES + " select * from lv")
def a7_paper_and_table_levels(spark, sf_dir):
    return measures.paper_and_table(px(spark, sf_dir), F.col("sheet"))


@query(MIDDLES + " select image_id, sheet, mid as middle from m")
def a8_middle_brightness(spark, sf_dir):
    return measures.middle_brightness(measures.histogram(px(spark, sf_dir), keys=("image_id", "sheet")), ["image_id", "sheet"])


SHARP = """, bins as (
    select image_id, tilt, least(trunc(round(y * cos(radians(tilt)) - x * sin(radians(tilt)) + case when sin(radians(tilt)) > 0 then 64 * sin(radians(tilt)) else 0 end, 9))::int,
        ceil(round(64 * cos(radians(tilt)) + 64 * abs(sin(radians(tilt))), 9))::int) as bin, avg(255 - v) as dark, count(*) as n
    from px join ang using (image_id) group by all
), near as (
    select *, max(n) over (partition by image_id, tilt) as most, lag(bin) over w as pb, lag(dark) over w as pd, lag(n) over w as pn, lead(bin) over w as nb, lead(dark) over w as nd, lead(n) over w as nn
    from bins window w as (partition by image_id, tilt order by bin)
), marked as (select *, pb = bin - 1 and nb = bin + 1 and least(n, pn, nn) >= greatest(1, most * 9 // 10) as ok from near),
sharp as (select image_id, tilt, case when count(*) filter (where ok) >= 3 then sum(power(nd - 2 * dark + pd, 2)) filter (where ok) / count(*) filter (where ok) else 0.0 end as sharpness from marked group by all)"""
SHARP_ROUGH = PX + ", ang as (select page_id as image_id, (k - 10)::double as tilt from pages, range(21) q(k))" + SHARP


@query(SHARP_ROUGH + " select image_id, tilt, round(sharpness, 4) as sharpness from sharp")
def a9_line_sharpness(spark, sf_dir):
    angles = ids(spark, sf_dir).select("image_id", measures.tilts(-10, 10, 1).alias("tilt"))
    of = sizes(spark, sf_dir)
    return lines.line_sharpness(lines.darkness_sums(packed(spark, sf_dir), of), of, angles).withColumn("sharpness", F.round("sharpness", 4))


@query(SHARP_ROUGH + ", r as (select *, row_number() over (partition by image_id order by round(sharpness, 9) desc, tilt) as k from sharp) select image_id, tilt, round(sharpness, 4) as sharpness from r where k = 1 and sharpness > 0")
def a10_sharpest_tilt(spark, sf_dir):
    angles = ids(spark, sf_dir).select("image_id", measures.tilts(-10, 10, 1).alias("tilt"))
    of = sizes(spark, sf_dir)
    scored = lines.line_sharpness(lines.darkness_sums(packed(spark, sf_dir), of), of, angles).where("sharpness > 0")
    best = scored.groupBy("image_id").agg(F.max(F.struct(F.round("sharpness", 9).alias("s"), (-F.col("tilt")).alias("t"))).alias("b"))
    return best.select("image_id", (-F.col("b.t")).alias("tilt"), F.round("b.s", 4).alias("sharpness"))


@query(
    SHARP_ROUGH.replace("bins as", "bins0 as").replace("from bins ", "from bins0 ").replace("near as", "near0 as").replace("from near)", "from near0)").replace("marked as", "marked0 as").replace("from marked ", "from marked0 ").replace("sharp as", "sharp0 as")
    .replace(", ang as", ", ang0 as").replace("join ang ", "join ang0 ")
    + """, peak as (select image_id, tilt from (select *, row_number() over (partition by image_id order by round(sharpness, 9) desc, tilt desc) as k from sharp0) where k = 1 and sharpness >= 4),
    ang as (select image_id, round(tilt + (k - 10) / 10.0, 6) as tilt from peak, range(21) q(k))"""
    + SHARP
    + """, fine as (select image_id, tilt from (select *, row_number() over (partition by image_id order by round(sharpness, 9) desc, tilt) as k from sharp where sharpness > 0) where k = 1)
    select page_id as image_id, coalesce(least(greatest(-tilt, -10.0), 10.0), 0.0)::double as degrees from pages left join fine on page_id = image_id"""
)
def a11_suggest_straightening(spark, sf_dir):
    return lines.suggest_straightening(packed(spark, sf_dir), sizes(spark, sf_dir)).select("image_id", (F.col("degrees") + 0.0).alias("degrees"))


@query(PX + """ select image_id, count(*) as area, min(x) as "left", min(y) as top, max(x) as "right", max(y) as bottom from px where sheet group by image_id""")
def a12_blob_bounds(spark, sf_dir):
    return sheet.bounds(mask(spark, sf_dir))


@query(FILES + " select scan_id, photo_bytes, pdf_bytes from states")
def a13_byte_totals(spark, sf_dir):
    return states(spark, sf_dir).select("scan_id", "photo_bytes", "pdf_bytes")


@query(PX + " select image_id, (r * 2126 + g * 7152 + b * 722) // 10000 // 8 as bucket, count(*) as n from px group by all")
def a14_coarse_histogram(spark, sf_dir):
    grey = acts.to_grey(px(spark, sf_dir))
    return measures.histogram(grey.withColumn("bucket", F.expr("cast(v div 8 as int)")), "bucket").withColumnRenamed("value", "bucket")


@query(PX + ", k as (select image_id, v, row_number() over (partition by image_id order by v) as i from px) select image_id, v as value from k where i = floor(4095 * 0.9 + 0.5) + 1")
def a15_percentile(spark, sf_dir):
    return measures.ranked_value(measures.histogram(px(spark, sf_dir)), 0.9)


@query(PX + " select image_id, v as value, avg(least(255, v * 2)) as mean_after, count(*) as n from px group by all having count(*) >= 50")
def a16_tone_curve(spark, sf_dir):
    before = px(spark, sf_dir)
    return measures.tone_curve(before, before.withColumn("v", F.least(F.lit(255), F.col("v") * 2)))


@query(PX + " select image_id, round(avg((greatest(r, g, b) - least(r, g, b))::double / greatest(r, g, b)), 6) as saturation, avg(r) as mean_r, avg(g) as mean_g, avg(b) as mean_b, avg(r - b) as cast from px group by image_id".replace(" as cast", ' as "cast"'))
def a17_colour_summary(spark, sf_dir):
    return measures.colour_summary(px(spark, sf_dir)).withColumn("saturation", F.round("saturation", 6))


@query(PX + """, n as (select *, lag(v) over h as l, lead(v) over h as rr, lag(v) over c as u, lead(v) over c as d from px
    window h as (partition by image_id, y order by x), c as (partition by image_id, x order by y))
    select image_id, round(sqrt(avg(power(l + rr + u + d - 4 * v, 2))), 6) as detail from n where l is not null and rr is not null and u is not null and d is not null group by image_id""")
def a18_detail(spark, sf_dir):
    return lines.detail(packed(spark, sf_dir)).withColumn("detail", F.round("detail", 6))


@query(PX + " select image_id, round(corr(v, least(255, v + x)), 6) as correlation from px where x % 3 = 0 and y % 3 = 0 group by image_id")
def a19_correlation(spark, sf_dir):
    before = px(spark, sf_dir)
    return measures.correlation(before, before.withColumn("v", F.least(F.lit(255), F.col("v") + F.col("x")))).withColumn("correlation", F.round("correlation", 6))


@query(PX + " select image_id, list_sort(list(v))[33] as middle, min(v) as worst from px where y = 30 group by image_id")
def a21_middle_and_worst(spark, sf_dir):
    return measures.upper_median(px(spark, sf_dir).where("y = 30"), "v", ["image_id"])


# ---- acts


@query(PX + ", t as (select image_id, 63 - y as x, x as y, r, g, b from px)" + DIGEST.format(RGB, "t"))
def p1_rotate(spark, sf_dir):
    return acts.digest(acts.rotate(px(spark, sf_dir), 90, F.lit(SIDE), F.lit(SIDE)))


@query(PX + ", t as (select image_id, x - 10 as x, y - 7 as y, r, g, b from px where x between 10 and 39 and y between 7 and 50)" + DIGEST.format(RGB, "t"))
def p2_crop(spark, sf_dir):
    return acts.digest(acts.crop(px(spark, sf_dir), 10, 7, 30, 44))


@query(PX + ", t as (select image_id, x, y, ((r * 2126 + g * 7152 + b * 722) // 10000)::bigint as v from px)" + DIGEST.format("v * (x * 31 + y * 17 + 1)", "t"))
def p3_to_grey(spark, sf_dir):
    return acts.digest(acts.to_grey(px(spark, sf_dir)), ("v",))


CALM = """, c as (select *, greatest(sr, sg, sb) as hi, least(sr, sg, sb) as lo from s),
f as (select *, (1::float - least(greatest(((((hi - lo)::float / greatest(hi, 1)::float)::float - 0.2::float) / (0.3::float - 0.2::float))::float, 0::float), 1::float))::float as o,
    ((0.299::float * sr::float + 0.587::float * sg::float)::float + 0.114::float * sb::float)::float as gr from c),
t as (select image_id, x, y, {0} from f)""".format(
    ", ".join(f"case when hi = 0 or o <= 0 then s{c} else least(255, floor((s{c}::float + ((gr - s{c}::float) * o)::float)::double + 0.5)::int) end as {c}" for c in "rgb")
)


@query(
    LEVELS
    + """, w as (select image_id, max(black) filter (where channel = 0) as b0, max(white) filter (where channel = 0) as w0, max(black) filter (where channel = 1) as b1, max(white) filter (where channel = 1) as w1,
    max(black) filter (where channel = 2) as b2, max(white) filter (where channel = 2) as w2 from levels group by image_id),
    s as (select image_id, x, y, """
    + ", ".join(f"least(greatest((((({c}::float - b{k}::float) / (w{k}::float - b{k}::float))::float * 255::float))::float, 0::float), 255::float) as q{c}" for k, c in enumerate("rgb"))
    + " from px join w using (image_id)), s2 as (select image_id, x, y, trunc(qr)::int as sr, trunc(qg)::int as sg, trunc(qb)::int as sb from s)"
    + CALM.replace("from s)", "from s2)")
    + DIGEST.format(RGB, "t")
)
def p4_apply_levels(spark, sf_dir):
    pixels = px(spark, sf_dir)
    return acts.digest(acts.apply_levels(pixels, measures.suggest_levels(pixels)))


@query(ORACLES["p4_apply_levels"])
def p4_levels_over_lines(spark, sf_dir):
    return acts.digest(lines.stretched(packed(spark, sf_dir), measures.suggest_levels(px(spark, sf_dir))))


@query(PX + ", s as (select image_id, x, y, least(255, r + image_id % 40)::int as sr, g::int as sg, b::int as sb from px)" + CALM + DIGEST.format(RGB, "t"))
def p5_calm_faint_colour(spark, sf_dir):
    rows = px(spark, sf_dir).withColumn("r", F.least(F.lit(255), F.col("r") + F.col("image_id") % 40).cast("int"))
    calm = tones.calmed(F.col("r"), F.col("g"), F.col("b"))
    return acts.digest(rows.select("image_id", "x", "y", *[v.alias(k) for k, v in calm.items()]))


@query("""select page_id as image_id, v::int as value, case when lo = hi then case when v > lo then 255 else 0 end
    else trunc(least(greatest((((v::float - lo::float) / (hi::float - lo::float))::float * 255::float)::float, 0::float), 255::float))::int end as stretched
    from (select page_id, page_id % 90 as lo, page_id % 90 + page_id % 7 * 25 as hi from pages), range(256) q(v)""")
def p6_stretch_table(spark, sf_dir):
    lo, hi = (F.col("image_id") % 90).cast("int"), (F.col("image_id") % 90 + F.col("image_id") % 7 * 25).cast("int")
    return ids(spark, sf_dir).select("image_id", F.posexplode(tones.stretch_table(lo, hi)).alias("value", "stretched"))


@query(LEVELS + " select image_id, bool_and(black = 0 and white = 255) as unchanged from levels group by image_id")
def p7_levels_unchanged(spark, sf_dir):
    levels = measures.suggest_levels(px(spark, sf_dir))
    return levels.groupBy("image_id").agg(F.bool_and(tones.unchanged(F.col("black"), F.col("white"))).alias("unchanged"))


#: Sizes and corners that vary with the id.
SHAPE = "select page_id as image_id, (page_id * 37 % 4000 + 300)::int as width, (page_id * 53 % 5000 + 200)::int as height, (case when page_id % 3 = 0 then 0 when page_id % 3 = 1 then 1700 else 2480 end)::int as edge from pages"
QUAD_SQL = """with q as (select page_id as image_id, (10 + page_id % 7)::double as c0, (8 + page_id % 5)::double as c1, (52 - page_id % 6)::double as c2, (9 + page_id % 4)::double as c3,
    (56 - page_id % 3)::double as c4, (55 - page_id % 8)::double as c5, (6 + page_id % 9)::double as c6, (58 - page_id % 5)::double as c7 from pages)"""


def shapes(spark, sf_dir):
    i = F.col("image_id")
    edge = F.when(i % 3 == 0, 0).when(i % 3 == 1, 1700).otherwise(2480)
    return ids(spark, sf_dir).select("image_id", (i * 37 % 4000 + 300).cast("int").alias("width"), (i * 53 % 5000 + 200).cast("int").alias("height"), edge.alias("edge"))


def quads(spark, sf_dir):
    i = F.col("image_id")
    c = [10 + i % 7, 8 + i % 5, 52 - i % 6, 9 + i % 4, 56 - i % 3, 55 - i % 8, 6 + i % 9, 58 - i % 5]
    return ids(spark, sf_dir).select("image_id", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), *[v.cast("double").alias(f"c{k}") for k, v in enumerate(c)])




def corner_columns():
    return [F.col(f"c{k}") for k in range(8)]


@query(f"select image_id, case when edge > 0 and greatest(width, height) <= edge then 'keep' when edge > 0 then 'edge' when greatest(width, height) > 3000 then 'cap' else 'keep' end as choice from ({SHAPE})")
def p10_resize_choice(spark, sf_dir):
    return shapes(spark, sf_dir).select("image_id", geometry.resize_choice(F.col("width"), F.col("height"), F.col("edge")).alias("choice"))


SIZE_SQL = """, z as (select *, floor((sqrt(power(c2 - c0, 2) + power(c3 - c1, 2)) + sqrt(power(c4 - c6, 2) + power(c5 - c7, 2))) / 2 + 0.5)::int as w,
    floor((sqrt(power(c6 - c0, 2) + power(c7 - c1, 2)) + sqrt(power(c4 - c2, 2) + power(c5 - c3, 2))) / 2 + 0.5)::int as h from q)"""
MAP_SQL = """, d as (select *, c2 - c4 as px_, c3 - c5 as py_, c6 - c4 as qx, c7 - c5 as qy, c0 - c2 + c4 - c6 as sx, c1 - c3 + c5 - c7 as sy from z),
m as (select *, case when sx = 0 and sy = 0 then 0 else (sx * qy - qx * sy) / (px_ * qy - qx * py_) end as wa, case when sx = 0 and sy = 0 then 0 else (px_ * sy - sx * py_) / (px_ * qy - qx * py_) end as wb from d)"""


@query(QUAD_SQL + SIZE_SQL + MAP_SQL + """, px as (""" + PX.split("with px as (", 1)[1] + """, g as (
    select image_id, x, y, w, h, (x + 0.5::double) / w as a, (y + 0.5::double) / h as e, m.* exclude (image_id, w, h) from (select *, unnest(range(w))::int as x from (select *, unnest(range(h))::int as y from m)) m
), f as (select image_id, x, y, round(least(greatest(((c2 - c0 + wa * c2) * a + (c6 - c0 + wb * c6) * e + c0) / (wa * a + wb * e + 1), 0), 63), 6) as fx,
    round(least(greatest(((c3 - c1 + wa * c3) * a + (c7 - c1 + wb * c7) * e + c1) / (wa * a + wb * e + 1), 0), 63), 6) as fy from g),
n as (select *, floor(fx)::int as l, floor(fy)::int as u, fx - floor(fx) as s1, fy - floor(fy) as s2 from f),
t as (select n.image_id, n.x, n.y, """ + ", ".join(
    f"floor(round(p.{c} * (1 - s1) * (1 - s2) + q.{c} * s1 * (1 - s2) + i.{c} * (1 - s1) * s2 + j.{c} * s1 * s2, 6) + 0.5)::int as {c}" for c in "rgb"
) + """ from n join px p on p.image_id = n.image_id and p.x = l and p.y = u join px q on q.image_id = n.image_id and q.x = least(l + 1, 63) and q.y = u
    join px i on i.image_id = n.image_id and i.x = l and i.y = least(u + 1, 63) join px j on j.image_id = n.image_id and j.x = least(l + 1, 63) and j.y = least(u + 1, 63))""" + DIGEST.format(RGB, "t"))
def p11_flatten(spark, sf_dir):
    return acts.digest(acts.flatten(px(spark, sf_dir), quads(spark, sf_dir)))


@query(ORACLES["p11_flatten"])
def p11_flatten_over_lines(spark, sf_dir):
    return lines.digest(lines.flattened(packed(spark, sf_dir), quads(spark, sf_dir)))


@query(QUAD_SQL + SIZE_SQL + " select image_id, w as width, h as height from z")
def p12_flat_size(spark, sf_dir):
    w, h = geometry.flat_size(corner_columns())
    return quads(spark, sf_dir).select("image_id", w.alias("width"), h.alias("height"))


@query(QUAD_SQL + SIZE_SQL + MAP_SQL + " select image_id, round(wa, 9) as wa, round(wb, 9) as wb, round(c2 - c0 + wa * c2, 9) as ax, round(c3 - c1 + wa * c3, 9) as ay, round(c6 - c0 + wb * c6, 9) as bx, round(c7 - c1 + wb * c7, 9) as \"by\", c0 as x0, c1 as y0 from m")
def p13_flatten_map(spark, sf_dir):
    return quads(spark, sf_dir).select("image_id", *[F.round(v, 9).alias(k) for k, v in geometry.flatten_map(corner_columns()).items()])


@query(f"""with s as (select *, radians(-(image_id % 21 - 10)::double) as t from ({SHAPE})), f as (
    select *, sin(t) as sn, cos(t) as cs, least(width / (width * abs(cos(t)) + height * abs(sin(t))), height / (height * abs(cos(t)) + width * abs(sin(t)))) as k from s)
    select image_id, """ + ", ".join(
    f"round(width / 2.0::double + ({a} * width / 2.0::double * cs - {d} * height / 2.0::double * sn) * k, 6) as x{n}, round(height / 2.0::double + ({a} * width / 2.0::double * sn + {d} * height / 2.0::double * cs) * k, 6) as y{n}"
    for n, (a, d) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))
) + " from f")
def p15_straighten_corners(spark, sf_dir):
    c = geometry.straighten_corners(F.col("width"), F.col("height"), (F.col("image_id") % 21 - 10).cast("double"))
    return shapes(spark, sf_dir).select("image_id", *[F.round(v, 6).alias(f"{'xy'[k % 2]}{k // 2}") for k, v in enumerate(c)])


@query(PX + " select a.image_id, count(*) as n from px a join px m on m.image_id = a.image_id and m.x = a.x // 2 * 2 and m.y = a.y // 2 * 2 and m.sheet where a.v > 100 group by a.image_id")
def p16_on_paper(spark, sf_dir):
    """Pixels on a mask of half the size."""
    small = mask(spark, sf_dir).where("x % 2 = 0 and y % 2 = 0").select("image_id", F.expr("x div 2").cast("int").alias("mx"), F.expr("y div 2").cast("int").alias("my"))
    full, half = (F.lit(SIDE), F.lit(SIDE)), (F.lit(SIDE // 2), F.lit(SIDE // 2))
    at = px(spark, sf_dir).where("v > 100").withColumns(dict(zip(("mx", "my"), geometry.mask_place(F.col("x"), F.col("y"), full, half), strict=True)))
    return merged(at, small, ["image_id", "mx", "my"], "left_semi").groupBy("image_id").agg(F.count("*").alias("n"))


@query(PX + """, m as (select * from px where sheet and x + y > 20 + image_id % 13)
    select image_id, """ + ", ".join(f"arg_min({c}, ({k}) * 100000 + y * 100 + x) as {n}_{c}" for n, k in (("tl", "x + y"), ("tr", "y - x"), ("br", "-x - y"), ("bl", "x - y")) for c in "xy") + " from m group by image_id")
def p17_extreme_corners(spark, sf_dir):
    cut = px(spark, sf_dir).where("sheet and x + y > 20 + image_id % 13").select("image_id", "x", "y")
    return sheet.extreme_corners(cut)


@query(PX + " select image_id, bool_or(x = 0 or y = 0 or x = 63 or y = 63) as runs_off from px where sheet or (image_id % 4 = 0 and y > 40) group by image_id")
def p18_runs_off(spark, sf_dir):
    m = px(spark, sf_dir).where("sheet or (image_id % 4 = 0 and y > 40)").select("image_id", "x", "y")
    return sheet.runs_off(m, sizes(spark, sf_dir))


@query(PX + """, b as (select image_id, min(x) as l, min(y) as t, max(x) as r, max(y) as w, count(*) as area from px where sheet or image_id % 6 = 0 group by image_id)
    select image_id, l = 0 and t = 0 and r = 63 and w = 63 as whole, area >= 4096 * 0.15 and r - l + 1 >= 16 and w - t + 1 >= 16 as believable from b""")
def p19_p20_whole_and_believable(spark, sf_dir):
    b = sheet.bounds(px(spark, sf_dir).where("sheet or image_id % 6 = 0").select("image_id", "x", "y"))
    whole = (F.col("left") == 0) & (F.col("top") == 0) & (F.col("right") == SIDE - 1) & (F.col("bottom") == SIDE - 1)
    good = geometry.believable(F.col("area"), F.col("right") - F.col("left") + 1, F.col("bottom") - F.col("top") + 1, F.lit(SIDE), F.lit(SIDE))
    return b.select("image_id", whole.alias("whole"), good.alias("believable"))


@query(f"""with s as (select *, (image_id % 30)::int as bx, (image_id % 40)::int as b_y, (image_id % 50 + 10)::int as bw, (image_id % 45 + 9)::int as bh from ({SHAPE})), f as (
    select *, least(floor(bx * (width::double / 400)), width - 1)::int as x, least(floor(b_y * (height::double / 300)), height - 1)::int as y from s)
    select image_id, x, y, least(ceil(bw * (width::double / 400)), width - x)::int as w, least(ceil(bh * (height::double / 300)), height - y)::int as h from f""")
def p21_scaled_box(spark, sf_dir):
    i = F.col("image_id")
    box = geometry.scaled_box(i % 30, i % 40, i % 50 + 10, i % 45 + 9, (F.lit(400), F.lit(300)), (F.col("width"), F.col("height")))
    return shapes(spark, sf_dir).select("image_id", *[v.alias(k) for k, v in box.items()])


@query(f"""select image_id, least(floor((image_id % 11) / 10.0::double * width + 0.5), width)::int as x,
    least(floor((image_id % 7) / 5.0::double * width + 0.5), width - least(floor((image_id % 11) / 10.0::double * width + 0.5), width))::int as w from ({SHAPE})""")
def p23_crop_range(spark, sf_dir):
    i = F.col("image_id")
    x, w = geometry.crop_range((i % 11) / 10.0, (i % 7) / 5.0, F.col("width"))
    return shapes(spark, sf_dir).select("image_id", x.alias("x"), w.cast("int").alias("w"))


@query("select page_id as image_id, " + ", ".join(f"(page_id * {k + 1})::double as {'xy'[k % 2]}{k // 2}" for k in range(8)) + " from pages")
def p24_corner_points(spark, sf_dir):
    flat = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: (k * F.col("image_id")).cast("double"))
    points = ids(spark, sf_dir).select("image_id", flat.alias("flat")).select("image_id", geometry.corner_points(F.col("flat")).alias("p"))
    return points.select("image_id", *[F.get("p", F.lit(k))[c].alias(f"{c}{k}") for k in range(4) for c in "xy"])


@query("""select image_id, case when q not between 1 and 100 then 'quality' when e < 0 or e > 3000 then 'range' when e > 0 and e < 600 then 'small' end as wrong
    from (select page_id as image_id, page_id % 120 - 5 as q, page_id * 31 % 4000 - 300 as e from pages)""")
def p25_rung_error(spark, sf_dir):
    i = F.col("image_id")
    text = geometry.rung_error(i % 120 - 5, i * 31 % 4000 - 300)
    kind = F.when(text.startswith("quality"), "quality").when(text.contains("from 0 to"), "range").when(text.contains("at least"), "small")
    return ids(spark, sf_dir).select("image_id", kind.alias("wrong"))


COMPOSED = """with s as (select page_id as image_id, (page_id % 5) / 10.0::double as x, (page_id % 4) / 10.0::double as y, case when page_id % 9 = 0 then 0 else 0.4::double end as w, 0.3::double as h, (page_id % 4 - page_id % 3 + 4) % 4 as k,
    0.25::double as nx, 0.5::double as ny, case when page_id % 2 = 0 then 0.5::double else 0 end as nw, 0.2::double as nh from pages),
t as (select *, case k when 0 then x when 1 then 1 - y - h when 2 then 1 - x - w else y end as tx, case k when 0 then y when 1 then x when 2 then 1 - y - h else 1 - x - w end as ty,
    case k % 2 when 0 then w else h end as tw, case k % 2 when 0 then h else w end as th from s)
select image_id, """ + ", ".join(
    f"round(case when w > 0 and nw > 0 then {nested} when nw > 0 then {new} when w > 0 then {old} else 0 end, 9) as {name}"
    for name, nested, new, old in (("crop_x", "tx + nx * tw", "nx", "tx"), ("crop_y", "ty + ny * th", "ny", "ty"), ("crop_w", "nw * tw", "nw", "tw"), ("crop_h", "nh * th", "nh", "th"))
) + " from t"


@query(COMPOSED)
def p26_composed_crop(spark, sf_dir):
    i = F.col("image_id")
    old = [(i % 5) / 10.0, (i % 4) / 10.0, F.when(i % 9 == 0, 0.0).otherwise(0.4), F.lit(0.3)]
    new = [F.lit(0.25), F.lit(0.5), F.when(i % 2 == 0, 0.5).otherwise(0.0), F.lit(0.2)]
    out = geometry.composed_crop(old, i % 4 - i % 3, new)
    return ids(spark, sf_dir).select("image_id", *[F.round(c, 9).alias(f"crop_{n}") for n, c in zip("xywh", out, strict=True)])


@query("select page_id as image_id, round((page_id % 200 + page_id % 90 + page_id % 40) / 3.0::double / 255 * 100, 6) as percent, " + ", ".join(f"least(page_id % {n} + 13, 254)::int as moved{k}" for k, n in enumerate((200, 90, 250))) + " from pages")
def p27_percent_and_moved(spark, sf_dir):
    i = F.col("image_id")
    moved = tones.moved(F.array(i % 200, i % 90, i % 250), F.lit(5.0), 0, 254)
    return ids(spark, sf_dir).select("image_id", F.round(tones.percent(F.array(i % 200, i % 90, i % 40)), 6).alias("percent"), moved.alias("m")).select("image_id", "percent", *[F.get("m", F.lit(k)).alias(f"moved{k}") for k in range(3)])


@query("""select page_id as image_id, round(list_min(a), 6) as x, round(list_min(b), 6) as y, round(list_max(a) - list_min(a), 6) as w, round(list_max(b) - list_min(b), 6) as h from (
    select page_id, [least(greatest((page_id * k % 170 - 30) / 100.0::double, 0), 1) for k in [1, 2, 3, 5]] as a, [least(greatest((page_id * k % 90 - 10) / 60.0::double, 0), 1) for k in [1, 2, 3, 5]] as b from pages)""")
def p28_box_of_corners(spark, sf_dir):
    at = lambda size, less: F.transform(F.array(*[F.lit(k) for k in (1, 2, 3, 5)]), lambda k: F.col("image_id") * k % size - less)
    box = geometry.box_of_corners(F.col("xs"), F.col("ys"), F.lit(100.0), F.lit(60.0))
    rows = ids(spark, sf_dir).select("image_id", at(170, 30).alias("xs"), at(90, 10).alias("ys"))
    return rows.select("image_id", *[F.round(v, 6).alias(k) for k, v in box.items()])


# ---- the sheet


def marked(spark, sf_dir):
    return px(spark, sf_dir).select("image_id", "x", "y", "v", F.col("sheet").alias("inside"), (~F.col("sheet")).alias("outside"))


def side_points(spark, sf_dir):
    pixels = marked(spark, sf_dir)
    # tables end early in such small pictures: six pixels of table are all there is
    return sheet.edge_points(widened(pixels), measures.paper_and_table(px(spark, sf_dir), F.col("sheet")), sheet.bounds(widened(pixels).where("inside")))


def widened(pixels: DataFrame) -> DataFrame:
    """The pictures with a margin of twelve more pixels of table all round, so that rays have room."""
    moved = pixels.withColumns({"x": F.col("x") + 12, "y": F.col("y") + 12})
    n = SIDE + 24
    grid = pixels.select("image_id").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    edge = grid.where(f"x < 12 or y < 12 or x >= {n - 12} or y >= {n - 12}")
    return moved.unionByName(edge.select("image_id", "x", "y", (20 + F.col("image_id") % 9).cast("int").alias("v"), F.lit(False).alias("inside"), F.lit(True).alias("outside")))


@query("""with s as (select page_id as image_id, 8 + page_id % 5 + 12 as l, 55 - page_id % 3 + 12 as r, 6 + page_id % 7 + 12 as t, 57 - page_id % 4 + 12 as b from pages)
    select image_id, 'left' as side, y::int as "along", l - 0.5::double as across from s, range(88) q(y) where y between t + (b - t + 1) // 6 and b - (b - t + 1) // 6
    union all select image_id, 'right', y::int, r + 0.5::double from s, range(88) q(y) where y between t + (b - t + 1) // 6 and b - (b - t + 1) // 6
    union all select image_id, 'top', x::int, t - 0.5::double from s, range(88) q(x) where x between l + (r - l + 1) // 6 and r - (r - l + 1) // 6
    union all select image_id, 'bottom', x::int, b + 0.5::double from s, range(88) q(x) where x between l + (r - l + 1) // 6 and r - (r - l + 1) // 6""")
def g3_g5_edge_points(spark, sf_dir):
    return side_points(spark, sf_dir)


@query(PX + ", k as (select image_id, y, x, row_number() over (partition by image_id, y order by x) - 1 as i, count(*) over (partition by image_id, y) as n from px where sheet) select image_id, y, x as start from k where i = n // 2")
def g4_middle_of_lines(spark, sf_dir):
    return sheet.middle_of_lines(marked(spark, sf_dir), "y", "x")


#: Readings along slanted sides, with a stray one now and then.
POINTS = """with pt as (select page_id as image_id, 'left' as side, y::double as "along", (page_id % 5) / 50.0::double * y + page_id % 9 + y * y % 3 / 4.0::double + case when y % 11 = 3 then 40 else 0 end as across from pages, range(48) q(y))"""


def slanted(spark, sf_dir):
    i, y = F.col("image_id"), F.col("along")
    across = (i % 5) / 50.0 * y + i % 9 + (y * y % 3) / 4.0 + F.when(y % 11 == 3, 40).otherwise(0)
    rows = ids(spark, sf_dir).select("image_id", F.lit("left").alias("side"), F.explode(F.sequence(F.lit(0), F.lit(47))).alias("along"))
    return rows.withColumn("along", y.cast("double")).withColumn("across", across.cast("double"))


@query(POINTS + """, sl as (select a.image_id, list_sort(list((b.across - a.across) / (b."along" - a."along"))) as l from pt a join pt b on a.image_id = b.image_id and b."along" - a."along" >= 20 group by 1),
    s0 as (select image_id, l[len(l) // 2 + 1] as s from sl), o as (select pt.image_id, list_sort(list(across - s * "along")) as l from pt join s0 using (image_id) group by 1),
    o0 as (select image_id, l[len(l) // 2 + 1] as o from o), k as (select pt.* from pt join s0 using (image_id) join o0 using (image_id) where abs(across - (s * "along" + o)) <= 12)
    select image_id, any_value(side) as side, round(regr_slope(across, "along"), 6) as slope, round(regr_intercept(across, "along"), 6) as "offset" from k group by image_id having count(*) * 2 >= 48""")
def g6_fit_sides(spark, sf_dir):
    return sheet.fit_sides(slanted(spark, sf_dir)).withColumns({"slope": F.round("slope", 6), "offset": F.round("offset", 6)})


@query(POINTS + """ select image_id, round(regr_slope(across, "along"), 6) as slope, round(regr_intercept(across, "along"), 6) as "offset" from pt group by image_id""")
def g7_straight_through(spark, sf_dir):
    return slanted(spark, sf_dir).groupBy("image_id").agg(F.round(F.regr_slope("across", "along"), 6).alias("slope"), F.round(F.regr_intercept("across", "along"), 6).alias("offset"))


READ = """with rd as (select page_id as image_id, 'left' as side, k / 30.0::double as part, (page_id % 9 - 4) * k / 30.0::double + (k * k * 7 + page_id) % 5 as miss from pages, range(1, 30) q(k))"""


def readings(spark, sf_dir):
    i, k = F.col("image_id"), F.col("k")
    rows = ids(spark, sf_dir).select("image_id", F.lit("left").alias("side"), F.explode(F.sequence(F.lit(1), F.lit(29))).alias("k"))
    return rows.select("image_id", "side", (k / 30.0).alias("part"), ((i % 9 - 4) * k / 30.0 + (k * k * 7 + i) % 5).alias("miss"))


@query(READ + """, t as (select image_id, side, l::int as lean, list_sort(list(miss - l * part)) as m from rd, range(-12, 13) q(l) group by all),
    b as (select *, row_number() over (partition by image_id order by round(m[len(m) // 2 + 1] - m[1], 6), abs(lean), -lean) as k from t) select image_id, side, lean from b where k = 1""")
def g10_leans(spark, sf_dir):
    return sheet.leans(readings(spark, sf_dir))


@query(READ + " select image_id, any_value(side) as side, round(greatest(min(miss), list_sort(list(miss))[count(*) // 2 + 1] - 60), 6) as place from rd group by image_id")
def g11_places(spark, sf_dir):
    return sheet.places(readings(spark, sf_dir)).withColumn("place", F.round("place", 6))


#: Four lines round the sheet, a little aslant.
LINES = """with ln as (select page_id as image_id, (page_id % 3 - 1) / 100.0::double as ls, 8 + page_id % 5 - 0.5::double as lo, (page_id % 4 - 1) / 100.0::double as rs, 55 - page_id % 3 + 0.5::double as ro,
    (page_id % 5 - 2) / 100.0::double as ts, 6 + page_id % 7 - 0.5::double as "to", 0.0::double as bs, 57 - page_id % 4 + 0.5::double as bo from pages)"""


def four_lines(spark, sf_dir):
    i = F.col("image_id")
    values = {
        "left": ((i % 3 - 1) / 100.0, 8 + i % 5 - 0.5),
        "right": ((i % 4 - 1) / 100.0, 55 - i % 3 + 0.5),
        "top": ((i % 5 - 2) / 100.0, 6 + i % 7 - 0.5),
        "bottom": (F.lit(0.0), 57 - i % 4 + 0.5),
    }
    parts = F.array(*[F.struct(F.lit(s).alias("side"), a.cast("double").alias("slope"), b.cast("double").alias("offset")) for s, (a, b) in values.items()])
    return ids(spark, sf_dir).select("image_id", F.explode(parts).alias("l")).select("image_id", "l.*")


CROSS = ", ".join(f"round(({v}s * {h}o + {v}o) / (1 - {v}s * {h}s), 6) as c{2 * k}, round({h}s * (({v}s * {h}o + {v}o) / (1 - {v}s * {h}s)) + {h}o, 6) as c{2 * k + 1}" for k, (v, h) in enumerate((("l", "t"), ("r", "t"), ("r", "b"), ("l", "b")))).replace("to ", '"to" ').replace("to)", '"to")').replace("to,", '"to",')


@query(LINES + " select image_id, " + CROSS + " from ln")
def g14_crossings(spark, sf_dir):
    return sheet.quadrilaterals(four_lines(spark, sf_dir)).select("image_id", *[F.round(f"c{k}", 6).alias(f"c{k}") for k in range(8)])


@query(PX + ", " + LINES[5:] + """ select image_id, count(*) filter (where sheet) as rough_area, count(*) filter (where q) as quad_area, count(*) filter (where q and sheet) as shared_area
    from (select px.*, x >= ls * y + lo and x <= rs * y + ro and y >= ts * x + "to" and y <= bs * x + bo as q from px join ln using (image_id)) group by image_id""")
def g12_quad_shares(spark, sf_dir):
    return sheet.quad_shares(marked(spark, sf_dir), sheet.quadrilaterals(four_lines(spark, sf_dir)))


@query()
def g13_carried_on(spark, sf_dir):
    return sheet.carried_on(marked(spark, sf_dir), sheet.quadrilaterals(four_lines(spark, sf_dir)))


@query("""select page_id as image_id, page_id % 4 <> 0 as convex from pages""")
def g15_convex(spark, sf_dir):
    flip = F.col("image_id") % 4 == 0
    c = [F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(1.0), F.when(flip, 2.0).otherwise(9.0), F.when(flip, 2.0).otherwise(8.0), F.lit(1.0), F.lit(9.0)]
    return ids(spark, sf_dir).select("image_id", geometry.convex(c).alias("convex"))


# ---- areas as runs, and packed lines


#: The images with sheen on the table and, in some, a bright lobe that leans on the sheet; and runs of what a condition tells.
LIT = PX + """, lit as (select image_id, x, y, sheet, (case when x between 1 and 3 and y between 2 and 2 + image_id % 9 then 210
    when image_id % 7 = 3 and x between 60 - image_id % 3 - 4 and 61 and y between 20 and 24 then 205 else v end)::int as v from px)"""
RUN_SQL = """, {0} as (select image_id, y, min(x) as x0, max(x) as x1 from (select image_id, y, x, x - row_number() over (partition by image_id, y order by x) as g from {1} where {2}) group by image_id, y, g)"""
DARK, EDGE = "v <= 100", "(x = 0 or y = 0 or x = 63 or y = 63)"
FLOOD = LIT.replace("with px", "with recursive px") + f""", seen as (select image_id, x, y from lit where {DARK} and {EDGE}
    union select l.image_id, l.x, l.y from seen s, (values (0, 1), (0, -1), (1, 0), (-1, 0)) d(dx, dy), lit l where l.image_id = s.image_id and l.x = s.x + dx and l.y = s.y + dy and l.v <= 100)"""


def lit_lines(spark, sf_dir):
    i, y = F.col("image_id"), F.col("y")
    spot = lambda x: x.between(1, 3) & y.between(2, 2 + i % 9)
    lobe = lambda x: (i % 7 == 3) & x.between(60 - i % 3 - 4, 61) & y.between(20, 24)
    v = F.transform("v", lambda v, x: F.when(spot(x), 210).when(lobe(x), 205).otherwise(v))
    return packed(spark, sf_dir).select("image_id", "y", v.alias("v"))


def rough(spark, sf_dir):
    dark = runs.runs_of_lines(lit_lines(spark, sf_dir), lambda v: v <= 100)
    return runs.rough_area(dark, sizes(spark, sf_dir))


@query(FLOOD + " select image_id, count(*) as n_pixels, sum(x * 31 + y * 17 + 1)::bigint as weighed from seen group by image_id")
def g1_border_flood(spark, sf_dir):
    dark = runs.runs_of_lines(lit_lines(spark, sf_dir), lambda v: v <= 100)
    found = runs.reaching_the_border(dark, sizes(spark, sf_dir)).withColumn("n", F.col("x1") - F.col("x0") + 1)
    weighed = (F.col("x0") + F.col("x1")) * F.col("n") / 2 * 31 + F.col("n") * (F.col("y") * 17 + 1)
    return found.groupBy("image_id").agg(F.sum("n").alias("n_pixels"), F.sum(weighed).cast("long").alias("weighed"))


@query(FLOOD + """, ins as (select image_id, x, y from lit l where not exists (select 1 from seen s where s.image_id = l.image_id and s.x = l.x and s.y = l.y))"""
    + RUN_SQL.format("rs", "ins", "true") + """, nodes as (select *, y * 64 + x0 as node from rs), links as (
    select a.image_id, a.node as u, b.node as v from nodes a join nodes b on a.image_id = b.image_id and abs(a.y - b.y) = 1 and a.x0 <= b.x1 and b.x0 <= a.x1
), reach as (select image_id, node as u, node as v from nodes union select r.image_id, r.u, l.v from reach r join links l on l.image_id = r.image_id and l.u = r.v),
areas as (select n.*, r.label from nodes n join (select image_id, u, min(v) as label from reach group by image_id, u) r on r.image_id = n.image_id and r.u = n.node),
best as (select image_id, label, sum(x1 - x0 + 1) as area, row_number() over (partition by image_id order by sum(x1 - x0 + 1) desc, label) as k from areas group by image_id, label)
select a.image_id, any_value(area)::bigint as area, min(x0) as "left", min(y) as top, max(x1) as "right", max(y) as bottom, count(*) as n_runs, sum(x0 * 31 + y * 17 + x1 * 7)::bigint as weighed
from areas a join best b on a.image_id = b.image_id and a.label = b.label and k = 1 group by a.image_id""")
def g1_a12_largest_area(spark, sf_dir):
    """The sheet with its writing, whatever else on the table is bright."""
    found = rough(spark, sf_dir)
    return found.groupBy("image_id").agg(
        F.first("area").alias("area"), *[F.first(c).alias(c) for c in ("left", "top", "right", "bottom")], F.count("*").alias("n_runs"), F.sum(F.col("x0") * 31 + F.col("y") * 17 + F.col("x1") * 7).alias("weighed")
    )


#: Four lines round the sheet, some of them wrong.
TRIED = LINES.replace("with ln", "with l0") + """, ln as (select image_id, case when image_id % 13 = 5 then 0.9 else ls end as ls, lo + case when image_id % 7 = 1 then 9 when image_id % 11 = 4 then 4 else 0 end as lo,
    rs, ro + case when image_id % 9 = 2 then 7 else 0 end as ro, ts, "to" - case when image_id % 10 = 6 then 20 else 0 end as "to", bs, bo + case when image_id % 9 = 2 then 5 when image_id % 8 = 3 then -25 when image_id % 12 = 7 then -46 else 0 end as bo from l0)"""
CORNERED = ", cn as (select *, " + CROSS + " from ln)"
PAST_SQL = ", past as (" + " union all ".join(
    f"""select image_id, '{side}' as side, count(*) filter (where n = 7) / greatest(1, max(b - a + 1))::double as share from (
    select c.image_id, a, b, pos, count(p.x) as n from (select *, unnest(generate_series(a, b))::int as pos from (
    select image_id, {s}s as s, {s}o as o, trunc(least({a}, {b}))::int as a, trunc(greatest({a}, {b}))::int as b from cn)) c
    cross join range(4, 11) k(away) left join inside p on p.image_id = c.image_id and p.{along} = pos and p.{across} = floor(c.s * pos + c.o + {out} * k.away)::int group by all) group by image_id"""
    for side, s, along, across, out, a, b in (("left", '"l', "y", "x", -1, "c1", "c7"), ("right", '"r', "y", "x", 1, "c3", "c5"), ("top", '"t', "x", "y", -1, "c0", "c2"), ("bottom", '"b', "x", "y", 1, "c6", "c4"))
).replace('"ls', "ls").replace('"lo', "lo").replace('"rs', "rs").replace('"ro', "ro").replace('"ts', "ts").replace('"to', '"to"').replace('"bs', "bs").replace('"bo', "bo") + ")"


ORACLES["g13_carried_on"] = PX + ", " + LINES[5:] + CORNERED + ", inside as (select image_id, x, y from px where sheet)" + PAST_SQL + " select * from past"


def tried_quads(spark, sf_dir):
    i, s, o = F.col("image_id"), F.col("slope"), F.col("offset")
    of = lambda side: F.col("side") == side
    wrong = F.when(of("left"), F.when(i % 7 == 1, 9).when(i % 11 == 4, 4).otherwise(0)).when(of("right"), F.when(i % 9 == 2, 7).otherwise(0)).when(of("top"), F.when(i % 10 == 6, -20).otherwise(0))
    wrong = wrong.otherwise(F.when(i % 9 == 2, 5).when(i % 8 == 3, -25).when(i % 12 == 7, -46).otherwise(0))
    sides = four_lines(spark, sf_dir).select("image_id", "side", F.when(of("left") & (i % 13 == 5), 0.9).otherwise(s).alias("slope"), (o + wrong).alias("offset"))
    return sheet.quadrilaterals(sides)


@query(PX + ", " + TRIED[5:] + CORNERED + ", inside as (select image_id, x, y from px where sheet)" + PAST_SQL + " select image_id, side, round(share, 9) as share from past")
def g13_carried_on_over_runs(spark, sf_dir):
    found = runs.carried_on(runs.runs_of_pixels(mask(spark, sf_dir)), tried_quads(spark, sf_dir))
    return found.withColumn("share", F.round("share", 9))


@query(PX + ", " + TRIED[5:] + CORNERED + ", inside as (select image_id, x, y from px where sheet)" + PAST_SQL + """, worst as (select image_id, max(share) as past from past group by image_id), m as (
    select image_id, count(*) filter (where q) as quad_area, count(*) filter (where sheet) as rough_area, count(*) filter (where q and sheet) as shared_area,
        min(x) filter (where q and sheet) as "left", min(y) filter (where q and sheet) as top, max(x) filter (where q and sheet) as "right", max(y) filter (where q and sheet) as bottom
    from (select px.*, x >= ls * y + lo and x <= rs * y + ro and y >= ts * x + "to" and y <= bs * x + bo as q from px join ln using (image_id)) group by image_id
), t as (select *, """ + ", ".join(f"(c{2 * b % 8} - c{2 * a}) * (c{(2 * c + 1) % 8} - c{(2 * b + 1) % 8}) - (c{(2 * b + 1) % 8} - c{2 * a + 1}) * (c{2 * c % 8} - c{2 * b % 8}) as t{a}" for a, b, c in ((0, 1, 2), (1, 2, 3), (2, 3, 0), (3, 0, 1))) + """ from cn)
select image_id, case when least(c0, c1, c2, c3, c4, c5, c6, c7) < 0 or greatest(c0, c1, c2, c3, c4, c5, c6, c7) > 63 then 'outside'
    when not (least(t0, t1, t2, t3) > 0 or greatest(t0, t1, t2, t3) < 0) then 'bent' when past > 0.3 then 'carries on' when shared_area = 0 then 'apart'
    when shared_area < quad_area * 0.85::double then 'reaches out' when shared_area < rough_area * 0.9::double then 'leaves out'
    when shared_area < 4096 * 0.15 or "right" - "left" + 1 < 16 or bottom - top + 1 < 16 then 'small' end as reason, quad_area, rough_area, shared_area, "left", top, "right", bottom
from t join m using (image_id) join worst using (image_id)""")
def g12_accepted_sheets(spark, sf_dir):
    return runs.accepted(tried_quads(spark, sf_dir), runs.runs_of_pixels(mask(spark, sf_dir)), sizes(spark, sf_dir))


FEET_SQL = ", feet as (" + " union all ".join(
    f"""select image_id, '{side}' as side, k, k / 30.0::double as part, {x} as fx, {y} as fy, {dx} as dx, {dy} as dy from (
    select image_id, k, {b} + ({e} - {b}) * (k / 30.0::double) as pos, {s} * ({b} + ({e} - {b}) * (k / 30.0::double)) + {o} as across from cn, range(1, 30) q(k))"""
    for side, s, o, b, e, x, y, dx, dy in (
        ("left", "ls", "lo", "c1", "c7", "across + 0.5", "pos + 0.5", -1, 0), ("right", "rs", "ro", "c3", "c5", "across + 0.5", "pos + 0.5", 1, 0),
        ("top", "ts", '"to"', "c0", "c2", "pos + 0.5", "across + 0.5", 0, -1), ("bottom", "bs", "bo", "c6", "c4", "pos + 0.5", "across + 0.5", 0, 1),
    )
) + """), asked as (select feet.*, o, fx + dx * o as x, fy + dy * o as y from feet, range(-64, 65) q(o)),
tone as (select a.image_id, a.side, a.k, a.part, a.o, round(0.299::double * p.r + 0.587::double * p.g + 0.114::double * p.b, 6) as tone
    from (select *, floor(x)::int as ax, floor(y)::int as ay from asked) a left join px p on p.image_id = a.image_id and p.x = a.ax and p.y = a.ay),
means as (select *, (tone + lead(tone) over w + lead(tone, 2) over w) / 3 as mean from tone window w as (partition by image_id, side, k order by o)),
falls as (select *, round(coalesce(mean - lead(mean, 6) over (partition by image_id, side, k order by o), 0), 6) as fall from means),
best as (select *, row_number() over (partition by image_id, side, k order by fall desc, o) as i from falls where o between -64 and 56),
found as (select b.image_id, side, part, (o + 4)::double as miss from best b join lv using (image_id) where i = 1 and fall > 0 and fall >= step)"""


def photo_sizes(spark, sf_dir):
    return sizes(spark, sf_dir).withColumns({"small_width": F.col("width"), "small_height": F.col("height")})


def steps(spark, sf_dir):
    return measures.paper_and_table(px(spark, sf_dir), F.col("sheet")).select("image_id", "step")


@query(MIDDLES + ", " + LINES[5:] + ", cn as (select *, " + CROSS + " from ln)" + FEET_SQL + " select image_id, side, round(part, 6) as part, miss from found")
def g9_edges_across_sides(spark, sf_dir):
    """Where the photo has the sides, place by place."""
    feet = sheet.feet(sheet.quadrilaterals(four_lines(spark, sf_dir)), photo_sizes(spark, sf_dir))
    return sheet.readings_in_photo(feet, packed(spark, sf_dir), steps(spark, sf_dir)).withColumn("part", F.round("part", 6))


@query(MIDDLES + ", " + LINES[5:] + ", cn as (select *, " + CROSS + " from ln)" + FEET_SQL + """, enough as (select * from found where (image_id, side) in (select (image_id, side) from found group by image_id, side having count(*) >= 5)),
    tried as (select image_id, side, l::int as lean, list_sort(list(miss - l * part)) as m from enough, range(-12, 13) q(l) group by all),
    leans as (select *, row_number() over (partition by image_id, side order by round(m[len(m) // 2 + 1] - m[1], 6), abs(lean), -lean) as i from tried),
    placed as (select image_id, side, lean, greatest(m[1], m[len(m) // 2 + 1] - 60) - 1.5::double as place from leans where i = 1),
    given as (""" + " union all ".join(f"""select image_id, '{side}' as side, {s} as slope, {o} as "offset", {out} as outward, {b} as b, {e} as e from cn""" for side, s, o, out, b, e in (("left", "ls", "lo", -1, "c1", "c7"), ("right", "rs", "ro", 1, "c3", "c5"), ("top", "ts", '"to"', -1, "c0", "c2"), ("bottom", "bs", "bo", 1, "c6", "c4"))) + """)
    select g.image_id, g.side, round(case when p.place is null then slope else slope + outward * (lean / (e - b)) end, 6) as slope,
        round(case when p.place is null then "offset" - outward * 0.5 else "offset" + outward * (place - lean / (e - b) * b) end, 6) as "offset" from given g left join placed p on g.image_id = p.image_id and g.side = p.side""")
def g8_sides_read_again(spark, sf_dir):
    again = sheet.sides_read_again(sheet.quadrilaterals(four_lines(spark, sf_dir)), packed(spark, sf_dir), photo_sizes(spark, sf_dir), steps(spark, sf_dir))
    return again.withColumns({"slope": F.round("slope", 6), "offset": F.round("offset", 6)})


def framed(spark, sf_dir):
    """The images with twelve more pixels of table all round, as lines."""
    tone = (20 + F.col("image_id") % 9).cast("int")
    edge = F.array_repeat(tone, F.lit(12))
    rows = packed(spark, sf_dir).select("image_id", (F.col("y") + 12).alias("y"), *[F.concat(edge, F.col(c), edge).alias(c) for c in "rgb"])
    n = SIDE + 24
    table = ids(spark, sf_dir).withColumn("y", F.explode(F.concat(F.sequence(F.lit(0), F.lit(11)), F.sequence(F.lit(n - 12), F.lit(n - 1)))))
    return rows.unionByName(table.select("image_id", "y", *[F.array_repeat(tone, F.lit(n)).alias(c) for c in "rgb"]))


@query()
def g2_sheets_over_lines(spark, sf_dir):
    """The search as a whole, over relations: corners of each image's sheet."""
    found = pages.find_sheets(framed(spark, sf_dir))
    return found.select("image_id", "fitted", "runs_off", *[F.round(f"c{k}", 3).alias(f"c{k}") for k in range(8)])


BELL = ", k as (select unnest(range(-2, 3))::int as d, unnest([" + ", ".join(map(str, lines.gaussian(1.0))) + "])::bigint as w)"
SOFT = BELL + """, h as (select a.image_id, a.x, a.y, """ + ", ".join(f"sum(w * p.{c}) as {c}" for c in "rgb") + """ from px a, k join px p on p.image_id = a.image_id and p.y = a.y and p.x = least(greatest(a.x + d, 0), 63) group by all),
soft as (select a.image_id, a.x, a.y, """ + ", ".join(f"sum(w * p.{c}) as {c}" for c in "rgb") + " from h a, k join h p on p.image_id = a.image_id and p.x = a.x and p.y = least(greatest(a.y + d, 0), 63) group by all)"


@query(PX + SOFT + ", t as (select image_id, x, y, " + ", ".join(f"least(greatest(2 * px.{c} - floor((2 * soft.{c} + n) / (2.0::double * n)), 0), 255)::int as {c}" for c in "rgb") + " from px join soft using (image_id, x, y), (select sum(w) ** 2 as n from k))" + DIGEST.format(RGB, "t"))
def p8_sharpened_lines(spark, sf_dir):
    return lines.digest(lines.sharpened(packed(spark, sf_dir), 1.0))


#: Widths and heights that pictures are made: by the longest edge, and an odd size of its own.
RESIZED = PX + """, sz as (select page_id as image_id, 16 + page_id % 9 as tw, 24 as th from pages), wx as (
    select distinct tw, t::int as t, s::int as s, {0} as w from (select tw, tw as m, 64 as n, unnest(range(tw)) as t from (select distinct tw from sz)), range(64) q(s)),
wy as (select t::int as t, s::int as s, {0} as w from (select 24 as m, 64 as n, unnest(range(24)) as t), range(64) q(s)),
a as (select px.image_id, wx.t as x, px.y, """.replace("{0}", "{kind}") + ", ".join(f"sum(wx.w * {c}) as {c}" for c in "rgb") + """, sum(wx.w) as n from px join sz using (image_id) join wx on wx.tw = sz.tw and wx.s = px.x and wx.w > 0 group by all),
b as (select a.image_id, a.x, wy.t as y, """ + ", ".join(f"sum(wy.w * {c}) as {c}" for c in "rgb") + """, sum(wy.w * n) as n from a join wy on wy.s = a.y and wy.w > 0 group by all),
t as (select image_id, x, y, """ + ", ".join(f"floor((2 * {c} + n) / (2 * n)::double)::int as {c}" for c in "rgb") + " from b)" + DIGEST.format(RGB, "t")
BOX = "greatest(0, least((t + 1) * n, (s + 1) * m) - greatest(t * n, s * m))"
TRIANGLE = "greatest(0, 2 * greatest(n, m) - abs((2 * s + 1) * m - (2 * t + 1) * n))"


def smaller(spark, sf_dir, kind):
    to = sizes(spark, sf_dir).withColumns({"to_width": (16 + F.col("image_id") % 9).cast("int"), "to_height": F.lit(24)})
    return lines.digest(lines.resized(packed(spark, sf_dir), to, kind))


@query(RESIZED.replace("{kind}", BOX))
def p10_resized_by_boxes(spark, sf_dir):
    return smaller(spark, sf_dir, "box")


@query(RESIZED.replace("{kind}", TRIANGLE))
def p22_resized_by_triangles(spark, sf_dir):
    return smaller(spark, sf_dir, "triangle")


@query(f"""select image_id, width, height, case when greatest(width, height) <= 1600 then width else greatest(1, floor(width * 1600.0::double / greatest(width, height) + 0.5))::int end as preview_w,
    case when greatest(width, height) <= 1600 then height else greatest(1, floor(height * 1600.0::double / greatest(width, height) + 0.5))::int end as preview_h,
    case when width > 400 then 400 else width end as small_w, case when width > 400 then greatest(1, height * 400 // width)::int else height end as small_h from ({SHAPE})""")
def p9_io16_fitted_sizes(spark, sf_dir):
    """Previews of at most 1600 pixels, and the copy of at most 400 in width that searches work on."""
    w, h = F.col("width"), F.col("height")
    preview, small = geometry.fitted_size(w, h, F.lit(1600)), geometry.small_size(w, h)
    return shapes(spark, sf_dir).select("image_id", "width", "height", preview[0].alias("preview_w"), preview[1].alias("preview_h"), small[0].alias("small_w"), small[1].alias("small_h"))


# ---- pages


@query(f"""with s as (select *, case when width > height then 297.0::double else 210.0::double end as page_w, case when width > height then 210.0::double else 297.0::double end as page_h from ({SHAPE}))
    select image_id, page_w, page_h, round(least(page_w / width, page_h / height), 9) as scale, round((page_w - width * least(page_w / width, page_h / height)) / 2, 6) + 0.0::double as "left",
    round((page_h - height * least(page_w / width, page_h / height)) / 2, 6) + 0.0::double as bottom from s""")
def io8_io9_placed(spark, sf_dir):
    p = geometry.placed(F.col("width"), F.col("height"))
    return shapes(spark, sf_dir).select("image_id", "*").select("image_id", *[(F.round(v, 9) if k == "scale" else F.round(v, 6) + 0.0).alias(k) for k, v in p.items()])


@query("select page_id as image_id, case when page_id % 5 = 0 then 'Scan' else 'doc' || page_id end as title from pages")
def io10_title(spark, sf_dir):
    path = F.when(F.col("image_id") % 5 == 0, F.lit("/a/b/")).otherwise(F.concat(F.lit("/a/b/doc"), F.col("image_id").cast("string"), F.lit(".pdf")))
    return ids(spark, sf_dir).select("image_id", catalog.title_of(path).alias("title"))


@query(f"select image_id, case when image_id % 9 >= 5 then height else width end as width, case when image_id % 9 >= 5 then width else height end as height from ({SHAPE})")
def io17_upright_size(spark, sf_dir):
    w, h = geometry.upright_size(F.col("width"), F.col("height"), F.col("image_id") % 9)
    return shapes(spark, sf_dir).select("image_id", w.alias("width"), h.alias("height"))


# ---- catalogs


@query(FILES + " select scan_id, photos, pages, unscanned, next_num, state from states")
def cat1_states(spark, sf_dir):
    return states(spark, sf_dir).select("scan_id", "photos", "pages", "unscanned", "next_num", "state")


@query(FILES + """ select scan_id, case when state = 'done' and pages > 0 then 'document of ' || pages || case when pages = 1 then ' page' else ' pages' end when state = 'done' then 'document' when state = 'empty' then 'nothing yet'
    when state = 'shooting' then photos || case when photos = 1 then ' photo taken' else ' photos taken' end when state = 'ready' then pages || case when pages = 1 then ' page ready' else ' pages ready' end
    when unscanned = 1 then 'one photo left of ' || photos else unscanned || ' photos left of ' || photos end as subtitle from states""")
def cat2_cat3_subtitles(spark, sf_dir):
    return catalog.subtitle(states(spark, sf_dir))


@query("""select page_id as image_id, case when page_id % 3 = 0 then 'Named ' || page_id when page_id % 3 = 1 then '2024-03-05 07:08' else 'loose' end as title from pages""")
def cat4_title(spark, sf_dir):
    i = F.col("image_id")
    name = F.when(i % 3 == 0, F.concat(F.lit(" Named "), i.cast("string")))
    return ids(spark, sf_dir).select("image_id", catalog.title(name, F.when(i % 3 == 1, F.lit("2024-03-05_070809_00FF")).otherwise(F.lit("loose"))).alias("title"))


@query("select page_id as image_id, strftime(timestamp '2024-01-01' + to_seconds(page_id * 3601), '%Y-%m-%d_%H%M%S_') || upper(lpad(to_hex(page_id * 40503 % 65536), 4, '0')) as folder from pages")
def cat5_folder_name(spark, sf_dir):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("image_id") * 3601)
    return ids(spark, sf_dir).select("image_id", catalog.folder_name(at, F.col("image_id") * 40503 % 65536).alias("folder"))


@query(FILES + " select distinct p.scan_id, p.num from p where p.p % 2 = 0 and not exists (select 1 from files f where f.scan_id = p.scan_id and f.num = p.num)")
def cat6_j9_stray_sidecars(spark, sf_dir):
    side = ids(spark, sf_dir).where("image_id % 2 = 0").select(F.expr("image_id div 8").alias("scan_id"), (F.col("image_id") % 8 + 1).cast("int").alias("num"))
    return catalog.stray_sidecars(files(spark, sf_dir), side)


@query("select page_id as image_id, case when page_id % 4 = 1 then 'original' else 'small' end as quality from pages")
def cat7_quality(spark, sf_dir):
    i = F.col("image_id")
    word = F.when(i % 4 == 1, " original\n").when(i % 4 == 2, "Original").when(i % 4 == 3, "")
    return ids(spark, sf_dir).select("image_id", catalog.quality_word(word).alias("quality"))


STATE_LINE = "'1' || repeat(' 0.2500', 8) || ' 1 -2.5 10 20 30 200 ' || (page_id % 400) || ' 180 1 0.6 0 0 0 0 ' || (page_id % 6) || ' 0'"


def state_lines(spark, sf_dir):
    i = F.col("image_id")
    good = F.concat(F.lit("1" + " 0.2500" * 8 + " 1 -2.5 10 20 30 200 "), (i % 400).cast("string"), F.lit(" 180 1 0.6 0 0 0 0 "), (i % 6).cast("string"), F.lit(" 0"))
    line = F.when(i % 5 == 0, F.lit("2 1 2")).when(i % 5 == 1, F.lit("")).otherwise(good)
    return ids(spark, sf_dir).select("image_id", catalog.read_state(line).alias("state"))


@query("""select page_id as image_id, page_id % 5 > 1 as is_state, case when page_id % 5 > 1 then least(255, page_id % 400)::int end as white_g, case when page_id % 5 > 1 then least(3, page_id % 6)::int end as turns,
    case when page_id % 5 > 1 then '0.25,0.25,0.25,0.25,0.25,0.25,0.25,0.25' end as corners, case when page_id % 5 > 1 then '10,20,30' end as black, case when page_id % 5 > 1 then -2.5::double end as degrees, case when page_id % 5 > 1 then 0.6::double end as sharpen, case when page_id % 5 > 1 then true end as flat, case when page_id % 5 > 1 then true end as tones, case when page_id % 5 > 1 then false end as grey from pages""")
def cat8_read_state(spark, sf_dir):
    listed = lambda c: F.array_join(F.transform(f"state.{c}", lambda v: v.cast("string")), ",").alias(c)
    real = lambda c: F.round(F.col(f"state.{c}").cast("double"), 4).alias(c)
    return state_lines(spark, sf_dir).select(
        "image_id", F.col("state").isNotNull().alias("is_state"), F.get("state.white", F.lit(1)).alias("white_g"), "state.turns", listed("corners"), listed("black"), real("degrees"), real("sharpen"), "state.flat", "state.tones", "state.grey"
    )


@query("select page_id as image_id, '1' || repeat(' 0.2500', 8) || ' 1 -2.5 10 20 30 200 ' || least(255, page_id % 400) || ' 180 1 0.6 0.0000 0.0000 0.0000 0.0000 ' || least(3, page_id % 6) || ' 0' as line from pages where page_id % 5 > 1")
def cat9_write_state(spark, sf_dir):
    return state_lines(spark, sf_dir).where("state is not null").select("image_id", catalog.write_state("state").alias("line"))


@query("select page_id as image_id, trim(left('A-B-' || page_id || ' c ' || repeat('x', page_id % 80), 60)) as name from pages")
def cat10_cleaned_name(spark, sf_dir):
    raw = F.concat(F.lit(" A/B:"), F.col("image_id").cast("string"), F.lit("  \t c "), F.expr("repeat('x', cast(image_id % 80 as int))"))
    return ids(spark, sf_dir).select("image_id", catalog.cleaned_name(F.trim(raw)).alias("name"))


@query(FILES.replace("where kind = 'photo')", "where kind = 'photo' and num % 3 <> 0)") + " select scan_id, string_agg(num, ', ' order by num) as skipped from skipped group by scan_id having count(*) > 1")
def cat12_skipped_report(spark, sf_dir):
    """Every third photo of a scan is missing."""
    return catalog.skipped_report(files(spark, sf_dir).where("kind <> 'photo' or num % 3 <> 0"))


@query(FILES + " select scan_id, num from unscanned")
def j1_r8_unscanned(spark, sf_dir):
    return catalog.unscanned(files(spark, sf_dir))


@query(FILES + " select scan_id, num from skipped")
def j8_skipped(spark, sf_dir):
    return catalog.skipped(files(spark, sf_dir))


@query(FILES + """ select f.scan_id, f.num, case when f.num % 3 = 0 then f.num * 1.5 else f.num * 0.5 end::double as degrees, f.num % 3 = 0 as grey, f.num % 3 = 0 as is_stored from photo f""")
def j7_adjustments(spark, sf_dir):
    photos = catalog.numbers(files(spark, sf_dir), "photo")
    stored = photos.where("num % 3 = 0").select("scan_id", "num", (F.col("num") * 1.5).alias("degrees"), F.lit(True).alias("grey"))
    asked = photos.select("scan_id", "num", (F.col("num") * 0.5).alias("degrees"), F.lit(False).alias("grey"))
    return catalog.with_adjustments(photos, stored, asked, ["degrees", "grey"])


@query(FILES + " select scan_id, num, row_number() over (partition by scan_id order by num)::int as position from page")
def w4_w5_positions(spark, sf_dir):
    return catalog.positions(files(spark, sf_dir))


@query(FILES + " select scan_id, num from page qualify row_number() over (partition by scan_id order by num) = 2")
def w5_page_at(spark, sf_dir):
    return catalog.page_at(files(spark, sf_dir), 2)


@query(FILES + " select scan_id, state, row_number() over (order by scan_id desc) as place from states")
def o1_all_scans(spark, sf_dir):
    """The listing in order, and each row's place in it to tell the order by."""
    listed = catalog.newest_first(states(spark, sf_dir)).select("scan_id", "state")
    return listed.withColumn("place", F.row_number().over(Window.orderBy(F.desc("scan_id"))).cast("long"))


@query(FILES + " select scan_id, num from page")
def o2_numbers(spark, sf_dir):
    return catalog.ascending(files(spark, sf_dir))


@query(FILES + " select scan_id, min(num) as num from unscanned where num % 4 <> 1 group by scan_id")
def o3_first_unscanned(spark, sf_dir):
    rows = files(spark, sf_dir)
    return catalog.first_unscanned(rows, catalog.numbers(rows, "photo").where("num % 4 = 1"))


@query(FILES + """, stored as (select scan_id, num, num % 2 = 1 as grey from (select page_id // 8 as scan_id, (page_id % 8 + 1)::int as num from pages where page_id % 3 = 1))
    select scan_id, coalesce(grey, false) as grey from (select distinct scan_id from p) left join (
    select scan_id, arg_min(grey, num) as grey from stored join (select * from photo union select * from page) using (scan_id, num) group by scan_id) using (scan_id)""")
def o4_first_stored_decides_grey(spark, sf_dir):
    i = ids(spark, sf_dir)
    stored = i.where("image_id % 3 = 1").select(F.expr("image_id div 8").alias("scan_id"), (F.col("image_id") % 8 + 1).cast("int").alias("num"))
    return catalog.is_grey(synthetic.scans(i), files(spark, sf_dir), stored.withColumn("grey", F.col("num") % 2 == 1))


@query(FILES + """ select scan_id, pages || case when pages = 1 then ' page' else ' pages' end || ' and ' || photos || case when photos = 1 then ' photo' else ' photos' end || ' are deleted for good' || case when has_pdf then ', with the document' else '' end as body from states""")
def cat3_delete_text(spark, sf_dir):
    return catalog.delete_text(states(spark, sf_dir))


NAMES_SQL = """with n as (select page_id as p, page_id // 8 as scan_id, lpad((page_id % 8 + 1)::varchar, 4, '0') as num from pages), names as (
    select scan_id, 'photo' as folder, num || '.jpg' as name, p from n where p % 3 <> 0 union all select scan_id, 'page', num || case when p % 5 = 0 then '.part' else '.jpg' end, p from n where p % 4 = 0
    union all select scan_id, 'state', num || '.txt', p from n union all select scan_id, '', case p % 3 when 0 then 'scan.pdf' when 1 then 'other' else 'page' end, p from n)"""


@query(NAMES_SQL + """ select scan_id, folder, name from names n where case when folder in ('photo', 'page') then not regexp_matches(name, '^[0-9]{4}[.]jpg$')
    when folder = 'state' then not exists (select 1 from names k where k.scan_id = n.scan_id and k.folder in ('photo', 'page') and k.name = left(n.name, 4) || '.jpg') else name = 'other' end""")
def cat6_debris(spark, sf_dir):
    p, num = F.col("image_id"), F.lpad((F.col("image_id") % 8 + 1).cast("string"), 4, "0")
    i = ids(spark, sf_dir)
    name = lambda rows, folder, text: rows.select(F.expr("image_id div 8").alias("scan_id"), F.lit(folder).alias("folder"), text.alias("name"))
    names = name(i.where("image_id % 3 <> 0"), "photo", F.concat(num, F.lit(".jpg")))
    names = names.unionByName(name(i.where("image_id % 4 = 0"), "page", F.concat(num, F.when(p % 5 == 0, ".part").otherwise(".jpg"))))
    names = names.unionByName(name(i, "state", F.concat(num, F.lit(".txt"))))
    return catalog.debris(names.unionByName(name(i, "", F.when(p % 3 == 0, "scan.pdf").when(p % 3 == 1, "other").otherwise("page"))))


@query()
def r9_rewritten_pages(spark, sf_dir):
    """Every third photo has stored values, the others are looked at anew; all become grey."""
    photos = shots(spark, sf_dir).select(F.expr("image_id div 8").alias("scan_id"), (F.col("image_id") % 8 + 1).cast("int").alias("num"), "image")
    stored = photos.where("num % 3 = 0").select("scan_id", "num", F.struct(*[F.lit(v).cast("float").alias(f"crop_{n}") for n, v in (("x", 0.1), ("y", 0.2), ("w", 0.5), ("h", 0.25))], F.lit(1).alias("turns")).alias("values"))
    out = recipe.rewritten(photos, stored, grey=True)
    return images.headers(out.drop("error"), "jpeg", ["scan_id", "num", "jpeg"]).select("scan_id", "num", "shape.*", F.md5("jpeg").alias("digest"), "error")


@query(FILES + " select max(scan_id) as scan_id from states where state <> 'done'")
def o5_newest_open(spark, sf_dir):
    return catalog.newest_open(states(spark, sf_dir))


@query(FILES + " select scan_id, num from photo union select scan_id, num from page")
def u1_known_numbers(spark, sf_dir):
    return catalog.known_numbers(files(spark, sf_dir))


@query(FILES + " select scan_id, next_num from states")
def u2_next_number(spark, sf_dir):
    return states(spark, sf_dir).select("scan_id", "next_num")


# ---- whole pictures; no SQL can draw them, so these are checked by tests


def shots(spark, sf_dir):
    return synthetic.photos(ids(spark, sf_dir))


@query()
def g1_g2_find_paper(spark, sf_dir):
    return images.find_paper(shots(spark, sf_dir), keep=["image_id"]).select("image_id", "paper.*", "error")


@query()
def a3_levels_of_pictures(spark, sf_dir):
    return images.suggest_levels(shots(spark, sf_dir), keep=["image_id"]).select("image_id", "levels.*", "error")


@query()
def a11_tilt_of_pictures(spark, sf_dir):
    return images.suggest_straightening(shots(spark, sf_dir), keep=["image_id"])


@query()
def p8_sharpen(spark, sf_dir):
    out = images.act(shots(spark, sf_dir), lambda a: raster.sharpen(a, 1.0), keep=["image_id"])
    return out.select("image_id", "value.width", "value.height", F.md5("value.data").alias("digest"), "error")


@query()
def p9_p22_resize(spark, sf_dir):
    """Photos of 480 by 640: by the fine filter to 600, by the cheap one to the 400 of the small grey copy."""
    large = synthetic.photos(ids(spark, sf_dir), 480, 640)
    kind = T.StructType.fromDDL("width int, height int, digest string, small_width int, small_height int, small_digest string")

    def work(image: dict) -> dict:
        a = images.to_array(image)
        fit, small = raster.fit_within(a, 600), raster.small_grey(a)
        out = {}
        for name, x in (("", fit), ("small_", small)):
            out |= {f"{name}width": x.shape[1], f"{name}height": x.shape[0], f"{name}digest": hashlib.md5(x.tobytes()).hexdigest()}
        return out

    return images.apply(large, ["image"], work, kind, "v", ["image_id"]).select("image_id", "v.*", "error")


@query(PX + ", t as (select image_id, 63 - y as x, x as y, r, g, b from px)" + DIGEST.format(RGB, "t"))
def io1_pictures_to_pixels(spark, sf_dir):
    """Pixels become pictures, which are turned, and pixels again."""
    turned = images.act(images.from_pixels(px(spark, sf_dir)).drop("error"), lambda a: raster.rotate(a, 90), keep=["image_id"])
    return acts.digest(images.to_pixels(turned, image="value"))


@query()
def p11_p14_flatten_pictures(spark, sf_dir):
    out = images.act(shots(spark, sf_dir), lambda a: recipe.tools(a, deskew=True), keep=["image_id"])
    return out.select("image_id", "value.width", "value.height", F.md5("value.data").alias("digest"), "error")


@query()
def g16_crop_offset(spark, sf_dir):
    def work(image: dict) -> dict:
        a = images.to_array(image)
        x, y = images.find_crop_offset(a, a[40:200, 30:150])
        return {"x": x, "y": y}

    kind = T.StructType.fromDDL("x int, y int")
    return images.apply(shots(spark, sf_dir), ["image"], work, kind, "at", ["image_id"]).select("image_id", "at.*", "error")


@query()
def io2_io5_encoded_pages(spark, sf_dir):
    out = images.encode(shots(spark, sf_dir), 85, keep=["image_id"])
    return images.headers(out.drop("error"), "jpeg", keep=["image_id", "jpeg"]).select("image_id", "shape.*", F.length("jpeg").alias("bytes"), "error")


@query()
def h1_rebuilt_tables(spark, sf_dir):
    """Files with tables of even code lengths are rebuilt with the best ones."""
    even = images.apply(shots(spark, sf_dir), ["image"], lambda i: jpeg.encode(images.to_array(i), 85, jpeg.even_lengths), T.BinaryType(), "jpeg", ["image_id"])
    out = images.rebuild_tables(even.drop("error"), "jpeg", keep=["image_id", "jpeg"])
    return out.select("image_id", F.length("jpeg").alias("bytes"), F.length("smaller").alias("rebuilt_bytes"), F.md5("smaller").alias("digest"), "error")


@query()
def io3_io4_documents(spark, sf_dir):
    pages = shots(spark, sf_dir).select(F.expr("image_id div 8").alias("scan_id"), (F.col("image_id") % 8 + 1).cast("int").alias("num"), "image")
    made = images_to_pdf(pages)
    return made.select("scan_id", F.length("pdf").alias("bytes"), F.decode(F.substring("pdf", 1, 8), "ISO-8859-1").alias("head"), "error")


def tagged(data: bytes, tag: int) -> bytes:
    """A JPEG with an EXIF orientation."""
    tiff = b"MM\0*\0\0\0\x08\0\x01" + struct.pack(">HHIHH", 0x0112, 3, 1, tag, 0) + b"\0\0\0\0"
    return data[:2] + jpeg.segment(0xE1, b"Exif\0\0" + tiff) + data[2:]


def photo_files(spark, sf_dir) -> str:
    """A folder of photos as files, a scan of eight a folder, with orientations; returns its address."""
    folder = f"{shared_folder(spark)}/photos-{uuid.uuid4().hex}"
    numbers = shots(spark, sf_dir).select("image_id", F.expr("image_id div 8").alias("scan_id"), (F.col("image_id") % 8 + 1).cast("int").alias("num"), F.struct("image_id", "image").alias("both"))
    made = images.apply(numbers, ["both"], lambda b: tagged(jpeg.encode(images.to_array(b["image"]), 70), b["image_id"] % 8 + 1), T.BinaryType(), "jpeg", ["scan_id", "num"])
    documents.write_documents(made, folder, "pages")
    return folder


IN_FILES = "select page_id // 8 as scan_id, (page_id % 8 + 1)::int as num, (page_id % 8 + 1)::int as orientation from pages"
PLACE = r"/([0-9]+)/page/([0-9]{4})\.jpg$"


@query(f"select scan_id, num, 240 as width, 320 as height, orientation, case when orientation >= 5 then 320 else 240 end as upright_width, case when orientation >= 5 then 240 else 320 end as upright_height, 'jpeg' as kind from ({IN_FILES})")
def io1_io17_headers_of_files(spark, sf_dir):
    """Sizes and orientations of the photos in a folder, which are never read whole."""
    found = pictures.picture_files(spark, photo_files(spark, sf_dir), pattern="[0-9][0-9][0-9][0-9].jpg")
    part = lambda k: F.regexp_extract("path", PLACE, k)
    return found.select(part(1).cast("long").alias("scan_id"), part(2).cast("int").alias("num"), "width", "height", "orientation", "upright_width", "upright_height", "kind")


@query(f"select scan_id, num, case when orientation >= 5 then 320 else 240 end as width, case when orientation >= 5 then 240 else 320 end as height, true as decoded, true as dark_at_the_corner from ({IN_FILES})")
def io1_opened_files(spark, sf_dir):
    """Photos from a folder, decoded and upright; the table lies at every corner."""
    found = load_images(spark, f"{photo_files(spark, sf_dir)}/*/page")
    part = lambda k: F.regexp_extract("path", PLACE, k)
    first = F.conv(F.hex(F.substring("image.data", 1, 1)), 16, 10).cast("int")
    return found.select(part(1).cast("long").alias("scan_id"), part(2).cast("int").alias("num"), "image.width", "image.height", F.col("error").isNull().alias("decoded"), (first < 60).alias("dark_at_the_corner"))


@query("select page_id // 8 as scan_id, count(*)::int as n_pages, true as whole from pages group by 1")
def io12_r4_written_documents(spark, sf_dir):
    """Pages written as documents, all at once, and the documents opened."""
    encoded = images.encode(shots(spark, sf_dir), 60, keep=["image_id"]).select(F.expr("image_id div 8").alias("scan_id"), (F.col("image_id") % 8 + 1).cast("int").alias("num"), "jpeg")
    folder = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    documents.write_documents(encoded, folder)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", F.decode("content", "ISO-8859-1").alias("text"))
    whole = F.col("text").startswith("%PDF-") & F.rtrim(F.regexp_replace(F.substring("text", -8, 8), "\n", "")).endswith("%%EOF")
    return found.select(F.regexp_extract("path", r"([0-9]+)\.pdf$", 1).cast("long").alias("scan_id"), (F.size(F.split("text", "/Type /Page ")) - 1).alias("n_pages"), whole.alias("whole"))


@query(FILES + """, go as (select scan_id, k, coalesce(num, 0) as n, case k when 1 then 'scan.pdf' when 2 then 'page/' || lpad(num::varchar, 4, '0') || '.jpg' when 3 then 'state/' || lpad(num::varchar, 4, '0') || '.txt' else 'photo/' || lpad(num::varchar, 4, '0') || '.jpg' end as path
    from (select scan_id, num, list_position(['pdf', 'page', 'state', 'photo'], kind) as k from files))
    select scan_id, row_number() over (partition by scan_id order by k, n)::int as step, path from go""")
def cat11_delete_plan(spark, sf_dir):
    """The steps in which all scans would go."""
    return deletes.plan(files(spark, sf_dir))


@query("""select page_id // 8 as scan_id, k::int as step, ['scan.pdf', 'page/' || n || '.jpg', 'state/' || n || '.txt', 'photo/' || n || '.jpg'][k] as path
    from (select page_id, lpad((page_id % 8 + 1)::varchar, 4, '0') as n from pages where page_id % 8 = 3), range(1, 5) q(k)""")
def cat11_retakes(spark, sf_dir):
    """The fourth page of each scan is to be taken anew."""
    numbers = ids(spark, sf_dir).where("image_id % 8 = 3").select(F.expr("image_id div 8").alias("scan_id"), (F.col("image_id") % 8 + 1).cast("int").alias("num"))
    return deletes.retakes(numbers)


@query()
def r1_scan_page(spark, sf_dir):
    out = recipe.scan_page(shots(spark, sf_dir), keep=["image_id"])
    return images.headers(out.drop("error"), "jpeg", keep=["image_id", "jpeg"]).select("image_id", "shape.width", "shape.height", F.length("jpeg").alias("bytes"), "error")


@query()
def r2_suggest_adjustments(spark, sf_dir):
    return recipe.suggest_adjustments(shots(spark, sf_dir), keep=["image_id"]).select("image_id", "suggestion.*", "error")


@query()
def r3_adjust_page(spark, sf_dir):
    photos = shots(spark, sf_dir)
    asked = recipe.suggest_adjustments(photos, keep=["image_id", "image"]).withColumnRenamed("suggestion", "values").drop("error")
    out = recipe.adjust_page(asked, keep=["image_id"])
    return out.select("image_id", F.length("jpeg").alias("bytes"), "error")
