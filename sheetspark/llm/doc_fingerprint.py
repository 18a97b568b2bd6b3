"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

The terms of a text are its runs of five words (all words, if it has fewer), in
lower case, weighted by how often they occur. For each of ``SAMPLES`` samples every
term draws r and c from Gamma(2, 1) and b from [0, 1) by a hash of term and sample;
with weight w it gets the step t = floor(ln w / r + b) and the key
ln c - r (t - b + 1). The least key is the sample. Two texts have the same sample
with a probability equal to the generalised Jaccard similarity of their weights, so
the share of equal samples estimates that, with a standard deviation of at most
0.5 / sqrt(SAMPLES). A sample is stored as 32 bits of a hash of its key.

``next to`` relates each document to the one after it in order of doc_id. Ranges of
doc_id with about ``RANGE_ROWS`` documents each are the only groups; the first
document of a range also stands, as a guest, at the end of the range before, and the
first of all at the end of the last. So one shuffle of the texts serves all of it.

There are at most ``MAX_RANGES`` ranges, which bounds how many tasks share the work;
what a range has more it sorts and sums with spilling, so results don't change.

Results at the edges: null text is empty; an empty text has the empty fingerprint,
which is like another empty one and unlike all else; a text without words is one
term; a null doc_id comes first; all rows without one are in the first range; equal
doc_ids are ordered by a hash of the text; a very long text is one row like others;
an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
WORDS = 5
RANGE_ROWS = 1000
MAX_RANGES = 4096


def flat(text: str) -> str:
    """Lower case, with a space for each kind of blank."""
    for blank in ("\\t", "\\n", "\\u000B", "\\f", "\\r"):
        text = f"replace({text}, '{blank}', ' ')"
    return f"lower({text})"


def words(text: str) -> str:
    return f"array_remove(split({text}, ' '), '')"


def term_hashes(w: str, text: str, first: str = "0") -> str:
    """The hashed terms of a word array, from the one at ``first`` on."""
    run = ", ".join(f"get({w}, i + {k})" for k in range(WORDS))
    return f"""case when size({w}) - {WORDS} >= {first} then transform(sequence({first}, size({w}) - {WORDS}), i -> xxhash64({run}))
        when size({w}) >= {WORDS} then cast(array() as array<bigint>)
        when size({w}) > 0 then array(xxhash64({w})) when {text} <> '' then array(xxhash64({text}, 'whole')) else cast(array() as array<bigint>) end"""


def sample_key(d: int) -> str:
    """The key of sample d, from a term's hash ``term`` and the logarithm ``lw`` of its weight."""
    one, two = f"xxhash64(term, {2 * d})", f"xxhash64(term, {2 * d + 1})"

    def uniform(z: str, shift: int, bits: int) -> str:
        return f"(((shiftrightunsigned({z}, {shift}) & {(1 << bits) - 1}L) + 0.5D) * {2.0**-bits!r}D)"

    r = f"(0.0D - ln({uniform(one, 0, 32)} * {uniform(one, 32, 32)}))"
    c = f"(0.0D - ln({uniform(two, 0, 22)} * {uniform(two, 22, 21)}))"
    b = uniform(two, 43, 21)
    return f"ln({c}) - {r} * (if(lw = 0.0D, 0.0D, cast(floor(lw / {r} + {b}) as double)) - {b} + 1.0D)"


KEYS = ("part", "guest", "doc_id", "th")
PLACE = ("guest", "doc_id", "th")


def with_next(docs: DataFrame) -> DataFrame:
    """part, guest, doc_id, th (hash of the text), text and following (the next document's text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    nameless = F.min(F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    stats = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("m"), nameless.alias("h")).first()
    ranges = min(MAX_RANGES, max(1, stats["n"] // RANGE_ROWS))
    shares = [k / ranges for k in range(ranges)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 10 * ranges + 10000).alias("q"), F.min("doc_id").alias("low")).first()
    bounds = sorted({found["low"], *(found["q"] or [])} - {None}) or [0]
    lows = F.array(*[F.lit(b).cast("long") for b in bounds])
    last = len(bounds)
    own = F.greatest(F.lit(1), F.size(F.filter(lows, lambda b: b <= F.col("doc_id"))))
    starts = F.coalesce(F.array_contains(lows, F.col("doc_id")), F.lit(False))
    # the first of all: of rows without a doc_id that of the least hash
    first = F.col("doc_id").isNull() & (F.xxhash64("text") == F.lit(stats["h"])) if stats["m"] < stats["n"] else F.col("doc_id") == F.lit(bounds[0])
    seat = lambda part, guest: F.struct(part.cast("int").alias("part"), F.lit(guest).alias("guest"))
    none = F.array().cast("array<struct<part:int,guest:int>>")
    seats = F.concat(
        F.array(seat(own, 0)),
        F.when(starts & (own > 1), F.array(seat(own - 1, 1))).otherwise(none),
        F.when(first, F.array(seat(F.lit(last), 2))).otherwise(none),
    )
    seated = rows.select("doc_id", "text", F.xxhash64("text").alias("th"), F.explode(seats).alias("s")).select("s.part", "s.guest", "doc_id", "th", "text")
    # a task for each range, so that what a task sums stays small at every size
    seated = seated.repartition(last, "part")
    return seated.withColumn("following", F.lead("text").over(Window.partitionBy("part").orderBy(*PLACE)))


def fingerprints(rows: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """KEYS, fingerprint (of ``text``) and edited_fingerprint (of ``head || tail``).

    ``rows`` has KEYS, text, head, which begins text, and tail. Terms that both texts
    have from the head are sampled once.
    """
    # the last word of the head may go on in what follows, so it is cut with that; the words before it are shared
    cut = rows.withColumns({"edited": F.concat("head", "tail"), "own": F.expr("substring(text, length(head) + 1)")})
    cut = cut.withColumns({"fh": F.expr(flat("head")), "fa": F.expr(flat("own")), "fb": F.expr(flat("tail"))})
    cut = cut.withColumn("open", F.substring_index("fh", " ", -1))
    cut = cut.withColumn("wh", F.expr(words("substring(fh, 1, length(fh) - length(open))")))
    cut = cut.withColumn("wa", F.concat("wh", F.expr(words("concat(open, fa)")))).withColumn("wb", F.concat("wh", F.expr(words("concat(open, fb)"))))
    cut = cut.withColumn("nc", F.when((F.size("wa") >= WORDS) & (F.size("wb") >= WORDS), F.greatest(F.lit(0), F.size("wh") - WORDS + 1)).otherwise(0))
    run = ", ".join(f"get(wa, i + {k})" for k in range(WORDS))
    both = f"case when nc > 0 then transform(sequence(0, nc - 1), i -> xxhash64({run})) else cast(array() as array<bigint>) end"
    cut = cut.withColumn("ta", F.expr(term_hashes("wa", "text", "nc"))).withColumn("na", F.size("ta"))
    terms = F.concat(F.expr(both), F.col("ta"), F.expr(term_hashes("wb", "edited", "nc")))
    each = cut.select(*KEYS, "nc", "na", F.posexplode_outer(terms).alias("pos", "term"))
    in_a, in_b = (F.col("pos") < F.col("nc") + F.col("na")), (F.col("pos") < F.col("nc")) | (F.col("pos") >= F.col("nc") + F.col("na"))
    weights = each.select(*KEYS, "term", in_a.cast("int").alias("a"), in_b.cast("int").alias("b")).groupBy(*KEYS, "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # text 1, edited text 2, both 3
    one = "array(struct(a as w, case when b = a then 3 else 1 end as of))"
    two = "array(struct(b as w, 2 as of))"
    split = weights.select(*KEYS, "term", F.explode_outer(F.expr(f"case when b = 0 or b = a then {one} when a = 0 then {two} else concat({one}, {two}) end")).alias("x"))
    split = split.select(*KEYS, "term", F.col("x.of").alias("of"), F.when(F.col("x.w") == 1, 0.0).otherwise(F.ln(F.col("x.w").cast("double"))).alias("lw"))
    least = split.groupBy(*KEYS, "of").agg(*[F.min(F.expr(sample_key(d))).alias(f"k{d}") for d in range(samples)])
    sides = least.groupBy(*KEYS).agg(
        *[F.min(F.when(F.col("of") != 2, F.col(f"k{d}"))).alias(f"a{d}") for d in range(samples)],
        *[F.min(F.when(F.col("of") != 1, F.col(f"k{d}"))).alias(f"b{d}") for d in range(samples)],
    )
    return sides.select(*KEYS, as_text("a", samples).alias("fingerprint"), as_text("b", samples).alias("edited_fingerprint"))


def as_text(side: str, samples: int) -> Column:
    """Eight hexadecimal digits a sample; empty if there is no term."""
    digits = [F.lpad(F.lower(F.hex(F.xxhash64(f"{side}{d}").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0") for d in range(samples)]
    return F.when(F.col(f"{side}0").isNull(), F.lit("")).otherwise(F.concat(*digits))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints."""
    equal = " + ".join(f"cast(substring({a}, {8 * d + 1}, 8) = substring({b}, {8 * d + 1}, 8) as int)" for d in range(samples))
    return F.expr(f"case when {a} = '' or {b} = '' then cast({a} = {b} as double) else ({equal}) / {samples}D end")


def with_edits(docs: DataFrame) -> DataFrame:
    """with_next, and head and tail: all but the last quarter of the characters, and as many of the next document's first."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    return rows.withColumn("head", F.left("text", F.col("n_chars").cast("int") - quarter)).withColumn("tail", F.left(F.coalesce("following", F.lit("")), quarter))


def compared(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next."""
    rows = with_edits(docs)
    prints = fingerprints(rows, samples)
    prints = prints.withColumn("next", F.lead("fingerprint").over(Window.partitionBy("part").orderBy(*PLACE))).where("guest = 0")
    prints = prints.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "fingerprint", "edited_fingerprint", "next").dropDuplicates(["d", "t"])
    texts = rows.where("guest = 0").select("doc_id", "th", "n_chars", F.sha2(F.concat("head", "tail").cast("binary"), 256).alias("edited_sha256"))
    both = texts.join(prints, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"),
        likeness("fingerprint", "next", samples).alias("near_next"),
    )
