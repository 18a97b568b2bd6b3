"""Mixing sources to target weights: entropy balancing of document rates, then whole copies.

Each source has a target in words. Rates (how many times a document is taken, 0 to
``most_copies``) are those nearest, by relative entropy, to one common rate of which the
words of each source meet its target. By the convex dual that is a single number a source,
its tilt t: the odds of a rate are the common odds times exp(t * size). Newton's iterations
find all tilts at once. A rate depends on a document's source and size alone, so they run on
a table of (source, size, number of documents), summed before anything is shuffled, and no
step collects it. Sums are exact decimals, whatever their order, so reruns agree.

Copies are whole. Sizes of a source are taken from the largest down, and what rounding one
leaves over goes on to the next, so a source misses its target by half of its smallest
documents' size at most, if it can be met at all. Among documents of one size those with the least hash get the extra
copy; they meet in cells of a 256th of their hashes, so a frequent size is never one group.

With ``tilt="documents"`` a rate is chosen for each document, and thinner sources keep
short documents longer; with ``tilt="words"`` entropy is counted by words, and all documents
of a source have one rate.

Results at the edges: a null text has size 0 and is taken with 0 words, once at most; null is a source of its own, the last;
rows with null or repeated ids are documents of their own (of wholly equal ones any may get
the copy); a source without words has target 0; an empty table stays empty. Columns besides those asked for pass
unchanged, but those that have the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetspark.llm.common import Scratch, materialized, quoted, without

#: Fixed: what parts words.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST_COPIES = 1.5, 2
CELLS = 256
#: A step goes no further than this, or than the tilt is from 0; enough for any tilt to double its way out.
FAR = 4.0
STEPS_A_ROUND, MOST_ROUNDS = 4, 40
CLOSE = 1e-7
RESULTS = ("size", "source_size", "target", "rate", "copies", "taken")


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, sid, source_size and target from (source, source_size): ``share`` of all words, dealt by weight, at most ``most`` times a source's own.

    Weights go to the sources in order of their code points, null last, again and again. What a
    source can't take is dealt to the others, by weight, until none is over: those are full whose
    room for each unit of weight is below the level that the rest then has. A row is a source, and
    all sources are ordered in one task: they are names, not documents.
    """
    named = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights))
    room = F.col("source_size") * float(most)
    rows = named.withColumn("weight", weight).withColumn("room", room)
    before = Window.orderBy(F.col("room") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "rest": F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("room").over(before), F.lit(0.0)),
        "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # going up by room for weight, a source is full if the level among it and all above is at or over its own
    rows = rows.withColumn("full", F.col("rest") / F.col("left") >= F.col("room") / F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("room") / F.col("weight"), "sid", (F.col("rest") / F.col("left")).alias("level")))).over(everything)
    target = F.when(F.col("full"), F.col("room")).otherwise(F.least("room", level["level"] * F.col("weight")))
    return rows.select("source", "sid", "source_size", target.alias("target"))


def feature(tilt: str) -> Column:
    """What a tilt is multiplied by: a size against the source's mean, or one."""
    if tilt not in ("documents", "words"):
        raise ValueError(f"tilt is by documents or words, not {tilt}")
    return F.col("size") / F.col("scale") if tilt == "documents" else F.lit(1.0)


def rate_of(tilt: str, base: float, most: float) -> Column:
    """The rate under a tilt: odds of the common rate, tilted, in 0 to ``most``."""
    odds = F.lit(base / (most - base)).cast("double") * F.exp(F.least(F.greatest(F.col("lam") * feature(tilt), F.lit(-600.0)), F.lit(600.0)))
    tilted = most * odds / (1 + odds)
    return F.when(F.col("target") >= most * F.col("source_size"), F.lit(float(most))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(tilted)


def solved(classes: DataFrame, sources: DataFrame, tilt: str, base: float, most: float, scratch: Scratch) -> DataFrame:
    """sources with ``lam``, the tilt of each: Newton's method on the dual, held between bounds that close in.

    ``classes`` has sid, size and docs. Sources that take all or nothing have no tilt to find.
    """
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    words = F.col("docs") * F.col("size").cast("double")
    scale = classes.groupBy("sid").agg(F.try_divide(exact(words * F.col("size")), exact(words)).alias("scale"))
    state = sources.join(scale, "sid", "left").withColumns({"lam": F.lit(0.0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "off": F.lit(None).cast("double")})
    state = scratch.table(state, "state")
    for _ in range(MOST_ROUNDS):
        for _ in range(STEPS_A_ROUND):
            state = step(classes, state, tilt, base, most, exact)
        state = scratch.table(state, "state")
        if state.where(F.abs("off") > CLOSE * F.col("target")).isEmpty():
            break
    return state


def step(classes: DataFrame, state: DataFrame, tilt: str, base: float, most: float, exact) -> DataFrame:
    """One Newton step of every source that is still off its target."""
    rows = classes.join(state.select("sid", "lam", "scale", "target", "source_size"), "sid")
    rate = rate_of(tilt, base, most)
    words = F.col("docs") * F.col("size").cast("double")
    sums = rows.groupBy("sid").agg(exact(words * rate).alias("sum"), exact(words * feature(tilt) * rate * (1 - rate / most)).alias("slope"))
    s = state.drop("off").join(sums, "sid", "left").withColumn("off", F.coalesce(F.col("sum") - F.col("target"), F.lit(0.0)))
    moving = F.abs("off") > CLOSE * F.col("target")
    s = s.withColumn("low", F.when(F.col("off") < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("off") > 0, F.col("lam")).otherwise(F.col("high")))
    far = F.greatest(F.lit(FAR), F.abs("lam"))
    newton = F.col("lam") - F.least(F.greatest(F.coalesce(F.try_divide("off", "slope"), F.signum("off") * far), -far), far)
    outside = (newton <= F.col("low")) | (newton >= F.col("high"))
    following = F.when(F.coalesce(outside, F.lit(False)), F.coalesce((F.col("low") + F.col("high")) / 2, newton)).otherwise(newton)
    return s.withColumn("lam", F.when(moving, following).otherwise(F.col("lam"))).select(*state.columns)


def rounded(classes: DataFrame, most: int) -> DataFrame:
    """sid, size, docs and ``total``, the copies of all documents of a size, from (sid, size, docs, rate, target).

    Sizes go from the largest down within a source, as a stream; what one size leaves over or
    takes too much is the next one's. First of all that is the target less the rates' sum.
    """
    sums = classes.groupBy("sid").agg(F.sum((F.col("docs") * F.col("size") * F.col("rate")).cast("decimal(38,9)")).cast("double").alias("sum"))
    rows = classes.join(sums, "sid").select("sid", "size", "docs", "rate", (F.col("target") - F.col("sum")).alias("start"))
    rows = rows.repartition("sid").sortWithinPartitions("sid", F.desc("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, over = None, 0.0
        for batch in batches:
            totals = []
            for sid, size, docs, rate, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sid != own:
                    own, over = sid, start
                wanted = docs * rate * size + over
                total = min(max(int(wanted / size + 0.5), 0), most * docs) if size else min(docs, round(docs * rate))
                over = wanted - total * size
                totals.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(totals, pa.int64())], names=["sid", "size", "docs", "total"])

    return rows.mapInArrow(run, "sid int, size long, docs long, total long")


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    keep: list[str] | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most_copies: int = MOST_COPIES,
    tilt: str = "documents",
    seed: int = 12,
) -> DataFrame:
    """Adds size, source_size, target (both of the source, in words), rate, copies and taken (size times copies)."""
    if not (weights and min(weights) > 0 and 0 < share < most_copies):
        raise ValueError("weights are above zero, and the share is less than the copies allow")
    kept = without(docs.columns if keep is None else keep, RESULTS)
    hidden = [f"\x02{i}" for i in range(len(kept))]
    name, chance = F.col(quoted(source)).cast("string"), F.xxhash64(F.col(quoted(key)), F.col(quoted(text)), F.lit(seed))
    rows = docs.select(
        *[F.col(quoted(c)).alias(h) for c, h in zip(kept, hidden, strict=True)],
        F.coalesce(name, F.lit("")).alias("name"),
        name.isNull().alias("nameless"),
        size_of(text).alias("size"),
        chance.alias("chance"),
    )
    rows = rows.withColumn("cell", F.pmod("chance", F.lit(CELLS)).cast("int"))
    group = ["name", "nameless"]
    with Scratch(docs.sparkSession) as scratch:
        if text not in kept:  # all that is needed of texts is their size, so they are read once
            rows = scratch.table(rows, "sizes")
        cells = scratch.table(rows.groupBy(*group, "size", "cell").agg(F.count("*").alias("docs")), "cells")
        sums = cells.groupBy(*group).agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
        sources = targets(sums.select(F.when(~F.col("nameless"), F.col("name")).alias("source"), "source_size"), weights, share, most_copies)
        sources = scratch.table(sources.withColumns({"name": F.coalesce("source", F.lit("")), "nameless": F.col("source").isNull()}).drop("source"), "sources")
        cells = scratch.table(cells.join(sources.select(*group, "sid"), group), "named")
        classes = scratch.table(cells.groupBy("sid", "size").agg(F.sum("docs").alias("docs")), "classes")
        state = solved(classes, sources, tilt, share, most_copies, scratch)
        rated = classes.join(state.select("sid", "lam", "scale", "target", "source_size"), "sid").withColumn("rate", rate_of(tilt, share, most_copies))
        rated = scratch.table(rated.select("sid", "size", "docs", "rate", "target", "source_size"), "rated")
        plan = rounded(rated, most_copies).join(rated.drop("docs"), ["sid", "size"])
        # of the documents of a size each gets the whole part, and each cell its share of the rest
        along = Window.partitionBy("sid", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        dealt = cells.withColumnRenamed("docs", "own").join(plan, ["sid", "size"]).withColumn("seen", F.sum("own").over(along))
        upto = "cast(total % docs as decimal(19, 0)) * cast({} as decimal(19, 0)) div cast(docs as decimal(19, 0))"
        dealt = dealt.withColumn("extra", F.expr(f"{upto.format('seen')} - {upto.format('(seen - own)')}")).withColumn("each", F.expr("total div docs"))
        dealt = scratch.table(dealt.select(*group, "size", "cell", "source_size", "target", "rate", "each", "extra"), "dealt")
        met = rows.join(dealt, [*group, "size", "cell"])
        within = Window.partitionBy(*group, "size", "cell").orderBy("chance")
        met = met.withColumn("copies", F.col("each") + (F.row_number().over(within) <= F.col("extra")).cast("long"))
        out = met.select(*[F.col(h).alias(c) for c, h in zip(kept, hidden, strict=True)], *RESULTS[:-1], (F.col("size") * F.col("copies")).alias("taken"))
        return materialized(out, "source-mix")


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row of a mix as often as it is taken; those that aren't taken go."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
