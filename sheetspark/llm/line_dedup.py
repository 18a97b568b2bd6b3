"""Line deduplication across documents by a deletion-neighbourhood join, in DataFrame functions only.

A line is dropped if an earlier line, by (doc_id, hash of the text, line number),
is equal to it or within one edit (a character more, less or other). In lines of a few
characters one edit makes another meaning, so callers may set ``near_chars``, from which on
lines are compared so; by default all are. Blanks at a line's ends don't count; blank lines stay.

Equal lines meet by a 128-bit hash and a minimum. For near ones, two cheap and
exact filters come first. Lines within one edit agree in a half: those that share
no half with a different line are done. Of the rest, cut into ``SEGMENTS`` pieces,
they agree in all but one piece. Only where that holds, the deletion neighbourhood
of that piece is emitted as hashed keys: the piece itself and, for each place, the
piece without its character there. Equal keys join; a key tells the place for a
character that is other, so that all lines of a key are one edit apart or one
deletion away from the shortest. So the minimum of a key is all that each member
needs, and no pairs within a group are made. The edit distance of each line that
would go and its witness is then verified on the texts.

Results at the edges: null text stays null; rows that are equal in doc_id and text
share their places, so none of them is earlier; a null doc_id comes first; a very
long text is cut to its lines, a very long line is compared by pieces; other columns
pass unchanged, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetspark.llm.common import Scratch, materialized, quoted

NEAR_CHARS = 1
SEGMENTS = 8
BROADCAST_LINES = 400_000  # of about 50 bytes each


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def lines_of(docs: DataFrame) -> DataFrame:
    """place (doc_id, hash of the text, line number) and the trimmed line, blank ones left out."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("no", "raw"))
    return rows.select(F.struct("doc_id", "th", "no").alias("place"), trimmed(F.col("raw")).alias("line")).where("line <> ''")


def line_id(line: Column) -> Column:
    return F.unhex(F.md5(line))


def halves(near_chars: int) -> str:
    """Hashes of the first and last halves that a line shares with one of its own length, one more or one less."""

    def ends(size: str) -> str:
        return f"xxhash64('<', left(line, {size})), xxhash64('>', right(line, {size}))"

    return f"case when n < {near_chars} then array() else array_distinct(array({ends('n div 2')}, {ends('(n - 1) div 2')})) end"


def distinct_lines(docs: DataFrame, near_chars: int) -> DataFrame:
    """For each different line its id, first place, length and half keys."""
    lines = lines_of(docs).withColumn("n", F.length("line"))
    lines = lines.select(line_id(F.col("line")).alias("id"), "place", "n", F.expr(halves(near_chars)).cast("array<bigint>").alias("halves"))
    return lines.groupBy("id").agg(F.min(F.struct("place", "n", "halves")).alias("m")).select("id", "m.place", "m.n", "m.halves")


def shared(keys: DataFrame) -> DataFrame:
    """The rows (key, id, ...) whose key has several ids."""
    several = keys.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("key")
    return keys.join(several, "key", "left_semi")


def near_drops(docs: DataFrame, distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Ids of the lines with an earlier line within one edit."""
    open_ids = shared(distinct.select("id", F.explode("halves").alias("key"))).select("id").distinct()
    wanted = scratch.table(distinct.join(open_ids, "id", "left_semi").select("id", "place", "n"), "open")
    found = wanted.select(F.col("id").alias("i"), F.col("place").alias("p"), "n")
    if wanted.count() <= BROADCAST_LINES:
        found = F.broadcast(found)
    texts = lines_of(docs).withColumn("id", line_id(F.col("line")))
    texts = texts.join(found, F.expr("id = i and place <=> p")).select("id", "place", "n", "line").dropDuplicates(["id"])
    texts = scratch.table(texts, "texts")

    # the piece that may differ, for partners of which the shorter has `size` characters
    pieces = texts.select("*", F.explode(F.expr("array(n, n - 1)")).alias("size")).select("*", F.explode(F.expr(f"sequence(0, {SEGMENTS - 1})")).alias("piece"))
    pieces = pieces.withColumn("before", F.expr(f"size * piece div {SEGMENTS}")).withColumn("after", F.expr(f"size - size * (piece + 1) div {SEGMENTS}"))
    pieces = pieces.withColumn("key", F.expr("xxhash64(size, piece, left(line, cast(before as int)), right(line, cast(after as int)))"))
    live = shared(pieces.select("key", "id", "n", "size", "before", "after"))
    live = live.join(texts.select("id", "place", "line"), "id")
    live = live.withColumn("middle", F.expr("substring(line, cast(before + 1 as int), cast(n - before - after as int))"))

    without = "concat(left(middle, p - 1), substring(middle, p + 1))"
    places = "case when middle = '' then cast(array() as array<int>) else sequence(1, length(middle)) end"
    emitted = live.select(
        "id",
        "place",
        (F.col("n") == F.col("size")).alias("short"),
        F.explode(
            F.expr(f"""case when n = size
                then concat(array(struct(xxhash64(key, middle) as variant, true as gone)),
                            transform({places}, p -> struct(xxhash64(key, p, {without}) as variant, false as gone)))
                else array_distinct(transform({places}, p -> struct(xxhash64(key, {without}) as variant, true as gone))) end""")
        ).alias("v"),
    ).select("id", "place", "short", "v.variant", "v.gone")
    # for a deletion the shortest stands on one side, all longer ones on the other
    emitted = emitted.withColumn("side", F.expr("gone and short"))
    own = F.struct("place", "id")
    sides = emitted.groupBy("variant", "gone", "side").agg(F.min(own).alias("first"))
    other = sides.select("variant", "gone", F.when(F.col("gone"), ~F.col("side")).otherwise(F.col("side")).alias("side"), F.col("first").alias("witness"))
    gone = emitted.join(other, ["variant", "gone", "side"]).where("witness.place < place").select("id", F.col("witness.id").alias("w")).distinct()
    line, witness = texts.select("id", "line"), texts.select(F.col("id").alias("w"), F.col("line").alias("l"))
    return gone.join(line, "id").join(witness, "w").where(F.levenshtein("line", "l", 1).between(0, 1)).select("id").distinct()


def kept_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id, th (hash of the text) and nos, the numbers of the lines that stay; blank lines are not told."""
    with Scratch(docs.sparkSession) as scratch:
        distinct = scratch.table(distinct_lines(docs, near_chars), "distinct")
        kept = distinct.join(near_drops(docs, distinct, scratch), "id", "left_anti").select("place.*")
        return materialized(kept.groupBy("doc_id", "th").agg(F.collect_list("no").alias("nos")), "lines-kept")


def dedup_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """``docs`` with ``text`` without the dropped lines, and n_lines and n_dropped.

    The two counts replace columns of those names. Lines keep their blanks and their order.
    """
    kept = kept_lines(docs.select("doc_id", "text"), near_chars).select(F.col("doc_id").alias("\x01d"), F.col("th").alias("\x01h"), F.col("nos").alias("\x01k"))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    rows = docs.select(*[quoted(c) for c in names]).withColumn("\x01t", F.xxhash64("text"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("\x01d")) & (F.col("\x01t") == F.col("\x01h")), "left")
    rows = rows.withColumn("\x01s", F.split("text", "\n", -1))
    lines = F.col("\x01s")
    nos = F.coalesce(F.col("\x01k"), F.array().cast("array<int>"))
    blank = F.filter(F.transform(lines, lambda line, i: F.when(trimmed(line) == "", i).otherwise(-1)), lambda i: i >= 0)
    left = F.transform(F.array_sort(F.concat(nos, blank)), lambda i: F.get(lines, i))
    rows = rows.withColumn("\x01l", left).withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    rows = rows.withColumn("n_dropped", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines") - F.size("\x01l")).cast("long"))
    new = {"text": F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.array_join("\x01l", "\n")).alias("text")}
    return rows.select(*[new.get(c, F.col(quoted(c))) for c in names], F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), "n_dropped")
