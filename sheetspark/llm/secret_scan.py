"""Secret scans with corpus-wide ownership frequency.

Three patterns give candidates in every text. Each candidate's value is hashed, and
the hashes are counted over the corpus: in how many repositories (here documents)
and by how many owners (here sources) a value occurs. A value in
``MANY_REPOSITORIES`` or with ``MANY_OWNERS`` is an example that was copied; any
other is few by both counts and, if it looks random, taken for a live credential.
The verdicts are spans of two more kinds over the value alone, ``live`` and
``copied``; the patterns' own spans stay.

Counting takes one row for each value, document and owner at most and sums before
it shuffles. The verdicts are joined back, by hash, in a join that Spark can split
where one value is in a third of all rows.

Results at the edges: null or empty text has no spans; a null owner counts as no
owner, a null repository as none; equal rows get equal results; a very long text is
scanned whole; result columns replace input columns of their names; an empty table
stays empty.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetspark.llm.common import materialized, texts_of, with_arrow

#: The patterns of the base kinds and their least lengths, fixed by the query's contract.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # shorter runs fail, and no run begins within another
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "live", "copied")
MIN_BITS = 2.5  # of entropy for each character of a live value
MANY_OWNERS = 3
MANY_REPOSITORIES = 10

SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.BinaryType()), T.StructField("value_start", T.LongType()), T.StructField("random", T.BooleanType())])
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary()), ("value_start", pa.int64()), ("random", pa.bool_())]))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    return entropy(value) >= MIN_BITS and any(c.isdigit() for c in value) and len(set(value)) > 4


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """kind, start, end and the start of the value, by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(0, m.start(), m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], f[0]))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``candidates``: kind (0 assign, 1 access, 2 hex), span, value hash, where the value starts, whether it looks random."""

    def entry(t: str, found: tuple[int, int, int, int]) -> dict:
        kind, start, end, at = found
        value = t[at:end]
        return {"kind": kind, "start": start, "end": end, "value": hashlib.sha256(value.encode()).digest()[:16], "value_start": at, "random": looks_random(value)}

    def make():
        def call(column: pa.Array) -> list[pa.Array]:
            return [pa.array([[entry(t, f) for f in candidates(t)] for t in texts_of(column)], SPANS_ARROW)]

        return call

    return with_arrow(docs, [text], [T.StructField("candidates", T.ArrayType(SPAN))], make, keep)


def ownership(rows: DataFrame, repository: str, owner: str) -> DataFrame:
    """value, n_repositories, n_owners over all candidates, each different one once."""
    each = rows.select(F.col(repository).alias("r"), F.col(owner).alias("o"), F.explode(F.array_distinct(F.expr("transform(candidates, c -> c.value)"))).alias("value"))
    return each.groupBy("value").agg(F.count_distinct("r").alias("n_repositories"), F.count_distinct("o").alias("n_owners"))


def judged(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """doc_id, candidates and ``added``: kind (3 live, 4 copied), start and end of the values judged so."""
    keep = list(dict.fromkeys(["doc_id", repository, owner]))
    rows = scan(docs.select(*keep, "text").withColumn("\x01h", F.xxhash64("text")), keep=[*keep, "\x01h"])
    rows = materialized(rows, "secrets")  # spans only, no texts
    counts = ownership(rows.where(F.size("candidates") > 0), repository, owner)
    many = (F.col("n_owners") >= MANY_OWNERS) | (F.col("n_repositories") >= MANY_REPOSITORIES)
    verdicts = counts.select(F.col("value").alias("v"), F.when(many, 4).otherwise(3).alias("verdict"))
    each = rows.select("doc_id", "\x01h", F.explode("candidates").alias("c")).withColumn("v", F.col("c.value"))
    hits = each.join(verdicts, "v").where("verdict = 4 or c.random")
    added = hits.select("doc_id", "\x01h", F.struct(F.col("verdict").alias("kind"), F.col("c.value_start").alias("start"), F.col("c.end").alias("end")).alias("s"))
    added = added.groupBy("doc_id", "\x01h").agg(F.sort_array(F.collect_set("s")).alias("added"))
    added = added.select(F.col("doc_id").alias("\x01d"), F.col("\x01h").alias("\x01g"), "added")
    same = F.col("doc_id").eqNullSafe(F.col("\x01d")) & F.col("\x01h").eqNullSafe(F.col("\x01g"))
    return rows.join(added, same, "left").select("doc_id", "candidates", "added")


def joined(spans):
    """kind:start:end by start, then kind, joined by commas, from an array of kind, start and end."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(in_order, lambda s: F.concat_ws(":", F.get(F.expr(names), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
