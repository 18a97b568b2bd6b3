"""Benchmark decontamination: Wu-Manber search of benchmark windows in document words.

Words are the symbols. The windows of all items are the patterns; they have one
length, but for items with fewer words, which are patterns of their own lengths.
For each length there is a shift table over blocks of two words: how far the
search may move on when that block ends at its place. Blocks that are in no
pattern allow the most. Where the shift is zero, the block picks a bucket, the
pattern's first block picks within it, and a direct comparison confirms.

Items are read in blocks of bounded bytes. A block's items go to the executors
once, where each worker process builds its tables once. A block that isn't the last
writes its finds, by the hash of the text; the last one merges all of them into its
own. So neither the driver nor an executor holds more than one block of items, no text
is ever written, and with a single block, the usual case, nothing is.

Results at the edges: a null or empty text has no words and is clean; items that
are null or have no words match nothing; item_ids are told as strings and a null
item_id is left out; equal documents get equal rows; a very long text is searched whole,
as one list of words; an empty benchmark leaves all clean, and an empty table stays empty. The result columns replace input columns of the same names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetspark.llm.common import materialized, quoted, texts_of, with_arrow, without

#: Bytes of UTF-8 text: digits, lower-case letters and all beyond ASCII are in words; A-Z are lower-cased; the rest separates.
WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
BLOCK_BYTES = 16 << 20


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


class Patterns:
    """Shift table and buckets for the patterns of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.shift: dict = {}
        self.buckets: dict = {}

    def key(self, symbols: list, end: int):
        """The block whose last word is at ``end``."""
        return (symbols[end - 1], symbols[end]) if self.block == 2 else symbols[end]

    def add(self, pattern: tuple, item: str) -> None:
        m = self.length
        for end in range(self.block - 1, m):
            k = self.key(pattern, end)
            self.shift[k] = min(self.shift.get(k, m), m - 1 - end)
        first = self.buckets.setdefault(self.key(pattern, m - 1), {}).setdefault(self.key(pattern, self.block - 1), {})
        owners = first.setdefault(pattern, [])
        if item not in owners:
            owners.append(item)

    def search(self, symbols: list) -> Iterator[tuple[int, list[str]]]:
        """Where patterns begin, and the items that have them."""
        m, n = self.length, len(symbols)
        most = m - self.block + 1
        shift, buckets, lead = self.shift.get, self.buckets, self.block - 1
        pair = self.block == 2
        end = m - 1
        while end < n:
            k = (symbols[end - 1], symbols[end]) if pair else symbols[end]
            move = shift(k, most)
            if move:
                end += move
                continue
            start = end - m + 1
            for pattern, items in buckets[k].get(self.key(symbols, start + lead), {}).items():
                if pattern == tuple(symbols[start : end + 1]):
                    yield start, items
            end += 1


def build(items: list[tuple[str, str]], window: int) -> list[Patterns]:
    by_length: dict[int, Patterns] = {}
    for item, text in items:
        symbols = words(text)
        size = min(window, len(symbols))
        for i in range(len(symbols) - size + 1 if size else 0):
            by_length.setdefault(size, Patterns(size)).add(tuple(symbols[i : i + size]), item)
    return list(by_length.values())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
FOUND = ["hit_spans", "items"]
BROADCAST_FINDS = 500_000  # spans and items of about 20 bytes
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def item_blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r.i, r.t))
        size += len(r.t.encode())
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, hit_spans (ranges of word places inside any occurrence) and items (sorted).

    ``keep`` names the columns that stay (all of them if not given).
    """
    keep = without(docs.columns if keep is None else keep, [f.name for f in FIELDS])
    hidden = {c: f"\x04{i}" for i, c in enumerate(dict.fromkeys([*keep, text]))}
    out = docs.select(*[F.col(quoted(c)).alias(h) for c, h in hidden.items()])
    own = F.unhex(F.md5(F.col(hidden[text]).cast("string")))
    found, held = [], []
    for block in item_blocks(benchmark, block_bytes):
        if held:
            # what a block finds hangs on the text alone, so it is kept by the text's hash; texts are never written
            part = find_block(out.select(hidden[text], own.alias("hash")), held, hidden[text], window, ["hash"])
            part = part.where(F.size("items") > 0).select("hash", *FOUND).dropDuplicates(["hash"])
            found.append(materialized(part, "decontaminate"))
        held = block
    if found:
        # at most one row a block for each text
        sums = reduce(DataFrame.unionByName, found).groupBy("hash").agg(*[F.flatten(F.collect_list(c)).alias(f"\x05{c}") for c in FOUND])
        sums = materialized(sums.withColumnRenamed("hash", "\x05hash"), "decontaminate")
        entries = sums.agg(F.sum(sum((F.size(f"\x05{c}") for c in FOUND), F.lit(1)))).first()[0] or 0
        if entries <= BROADCAST_FINDS:
            sums = F.broadcast(sums)
        out = out.join(sums, own == F.col("\x05hash"), "left")
    out = find_block(out, held, hidden[text], window, list(hidden.values()), [f"\x05{c}" for c in FOUND] if found else [])
    return out.select(*[F.col(hidden[c]).alias(c) for c in keep], *[f.name for f in FIELDS])


#: The tables of the block at hand, by its name: one in each worker process, for all its tasks.
_built: dict[str, list[Patterns]] = {}


def built(name: str, block: list[tuple[str, str]], window: int) -> list[Patterns]:
    if name not in _built:
        _built.clear()
        _built[name] = build(block, window)
    return _built[name]


def find_block(docs: DataFrame, block: list[tuple[str, str]], text: str, window: int, keep: list[str], earlier: list[str] = []) -> DataFrame:  # noqa: B006
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most the block's bytes and one text more
    name = uuid.uuid4().hex

    def make():
        patterns = built(name, shared.value, window)

        def call(column: pa.Array, *before: pa.Array) -> list[pa.Array]:
            counts, all_spans, all_items = [], [], []
            known = zip(*(b.to_pylist() for b in before), strict=True) if before else None
            for t in texts_of(column):
                symbols = words(t)
                spans, items = [], set()
                for p in patterns:
                    for start, owners in p.search(symbols):
                        spans.append((start, start + p.length))
                        items.update(owners)
                if known is not None:
                    old_spans, old_items = next(known)
                    spans += [(s["start"], s["end"]) for s in old_spans or []]
                    items.update(old_items or [])
                counts.append(len(symbols))
                all_spans.append([{"start": a, "end": b} for a, b in merged(spans)])
                all_items.append(sorted(items))
            return [pa.array(counts, pa.int64()), pa.array(all_spans, SPANS_ARROW), pa.array(all_items, pa.list_(pa.string()))]

        return call

    return with_arrow(docs, [text, *earlier], FIELDS, make, keep)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns only."""
    held = docs.select(*[F.col(quoted(c)).alias(f"\x02{i}") for i, c in enumerate(docs.columns)])
    found = find_benchmark(held, benchmark, f"\x02{docs.columns.index('text')}", window)
    clean = found.where(F.size("hit_spans") == 0)
    return clean.select(*[F.col(f"\x02{i}").alias(c) for i, c in enumerate(docs.columns)])


def hit_count(spans):
    """The words inside the spans, as a column."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def brute_force(text: str | None, items: list[tuple[str, str]], window: int = 10) -> tuple[int, int, list[str]]:
    """Words, hit words and items of one text by comparing at every place; for tests."""
    symbols = words(text)
    hit, found = np.zeros(len(symbols), bool), set()
    for item, t in items:
        w = words(t)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for j in range(len(symbols) - size + 1):
                if symbols[j : j + size] == w[i : i + size]:
                    hit[j : j + size] = True
                    found.add(item)
    return len(symbols), int(hit.sum()), sorted(found)
