"""Self-join of documents by Jaccard similarity of their word n-grams, size-aware.

Small and large sets take different ways, and the boundary is where their costs
cross. A set's cost on the light way is the number of its subsets that a partner
may share, all enumerated as keys; on the heavy way it is the number of its
inverted lists times a weight for scanning and verifying.

*Light*: two sets link exactly when they share a subset that is large enough, so
members of a key need no verification. Whoever links through a key also links with
its smallest member, so one link a member keeps all that is connected.

*Heavy*: linked sets differ in at most D elements, with D from the size class. The
elements are dealt by hash over D + 1 + s parts, so linked sets agree in s + 1
whole parts at least. A part's content is a key with an inverted list; a set leaves
out its smallest parts, which say little, while they are s at most. Lists are
scanned in two rounds. First each member is compared with the list's centre, the
member that shares most lists; groups of near copies fall together by one
comparison a member. Then, where a list still spans several components, members of
different ones are compared, in bounded blocks of the list, if their parity maps leave
room for a link: the bits in which the maps differ are a lower bound of the elements
in which the sets do. A map of 512 bits tells nothing of sets with thousands of
elements, so these have wide maps as well, of a bit an element, which are looked at
before any such set is fetched. Comparisons count the intersection exactly.

Sets that are equal are one class from the start, so copies cost nothing after.
Elements are 64-bit hashes of the words.

Results at the edges: a document with fewer words than n has one element, all its
words; one without words or text has none and links with nothing; equal rows are
equal sets; a very long text is hashed in pieces of ``TEXT_RUN`` bytes; a null doc_id
takes part but is never the smallest; other columns are ignored, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetspark.llm.common import ASCII_LOWER, Scratch, materialized, quoted, runs, small_batches, texts_of, tidy, with_arrow
from sheetspark.llm.components import components

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15 | 1
TEXT_RUN = 400_000
RATIO = 1.5  # of a size class
HEAVY_WEIGHT = 8
WIDE_FROM = 1000  # elements from which on a set has a wide map
LIST_BLOCK = 2000  # members of an open list that meet in one block
BROADCAST_IDS = 4_000_000  # 32 MB of ids
BROADCAST_ROWS = 1_000_000  # of about 40 bytes each


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@cache
def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, BASE, np.uint64))


def byte_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words of a stretch of bytes begin and end, and a sum over each one's bytes and their places."""
    blank = BLANKS[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        place = np.zeros(len(data), np.int64)
        place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
        table = powers(1 << max(10, int(place.max() + 1).bit_length()))
        values = np.where(blank, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * table[place])
        return starts, ends, np.add.reduceat(values, starts)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many words each text has."""
    parts = [t.encode().translate(ASCII_LOWER) for t in texts]
    if len(parts) == 1 and len(parts[0]) > 2 * TEXT_RUN:
        hashes = long_text(parts[0])
        return hashes, np.array([len(hashes)])
    starts, ends, sums = byte_sums(np.frombuffer(b" ".join(parts) + b" ", np.uint8))
    closes = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, closes))))
    with np.errstate(over="ignore"):
        return mix(sums + (ends - starts).astype(np.uint64)), counts


def long_text(data: bytes) -> np.ndarray:
    """The same for one text, piece by piece; a word that a cut divides is summed over its pieces."""
    out: list[np.ndarray] = []
    open_sum, open_size = np.zeros(1, np.uint64), 0
    with np.errstate(over="ignore"):
        for at in range(0, len(data), TEXT_RUN):
            piece = np.frombuffer(data, np.uint8, min(TEXT_RUN, len(data) - at), at)
            starts, ends, sums = byte_sums(piece)
            sizes = ends - starts
            if open_size and (not len(starts) or starts[0] > 0):
                out.append(mix(open_sum + np.uint64(open_size)))
                open_size = 0
            if open_size:
                sums[0] = (open_sum + sums[0] * np.uint64(pow(BASE, open_size, 1 << 64)))[0]
                sizes[0] += open_size
                open_size = 0
            if len(ends) and ends[-1] == len(piece):
                open_sum, open_size = sums[-1:].copy(), int(sizes[-1])
                sums, sizes = sums[:-1], sizes[:-1]
            out.append(mix(sums + sizes.astype(np.uint64)))
        if open_size:
            out.append(mix(open_sum + np.uint64(open_size)))
    return np.concatenate(out)


def element_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, ascending."""
    out: list[np.ndarray] = []
    for a, b in runs(texts, TEXT_RUN):
        hashes, counts = word_hashes(texts[a:b])
        grams = hashes.copy()
        with np.errstate(over="ignore"):
            for k in range(1, min(n, len(grams))):
                grams[: len(grams) - k] = mix(grams[: len(grams) - k] * np.uint64(31) + hashes[k:])
            at = 0
            for c in counts.tolist():
                if c >= n:
                    out.append(np.unique(grams[at : at + c - n + 1]))
                elif c:
                    whole = np.uint64(c)
                    for h in hashes[at : at + c]:
                        whole = mix(np.array([whole * np.uint64(31) + h], np.uint64))[0]
                    out.append(np.array([whole], np.uint64))
                else:
                    out.append(np.empty(0, np.uint64))
                at += c
    return out


class Plan:
    """Sizes, classes and keys for a similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        n = 1  # at a similarity of 1 there are only equal sets, and no keys
        while num < den and subsets(n, self.deletions(n)) <= HEAVY_WEIGHT * self.part_count(max(2, n)):
            n += 1
        self.light = n - 1  # the largest size that takes the light way
        self.floor = -(-num * (self.light + 1) // den)  # the smallest partner of a heavy set
        self.bounds = [max(1, self.floor)]

    def deletions(self, n: int) -> int:
        """The most elements that a set of this size has beyond a linked one."""
        return n * (self.den - self.num) // self.den

    def differing(self, high: int) -> int:
        """The most elements in which linked sets differ whose smaller one has ``high`` at most."""
        return high * (self.den - self.num) // self.num

    def part_count(self, high: int) -> int:
        return self.differing(high) + 1 + self.spare(high)

    def spare(self, high: int) -> int:
        return 3 + self.differing(high) // 3

    def size_class(self, n: int) -> int:
        while self.bounds[-1] <= n:
            low = self.bounds[-1]
            self.bounds.append(max(int(low * RATIO), -(-low * self.den // self.num) + 1))
        return int(np.searchsorted(self.bounds, n, side="right")) - 1

    def classes(self, n: int) -> list[int]:
        """The class of this size, and the one below if a smaller partner may be in it."""
        own = self.size_class(n)
        return [own] if own == 0 or self.num * n > self.den * (self.bounds[own] - 1) else [own, own - 1]

    def keys(self, elements: np.ndarray) -> tuple[list[int], list[int]]:
        """Keys of a set, and for each one the size of the subset that it names, 0 for a part."""
        n = len(elements)
        if self.num == self.den or not n:
            return [], []
        keys: list[int] = []
        sizes: list[int] = []
        with np.errstate(over="ignore"):
            spread = mix(elements + np.uint64(0xA5A5A5A5))
            if n <= self.light:
                total = int(spread.sum(dtype=np.uint64))
                own = spread.tolist()
                for d in range(self.deletions(n) + 1):
                    for gone in combinations(own, d):
                        keys.append((total - sum(gone)) & 0xFFFFFFFFFFFFFFFF)
                        sizes.append(n - d)
            if n >= self.floor:
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)))
                for k in self.classes(n):
                    self.size_class(self.bounds[k])
                    high = self.bounds[k + 1] - 1
                    m, spare = self.part_count(high), self.spare(high)
                    part = ((elements >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
                    cuts = np.searchsorted(part, np.arange(m + 1, dtype=np.uint64))
                    lengths = np.diff(cuts)
                    least = next((w for w in (4, 3, 2, 1) if (lengths < w).sum() <= spare), 0)
                    kept = np.flatnonzero(lengths >= least)
                    tag = mix(np.uint64(k << 32) + kept.astype(np.uint64) + np.uint64(1 << 60))
                    found = mix(sums[cuts[kept + 1]] - sums[cuts[kept]] + tag)
                    keys += found.tolist()
                    sizes += [0] * len(kept)
        if sizes and sizes[0]:
            heads = mix(np.array(keys, np.uint64) + np.array(sizes, np.uint64) * np.uint64(0x10001))
            keys = [int(h) if s else k for h, k, s in zip(heads.tolist(), keys, sizes, strict=True)]
        return keys, sizes


def subsets(n: int, most: int) -> int:
    return sum(comb(n, d) for d in range(most + 1))


@cache
def plan_of(num: int, den: int) -> Plan:
    return Plan(num, den)


def set_id(elements: np.ndarray) -> int:
    """64 bits that stand for a whole set."""
    with np.errstate(over="ignore"):
        a = mix(elements).sum(dtype=np.uint64)
        b = mix(elements ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64)
        return int(mix(np.array([a + mix(np.array([b], np.uint64))[0] + np.uint64(len(elements))], np.uint64)).view(np.int64)[0])


BITS = [f"b{k}" for k in range(8)]


def parities(elements: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the elements that hash to it.

    Two sets differ in as many elements, at least, as their maps differ in bits.
    """
    counts = np.bincount((elements & np.uint64(511)).astype(np.int64), minlength=512)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def wide_map(elements: np.ndarray) -> bytes | None:
    """The size of a large set and a parity map of at least a bit an element; as long as a power of two."""
    n = len(elements)
    if n <= WIDE_FROM:
        return None
    bits = 1 << (n - 1).bit_length()
    counts = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return n.to_bytes(8, "little") + np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def wide_room(a: bytes | None, b: bytes | None, num: int, den: int) -> bool:
    """The same as ``room`` by wide maps; a map folds to half its length by the parity of its halves."""
    if a is None or b is None:
        return True
    both = int.from_bytes(a[:8], "little") + int.from_bytes(b[:8], "little")
    x, y = (np.frombuffer(m, np.uint8, offset=8) for m in (a, b))
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    apart = int(np.bitwise_count(x ^ y).sum())
    return den * (both - apart) >= num * (both + apart)


def room(p: str, q: str, num: int, den: int) -> str:
    """Whether sizes and maps leave two sets room for a link, as SQL over two row names."""
    apart = " + ".join(f"bit_count({p}.{b} ^ {q}.{b})" for b in BITS)
    both = f"({p}.size + {q}.size)"
    return f"{den} * least({p}.size, {q}.size) >= {num} * greatest({p}.size, {q}.size) and {den} * ({both} - ({apart})) >= {num} * ({both} + ({apart}))"


def with_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, th (a hash of the text), size, set_id, the parity map and the wide map of each document's set."""
    fields = [*[T.StructField(c, T.LongType()) for c in ("size", "set_id", *BITS)], T.StructField("wide", T.BinaryType())]

    def make():
        def call(column: pa.Array) -> list[pa.Array]:
            sets = element_sets(texts_of(column), n)
            maps = np.array([parities(s) for s in sets], np.int64).reshape(len(sets), len(BITS))
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), *[pa.array(maps[:, k].copy()) for k in range(len(BITS))], pa.array([wide_map(s) for s in sets], pa.binary())]

        return call

    return with_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), ["text"], fields, make, ["doc_id", "th"])


def key_rows(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """key, of (size of the subset that it names, 0 for a part), set_id and size; equal sets of a task are told once."""

    def run(batches):
        plan, seen = plan_of(num, den), set()
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in runs(texts, TEXT_RUN):
                keys, of, ids, sizes = [], [], [], []
                for s in element_sets(texts[a:b], n):
                    i = set_id(s)
                    if len(s) and i not in seen:
                        seen.add(i)
                        k, o = plan.keys(s)
                        keys.append(np.array(k, np.uint64))
                        of += o
                        ids.append(np.full(len(k), i, np.int64))
                        sizes.append(np.full(len(k), len(s), np.int32))
                if of:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(of, pa.int32()), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes))],
                        names=["key", "of", "set_id", "size"],
                    )
        tidy()

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "key long, of int, set_id long, size int")


def elements_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """set_id and elements (packed, ascending) of the sets in ``wanted`` (set_id, first_doc)."""
    ids = wanted.select(F.col("first_doc").alias("w")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("w")), "left_semi")
    fields = [T.StructField("set_id", T.LongType()), T.StructField("elements", T.BinaryType())]

    def make():
        def call(column: pa.Array) -> list[pa.Array]:
            sets = element_sets(texts_of(column), n)
            return [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]

        return call

    found = with_arrow(rows, ["text"], fields, make, [])
    return found.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"])


def verified(pairs: DataFrame, elements: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by their exact intersection."""
    left = elements.select(F.col("set_id").alias("a"), F.col("elements").alias("x"))
    right = elements.select(F.col("set_id").alias("b"), F.col("elements").alias("y"))
    both = pairs.join(left, "a").join(right, "b")

    def make():
        def call(x: pa.Array, y: pa.Array) -> list[pa.Array]:
            out = []
            for p, q in zip(x, y, strict=True):
                s, t = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                at = np.searchsorted(s, t)
                at[at == len(s)] = 0
                common = int((s[at] == t).sum())
                out.append(den * common >= num * (len(s) + len(t) - common))
            return [pa.array(out, pa.bool_())]

        return call

    return with_arrow(both, ["x", "y"], [T.StructField("linked", T.BooleanType())], make, ["a", "b"]).where("linked").select("a", "b")


def with_room(pairs: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) but for those of large sets whose wide maps (set_id, wide) leave no room for a link."""
    left, right = (wide.select(F.col("set_id").alias(k), F.col("wide").alias(w)) for k, w in (("a", "x"), ("b", "y")))
    # a pair of which only one is large has no map to compare, so all others stay as they are
    large = pairs.join(wide.select(F.col("set_id").alias("a")), "a", "left_semi").join(wide.select(F.col("set_id").alias("b")), "b", "left_semi")
    small = pairs.join(large, ["a", "b"], "left_anti")

    def make():
        def call(x: pa.Array, y: pa.Array) -> list[pa.Array]:
            return [pa.array([wide_room(p, q, num, den) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())]

        return call

    tried = with_arrow(large.join(left, "a").join(right, "b"), ["x", "y"], [T.StructField("room", T.BooleanType())], make, ["a", "b"])
    return small.select("a", "b").unionByName(tried.where("room").select("a", "b"))


def shared_lists(keys: DataFrame) -> DataFrame:
    """The rows of keys that several sets have, with df, about how many."""
    dealt = keys.repartition("key")  # the one shuffle of all keys: counting and picking both use it
    several = dealt.groupBy("key").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y"), F.count("*").alias("df"), F.max("of").alias("o"), F.max("size").alias("z"))
    several = several.where("x <> y and o is not null and z is not null").select("key", "df")
    return dealt.join(several, "key").distinct()


def near_sets(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Returns doc_id, th (a hash of the text), size (of the set), set_id, component and component_id, a row for each row of ``docs``.

    component_id is the smallest doc_id that links reach, a document's own included; component tells components
    apart even where doc_ids repeat or are null, and is null for a document without words.
    """
    docs = docs.select("doc_id", "text")
    with Scratch(docs.sparkSession) as scratch:
        return materialized(linked(docs, n, num, den, scratch), "ngram-components")


def linked(docs: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    table = scratch.table
    sets = table(with_sets(docs, n), "sets")
    classes = table(sets.where("size > 0").groupBy("set_id", "size").agg(F.min("doc_id").alias("first_doc"), *[F.max(b).alias(b) for b in BITS]), "classes")
    maps = classes.select("set_id", *BITS)

    def ends_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs that link. Sets are fetched for what the maps have left, and no others."""
        wide = table(sets.where("wide is not null").select("set_id", "wide").join(ends_of(pairs), "set_id", "left_semi").dropDuplicates(["set_id"]), "wide")
        pairs = table(with_room(pairs, wide, num, den), "near")
        wanted = table(classes.join(ends_of(pairs), "set_id", "left_semi").select("set_id", "first_doc"), "wanted")
        return verified(pairs, table(elements_of(docs, wanted, n), "elements"), num, den)

    keys = table(shared_lists(key_rows(docs, n, num, den)), "lists")
    light = keys.where("of > 0")
    ends = light.groupBy("key").agg(F.min(F.struct("size", "set_id")).alias("m"))
    stars = light.join(ends, "key").where(f"{den} * of >= {num} * (size + m.size - of) and set_id <> m.set_id")
    links = stars.select(F.col("set_id").alias("a"), F.col("m.set_id").alias("b")).distinct()

    lists = keys.where("of = 0").drop("of")
    score = lists.groupBy("set_id").agg(F.sum("df").alias("score"))
    centres = lists.join(score, "set_id").groupBy("key").agg(F.max(F.struct("score", "set_id", "size")).alias("c"))
    sized = f"{den} * least(size, c.size) >= {num} * greatest(size, c.size)"
    first = lists.join(centres, "key").where(f"set_id <> c.set_id and {sized}")
    first = first.select("set_id", "size", F.col("c.set_id").alias("c_id"), F.col("c.size").alias("c_size")).distinct()
    # the maps rule most others out before any set is fetched
    p = first.join(maps, "set_id").alias("p")
    q = maps.select(F.col("set_id").alias("c_id"), *BITS).alias("q")
    tried = p.join(q, F.expr("p.c_id = q.c_id")).where(room("p", "q", num, den).replace("q.size", "p.c_size"))
    first = table(tried.select(F.least("p.set_id", "p.c_id").alias("a"), F.greatest("p.set_id", "p.c_id").alias("b")).distinct(), "pairs")
    links = table(links.unionByName(checked(first)), "linked")
    groups = components(links, scratch)

    second = open_pairs(lists, groups, maps, num, den, scratch)
    second = table(second.join(first, ["a", "b"], "left_anti"), "pairs")
    more = None if second.isEmpty() else table(checked(second), "linked")
    if more is not None and not more.isEmpty():
        groups = components(links.unionByName(more), scratch)
    named = classes.join(groups.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = named.withColumn("component", F.coalesce("component", "set_id"))
    least = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = named.join(least, "component").select("set_id", "component", "component_id")
    rows = sets.join(named, "set_id", "left")
    return rows.select("doc_id", "th", "size", "set_id", "component", F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def open_pairs(lists: DataFrame, groups: DataFrame, maps: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of sets in different components that share a list and whose maps leave room for a link.

    A long list is cut into blocks of about ``LIST_BLOCK`` members; each pair of blocks meets on its own,
    in whatever task.
    """
    placed = lists.join(groups.withColumnRenamed("node", "set_id"), "set_id", "left")
    placed = placed.select("key", "set_id", "size", F.coalesce("component", "set_id").alias("component"))
    spans = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
    spans = spans.where("x <> y").select("key", F.expr(f"cast((n + {LIST_BLOCK - 1}) div {LIST_BLOCK} as int)").alias("blocks"))
    own = scratch.table(placed.join(spans, "key").join(maps, "set_id"), "open").withColumn("block", F.expr("cast(pmod(xxhash64(set_id), blocks) as int)"))
    # of two blocks the lower meets the higher, and each meets itself
    p = own.withColumn("other", F.explode(F.expr("sequence(block, blocks - 1)"))).alias("p")
    q = own.withColumn("other", F.explode(F.expr("sequence(0, block)"))).alias("q")
    meet = "p.key = q.key and p.other = q.block and p.block = q.other and p.component <> q.component and (p.block <> q.block or p.component < q.component)"
    pairs = p.join(q, F.expr(f"{meet} and {room('p', 'q', num, den)}"))
    return pairs.select(F.least("p.set_id", "q.set_id").alias("a"), F.greatest("p.set_id", "q.set_id").alias("b")).distinct()


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component: that with the smallest doc_id (null last, then by a hash of the text), of several such rows any one.

    Documents without words are in no component and stay. Rows are told apart by doc_id and text, so a
    doc_id that several texts have, or none, does no harm.
    """
    found = near_sets(docs, n, num, den).where("component is not null")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    best = found.groupBy("component").agg(F.min(own).alias("best"), F.count("*").alias("rows"))
    rows = found.groupBy("component", "doc_id", "th").agg(F.count("*").alias("own")).join(best.where("rows > 1"), "component")
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th"))
    marked = rows.withColumn("is_best", is_best).where("not is_best or own > 1")
    marked = materialized(marked.select(F.col("doc_id").alias("\x01d"), F.col("th").alias("\x01h"), F.col("is_best").alias("\x01b")), "ngram-marked")
    counts = marked.groupBy("\x01b").count().collect()  # two rows at most
    if sum(r["count"] for r in counts) <= BROADCAST_ROWS:
        marked = F.broadcast(marked)
    out = docs.withColumn("\x01t", F.xxhash64("text"))
    out = out.join(marked, F.col("doc_id").eqNullSafe(F.col("\x01d")) & (F.col("\x01t") == F.col("\x01h")), "left").where("`\x01b` is null or `\x01b`")
    columns = [F.col(quoted(c)) for c in docs.columns]
    if not any(r["\x01b"] for r in counts):
        return out.select(*columns)
    # rows that are equal in doc_id and text, of a document that stays
    single, several = out.where("`\x01b` is null"), out.where("`\x01b`")
    return single.select(*columns).unionByName(several.dropDuplicates(["\x01d", "\x01h"]).select(*columns))
