"""Language identification by prediction by partial matching (PPM).

For each language the bytes of training text give counts of symbols after contexts
of zero to ``max_order`` (at most three) bytes. A symbol that a context has seen costs
what its count says; one that it has not seen costs the context's escape and then what
the next shorter context says, down to 256 equal symbols (method C: the escape's count is
the number of distinct symbols). Statistics are frozen, so a symbol's exact code length
depends only on the three bytes before it.
The language with the shortest code of the whole text wins.

A tree is kept as sorted tables, one for each order: the code length of each symbol
that was seen after each context, and the escape of each context. Nothing that
training saw is left out, so the tables are as large as the training sample: whole
texts of at most about ``fit_docs`` documents of each language, chosen by a hash of
doc_id. That is the bound of the model, for any amount of data.

Results at the edges: null text, or text without letters, is ``und`` with score 0
and null bits; without training rows all is ``und``; ties go to the first language
in order of name; a document whose doc_id is null is not held out; equal rows get
equal results; a very long text is coded in pieces of ``TEXT_RUN`` bytes; an empty table
stays empty. Result columns replace input columns of the same names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetspark.llm.common import runs, texts_of, with_arrow

LETTER = re.compile(r"[^\W\d_]")  # and some signs that aren't letters, as fractions
ORDER = 3
FIT_DOCS = 2000
TEXT_RUN = 300_000
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]


@dataclass
class Tree:
    """The statistics of a language. A gram is a context and the symbol after it, the last byte lowest."""

    grams: list[np.ndarray]  # of each order, sorted
    cost: list[np.ndarray]  # bits of each gram
    contexts: list[np.ndarray]  # of each order, sorted
    escape: list[np.ndarray]  # bits of each context's escape


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_counts(sample: DataFrame) -> DataFrame:
    """Four-byte windows of each text after three zero bytes: lang, gram, n."""

    def count(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            by: dict[str, list[str]] = {}
            for lang, t in zip(langs, texts, strict=True):
                by.setdefault(lang, []).append(t)
            for lang, own in by.items():
                for a, b in runs(own, 4 * TEXT_RUN):
                    grams, counts = np.unique(windows(own[a:b])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts, pa.int64())],
                        names=["lang", "gram", "n"],
                    )

    return sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The four bytes that end at each byte of the texts, and where each text ends."""
    parts = [t.encode() for t in texts]
    return grams_of(b"\0\0\0" + b"\0\0\0".join(parts), [len(p) for p in parts]), np.cumsum([len(p) for p in parts])


def grams_of(data: bytes, sizes: list[int]) -> np.ndarray:
    """The four bytes that end at each byte of parts of these sizes, which stand in ``data`` behind three bytes each."""
    joined = np.frombuffer(data, np.uint8).astype(np.uint32)
    w = (joined[:-3] << 24) | (joined[1:-2] << 16) | (joined[2:-1] << 8) | joined[3:]
    if len(sizes) > 1:
        inside = np.ones(len(w), bool)
        cuts = np.cumsum(sizes[:-1]) + 3 * np.arange(len(sizes) - 1)
        for k in range(3):
            inside[cuts + k] = False
        w = w[inside]
    return w


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, max_order: int = ORDER) -> Model:
    """Learns from text and lang of ``docs`` (doc_id, text, lang), where neither is null."""
    if not 0 <= max_order <= ORDER:
        raise ValueError(f"contexts have 0 to {ORDER} bytes, not {max_order}")
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return Model([], [])
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, fit_docs / sizes[lang]))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    grams = gram_counts(rows.where(drawn)).toPandas()  # bounded with the sample
    if grams.empty:
        return Model([], [])
    of = dict(tuple(grams.groupby("lang")))
    langs = sorted(of)
    return Model(langs, [build(of[x]["gram"].to_numpy().astype(np.uint32), of[x]["n"].to_numpy().astype(np.float64), max_order) for x in langs])


def build(seen: np.ndarray, n: np.ndarray, max_order: int) -> Tree:
    """The tree of a language from its four-byte windows and their counts."""
    tree = Tree([], [], [], [])
    for k in range(max_order + 1):
        mask = np.uint32((1 << (8 * (k + 1))) - 1)
        grams, inverse = np.unique(seen & mask, return_inverse=True)
        counts = np.bincount(inverse, n)
        contexts, of = np.unique(grams >> np.uint32(8), return_inverse=True)
        kinds, total = np.bincount(of), np.bincount(of, counts)
        tree.grams.append(grams)
        tree.cost.append(-np.log2(counts / (total + kinds)[of]))
        tree.contexts.append(contexts)
        tree.escape.append(-np.log2(kinds / (total + kinds)))
    return tree


def found_in(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def costs(distinct: np.ndarray, tree: Tree) -> np.ndarray:
    """Bits of the last byte of each distinct four-byte window under a tree."""
    out = np.zeros(len(distinct))
    left = np.arange(len(distinct))
    for k in range(len(tree.grams) - 1, -1, -1):
        own = distinct[left] & np.uint32((1 << (8 * (k + 1))) - 1)
        at, ok = found_in(tree.grams[k], own)
        out[left[ok]] += tree.cost[k][at[ok]]
        left, own = left[~ok], own[~ok]
        at, ok = found_in(tree.contexts[k], own >> np.uint32(8))
        out[left[ok]] += tree.escape[k][at[ok]]  # an unseen context has no escape to pay for
    out[left] += 8.0
    return out


def pieces(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts with their windows and ends; a very long text comes in several pieces."""
    for a, b in runs(texts, TEXT_RUN):
        if b - a == 1 and len(texts[a]) > TEXT_RUN:
            data = b"\0\0\0" + texts[a].encode()
            for at in range(0, len(data) - 3, TEXT_RUN):
                part = data[at : at + TEXT_RUN + 3]
                yield a, b, grams_of(part, [len(part) - 3]), np.array([len(part) - 3])
        else:
            yield a, b, *windows(texts[a:b])


def code_lengths(texts: list[str], model: Model) -> np.ndarray:
    """Bits of each text under each language; all texts must have bytes."""
    out = np.zeros((len(texts), len(model.langs)))
    for a, b, w, ends in pieces(texts):
        distinct, inverse = np.unique(w, return_inverse=True)
        starts = np.concatenate(([0], ends[:-1]))
        for k, tree in enumerate(model.trees):
            out[a:b, k] += np.add.reduceat(costs(distinct, tree)[inverse], starts)
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and bits_per_byte (of the winner's code).

    The score is the winner's share when each language has a chance of two to the
    minus its code length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def call(column: pa.Array) -> list[pa.Array]:
            texts = texts_of(column)
            known = [i for i, t in enumerate(texts) if own.langs and has_letter(t)]
            pred, score, bits = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if known:
                some = [texts[i] for i in known]
                lengths = code_lengths(some, own)
                best = lengths.argmin(1)
                least = lengths.min(1)
                share = 1 / np.exp2(-np.minimum(lengths - least[:, None], 1000)).sum(1)
                for i, t, k, s, x in zip(known, some, best.tolist(), share.tolist(), least.tolist(), strict=True):
                    pred[i], score[i], bits[i] = own.langs[k], s, x / len(t.encode())
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())]

        return call

    return with_arrow(docs, [text], FIELDS, make, keep)
