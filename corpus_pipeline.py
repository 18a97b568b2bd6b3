"""Documents to token ids: language ID, line dedup, near-duplicate removal, decontamination, byte-level BPE.

Each stage gets what its predecessor kept, read back from Parquet, and returns the
columns of ``documents``; the last returns token ids.

Results at the edges: a null or empty text, or one without letters, is in no language
and goes in the first stage; a null lang is filled in; of equal or near texts, lines that
came before go; of each group of near documents one row stays, be doc_ids repeated or null, and so of equal rows; columns
beyond those of ``documents`` pass unchanged, whatever their names, up to the last stage; a
very long text is a document like others; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetspark.llm import byte_bpe, decontaminate, language_id, line_dedup, ngram_join
from sheetspark.llm.common import materialized, quoted

#: Bits for each byte above which no language is taken to have written a text, whatever its length: words of a known
#: language cost two or three, a key or other random characters about sixteen, so about half of a text may be such.
MOST_BITS = 10.0
#: Characters from which on the pipeline takes lines to be near copies: in a line of few, one edit makes another word,
#: and a short document would go for being like another one.
NEAR_CHARS = 20


def alongside(docs: DataFrame, columns: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on some columns, with all others hidden under names that no result has; their own names come back after."""
    hidden = {c: f"\x03{i}" for i, c in enumerate(docs.columns) if c not in columns}
    out = work(docs.select(*[F.col(quoted(c)).alias(hidden.get(c, c)) for c in docs.columns]))
    return out.select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language: without letters, or too costly to code under every one. A null lang is filled in."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id")) | F.col("doc_id").isNull()).select("doc_id", "text", "lang"))

    def work(rows: DataFrame) -> DataFrame:
        found = language_id.identify(rows, model).where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MOST_BITS))
        return found.withColumn("lang", F.coalesce("lang", "lang_pred"))

    return alongside(docs, ["doc_id", "text", "lang"], work)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that an earlier line equals within one edit; documents of which nothing is left go."""

    def work(rows: DataFrame) -> DataFrame:
        found = line_dedup.dedup_lines(rows, NEAR_CHARS)
        left = found.where((F.col("n_dropped") == 0) | (line_dedup.trimmed(F.regexp_replace("text", "\n", " ")) != ""))
        return left.withColumn("n_chars", F.length("text").cast("long"))

    return alongside(docs, ["doc_id", "text", "n_chars"], work)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that Jaccard similarity of 0.8 on runs of five words links."""
    return ngram_join.one_of_each(docs, n=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which ten words in a row of a benchmark item occur."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids, token_offsets, n_tokens, and whether the ids decode to the text."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks)
    rows = byte_bpe.decode(rows, ranks, offsets="token_offsets")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return rows.select("doc_id", "lang", "source", "token_ids", "token_offsets", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Byte-level BPE can't be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
