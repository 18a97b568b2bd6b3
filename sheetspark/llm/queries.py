"""The registered queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetspark.llm import byte_bpe, chat_format, decontaminate, doc_fingerprint, language_id, line_dedup, ngram_join, periodic_runs, secret_scan, source_mix, token_records, token_rollup, whitening
from sheetspark.llm.common import fresh_path, materialized, with_arrow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "token-records")
    token_records.write_records(table(spark, sf_dir, "documents"), out, vocabulary("word_bpe_49k.json"), end_id=2)
    rows = token_records.read_records(spark, out)

    def make():
        def call(ids: pa.Array) -> list[pa.Array]:
            flat = np.asarray(ids.flatten(), "<u4")
            ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.concatenate(([0], ends[:-1]))
            return [pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())]

        return call

    return with_arrow(rows, ["ids"], [T.StructField("ids_crc32", T.LongType())], make, ["doc_id", "start", "n_tokens"])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    records = rows.unionByName(more).select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("record"))
    formatted = chat_format.format_turns(chat_format.canonical_turns(records))
    return chat_format.digests(materialized(formatted, "chat-formatted"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, keep=["doc_id"])
    both = byte_bpe.decode(ids, ranks, offsets="token_offsets")
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.judged(table(spark, sf_dir, "documents"))
    base = F.expr("transform(candidates, c -> struct(c.kind as kind, c.start as start, c.end as end))")
    count = lambda k: F.size(F.expr(f"filter(candidates, c -> c.kind = {k})")).cast("long")
    added = F.coalesce("added", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.concat(base, added)).alias("spans"),
    )


def op7_doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_fingerprint.compared(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"), window=10, keep=["doc_id"])
    hit = decontaminate.hit_count(F.col("hit_spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_sets(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    return token_rollup.corpus_totals(docs, ranks, "byte_bpe_multi_50k", fresh_path(spark, "token-rollup"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows, "embedding")
    found = whitening.whiten(rows, model, "embedding", keep=["vec_id"])
    n, explained, error = (model.n, model.explained, model.identity_error) if model else (0, [], 0.0)
    shares = F.array(*[F.lit(e) for e in explained]).cast("array<double>")
    found = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def planted_reading(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth document by hash is read with a period from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.periodic_runs(docs, key="doc_id", reading=planted_reading, keep=["doc_id"])
    better = "r.length * b.period > b.length * r.period"
    found = found.withColumn("best", F.expr(f"aggregate(runs, get(runs, 0), (b, r) -> if({better}, r, b))"))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_records": op1_token_records,
        "op2_line_dedup": op2_line_dedup,
        "op3_language_id": op3_language_id,
        "op4_chat_format": op4_chat_format,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_secret_scan": op6_secret_scan,
        "op7_doc_fingerprint": op7_doc_fingerprint,
        "op8_decontamination": op8_decontamination,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_token_counts": op10_token_counts,
        "op11_whitening": op11_whitening,
        "op12_source_mix": op12_source_mix,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op4_chat_format": OP4_SQL, "op8_decontamination": OP8_SQL, "op9_ngram_jaccard": OP9_SQL}


#: Escapes add a character for each control string, however many backslashes it has.
OP4_SQL = r"""
with c as (
    select conv_id, turn, role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
    select *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?INST\])')) as body, case when role = 'assistant' then 7 else 6 end as mark from c
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(3 + mark + length(role) + 1 + body + 4)::bigint as formatted_chars
from e group by conv_id
"""

#: Every run of words of a document that has the length of an item's window, looked up among the windows.
OP8_SQL = r"""
with dw as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents
), bw as (
    select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark
), windows as (
    select distinct item, least(10, len(w)) as size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as t
    from (select *, unnest(range(1, greatest(2, len(w) - 8))) as i from bw where len(w) > 0)
), places as (
    select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as t
    from (select *, unnest(range(1, len(w) - size + 2)) as i from dw, (select distinct size from windows) where len(w) >= size)
), hits as (
    select doc_id, item, i, p.size from places p join windows using (size, t)
), hit_words as (
    select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + size)) as k from hits) group by doc_id
), items as (
    select doc_id, count(*) as n, string_agg(item, ',' order by item) as l from (select distinct doc_id, item from hits) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(i.n, 0)::bigint as n_items, sha256(coalesce(i.l, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from dw left join hit_words h using (doc_id) left join items i using (doc_id)
"""

#: Every pair of documents that shares a shingle, counted out, and the transitive closure of its links.
OP9_SQL = r"""
with recursive dw as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
    select distinct doc_id, array_to_string(w[i : i + 2], ' ') as s from (select *, unnest(range(1, greatest(2, len(w) - 1))) as i from dw where len(w) > 0)
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
    select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
    where 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n) group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id
from dw left join sizes using (doc_id) left join (select a as doc_id, min(b) as m from reach group by a) using (doc_id)
"""


#: Every line against every earlier one of about its length, where a half is equal.
OP2_SQL = """
with cut as (
    select doc_id, generate_subscripts(l, 1) - 1 as no, unnest(l) as raw
    from (select doc_id, string_split(text, chr(10)) as l from documents)
), lines as (
    select doc_id, no, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as line from cut
), firsts as (
    select line, length(line) as n, min((doc_id, no)) as place from lines where line <> '' group by line
), sides as (
    select *, 'l' as side, left(line, (n // 2)::int) as half, (n // 2)::int as size from firsts
    union select *, 'l', left(line, ((n - 1) // 2)::int), ((n - 1) // 2)::int from firsts
    union select *, 'r', right(line, (n // 2)::int), (n // 2)::int from firsts
    union select *, 'r', right(line, ((n - 1) // 2)::int), ((n - 1) // 2)::int from firsts
), near as (
    select distinct a.line from sides a join sides b
    on a.side = b.side and a.half = b.half and b.place < a.place and abs(a.n - b.n) <= 1
    where levenshtein(a.line, b.line) <= 4 -- counts bytes, of which a character has four at most; then by characters
        and case when a.n = b.n then len([k for k in range(a.n) if left(a.line, k::int) = left(b.line, k::int) and right(a.line, (a.n - 1 - k)::int) = right(b.line, (a.n - 1 - k)::int)]) > 0
            else len([k for k in range(least(a.n, b.n) + 1) if left(a.line, k::int) = left(b.line, k::int) and right(a.line, (least(a.n, b.n) - k)::int) = right(b.line, (least(a.n, b.n) - k)::int)]) > 0 end
), kept as (
    select l.doc_id, l.no, l.raw, l.line = '' or (f.place = (l.doc_id, l.no) and l.line not in (select line from near)) as keep
    from lines l left join firsts f on l.line = f.line
)
select d.doc_id, coalesce(count(k.no), 0)::bigint as n_lines, coalesce(count(k.no) filter (where not keep), 0)::bigint as n_dropped,
    case when any_value(d.text) is not null then sha256(coalesce(string_agg(raw, chr(10) order by no) filter (where keep), '')) end as text_sha256
from documents d left join kept k on d.doc_id = k.doc_id group by d.doc_id
"""
