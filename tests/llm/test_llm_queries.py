"""The registered queries on a small scale, and the pipeline by its stages."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers as P
from sheetspark.llm import byte_bpe, decontaminate
from sheetspark.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(name, spark, sf, duck, same):
    same(queries()[name](spark, sf), duck.sql(oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_has_a_row_a_document(name, spark, sf):
    n = queries()[name](spark, sf).count()
    assert n == spark.read.parquet(f"{sf}/documents.parquet").count() or name == "op10_token_counts" and n > 10


def texts_of(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_op1_columns_against_the_library(spark, sf):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {r["doc_id"]: r for r in queries()["op1_token_records"](spark, sf).collect()}
    for i, t in sorted(texts_of(spark, sf).items()):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op3_columns_and_held_out_accuracy(spark, sf):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries()["op3_language_id"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    told = [(r["lang_pred"], langs[r["doc_id"]]) for r in rows if r["held_out"] and langs[r["doc_id"]]]
    assert sum(a == b for a, b in told) >= 0.97 * len(told) and len(told) > 20


def test_op5_columns_against_the_library(spark, sf):
    engine = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: r for r in queries()["op5_byte_bpe"](spark, sf).collect()}
    for i, t in texts_of(spark, sf).items():
        ids = engine.encode_ordinary(t)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_ranges_of_bytes_by_offsets(spark):
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    texts = ["Plain words, naïve é 😀 and more.", "", None, "x" * 300]
    spans = [(0, 5), (3, 3), (7, 1000), (-4, 9), (12, 20), (999, 1005), (None, 3)]
    rows = spark.createDataFrame([(k, t, a, b) for k, t in enumerate(texts) for a, b in spans], "doc_id long, text string, a int, b int")
    for r in byte_bpe.decode_range(byte_bpe.encode(rows, ranks), ranks, "a", "b").collect():
        want = None if r["a"] is None else (r["text"] or "").encode()[max(r["a"], 0) : max(r["b"], 0)]
        assert (r["decoded_range"] is None and want is None) or bytes(r["decoded_range"]) == want


def test_op6_columns_by_plain_patterns(spark, sf):
    got = {r["doc_id"]: r for r in queries()["op6_secret_scan"](spark, sf).collect()}
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for i, t in texts_of(spark, sf).items():
        spans = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0]))))
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_op7_columns(spark, sf):
    got, texts = {r["doc_id"]: r for r in queries()["op7_doc_fingerprint"](spark, sf).collect()}, texts_of(spark, sf)
    ids, prints = sorted(texts), {}
    for k, i in enumerate(ids):
        t, other = texts[i], ids[(k + 1) % len(ids)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + texts[other][:cut]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        if t == texts[other] and t:
            assert r["near_next"] == 1


def test_token_counts_of_all_and_of_distinct_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    engine = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    docs["n"] = [len(engine.encode_ordinary(t)) + 1 for t in docs["text"]]
    docs["first"] = ~docs.sort_values("doc_id").duplicated("text")
    want = {}
    for r in docs.itertuples():
        was = want.get((r.source, r.lang), (0, 0, 0, 0))
        want[r.source, r.lang] = tuple(a + b for a, b in zip(was, (1, r.n, int(r.first), r.n * r.first), strict=True))
    got = {(r["source"], r["lang"]): tuple(r)[3:] for r in queries()["op10_token_counts"](spark, sf).collect()}
    assert got == want


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        kept.append(out.cache())
    counts = [d.count() for d in kept]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(decontaminate.brute_force(r["text"], bench)[1] for r in kept[-1].collect())
    last = corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf).collect()
    assert len(last) == counts[-1] and all(r["round_trip"] for r in last)
    engine = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in kept[-1].collect()}
    assert all(r["token_ids"] == engine.encode_ordinary(texts[r["doc_id"]]) for r in last)


def test_pipeline_at_the_edges(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    known, unknown = [i for i in range(3, 60) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    text, other = "Some words that are here.\nAnd a line.", "Other words are there, too, and more of them."
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (2, "12 34", "en", "s", 5), (known, text, "en", "s", 1), (known, text, "en", "s", 1), (unknown, other, None, "s", None), (None, other, None, "s", 9)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        # columns with the names of results
        docs = docs.withColumns({c: F.lit(7) for c in ("score", "bits_per_byte", "N_LINES", "n_dropped", "items", "size", "a.b")})
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            docs = out
        kept = sorted((tuple(r) for r in docs.collect()), key=repr)
        # repeated rows share their lines' places, so they keep them, until one row of each group stays;
        # a null doc_id comes first, so its line stays and the later document has none left
        want = [(known, text, "en", "s", len(text), *[7] * 7), (None, other, "en", "s", len(other), *[7] * 7)]
        assert kept == (sorted(want, key=repr) if given else [])
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert len(last) == len(kept) and all(r["round_trip"] for r in last)
    untaught = spark.createDataFrame([(known, text, None, "s", 1)], schema)
    assert corpus_pipeline.identify_language(spark, untaught, sf).count() == 0


def test_token_offsets_reach_the_end(spark, sf, monkeypatch):
    docs = spark.createDataFrame([(1, "Some words", "en", "s", 10), (2, None, "en", "s", 0)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    engine = byte_bpe.loaded(P.path("byte_bpe_multi_50k.tiktoken"))
    for r in corpus_pipeline.encode(spark, docs, sf).collect():
        assert r["round_trip"] and r["token_offsets"] == engine.offsets(np.array(r["token_ids"], np.int32)).tolist()
    asked = []
    decode = byte_bpe.decode
    monkeypatch.setattr(byte_bpe, "decode", lambda *a, **k: asked.append(k.get("offsets")) or decode(*a, **k))
    queries()["op5_byte_bpe"](spark, sf)
    assert asked == ["token_offsets"]


def test_language_stage_drops_what_no_language_explains(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    schema = docs.schema
    more = [(10**9 + 1, "q8Zk2 xV9w! Jp0@Rt7", None, "s", 19), (10**9 + 2, "Zx9#" * 3000, None, "s", 12_000), (10**9 + 3, "½ ² ①", None, "s", 5)]
    out = corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(more, schema)), sf)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
