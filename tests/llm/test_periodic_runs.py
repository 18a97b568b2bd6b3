"""Periodic runs against a search of every period, and at their edges."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sheetspark.llm import periodic_runs
from sheetspark.llm.queries import queries


def brute(w, least_words=24, least_periods=3):
    """start, length and smallest period of each maximal run."""
    found = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_words, least_periods * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def planted(rng, n, kinds):
    w = [rng.randrange(kinds) for _ in range(n)]
    if n > 6 and rng.random() < 0.7:
        p, a = rng.randint(1, 6), rng.randrange(n - 6)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("least", [(2, 2), (6, 2), (8, 3), (24, 3)])
def test_runs_are_those_of_every_period(least):
    rng = random.Random(sum(least))
    for _ in range(250):
        docs = [planted(rng, rng.randint(0, 70), rng.choice([1, 2, 3, 5, 9])) for _ in range(rng.randint(1, 5))]
        got = periodic_runs.find_runs([np.array(d, np.int64) for d in docs], *least).tolist()
        assert got == [[k, *r] for k, d in enumerate(docs) for r in brute(d, *least)]


def test_known_words():
    fib = [0], [0, 1]
    while len(fib[1]) < 400:
        fib = fib[1], fib[1] + fib[0]
    for w in (fib[1], [0] * 500, [0, 1] * 100 + [2] + [1, 0] * 80, [0, 0, 1] * 9 + [0, 0, 2] * 9):
        assert periodic_runs.find_runs([np.array(w)], 2, 2).tolist() == [[0, *r] for r in brute(w, 2, 2)]


def test_leaves_in_several_pieces(monkeypatch):
    monkeypatch.setattr(periodic_runs, "WORK_WORDS", 3)
    rng = random.Random(4)
    w = planted(rng, 300, 2)
    assert periodic_runs.find_runs([np.array(w)], 2, 2).tolist() == [[0, *r] for r in brute(w, 2, 2)]


def test_query(spark, sf):
    rows = {r["doc_id"]: r for r in queries()["op13_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    any_run = 0
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 4000:
            continue
        runs, got = brute(w), rows[d["doc_id"]]
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        assert got["n_runs"] == len(runs) and (got["start"], got["length"], got["period"]) == (best or (None,) * 3)
        assert got["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert got["runs_sha256"] == hashlib.sha256("".join(f"{s},{x},{p}\n" for s, x, p in runs).encode()).hexdigest()
        gone = {i for s, x, p in runs for i in range(s + p, s + x)}
        assert got["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        any_run += bool(runs)
    assert any_run > 10


def test_at_the_edges(spark):
    long = "x " * 30_000 + "y"
    texts = [None, "", " \x0b\x0c\r\n", "a b " * 20 + "c", "a b " * 20 + "c", long, "one two three", "a\xa0b c\x1cd " * 12, "\x85 é " * 12]
    df = spark.createDataFrame([(k if k % 2 else None, t, "z", 5) for k, t in enumerate(texts)], "doc_id long, text string, runs string, `a.b` int")
    out = periodic_runs.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "a.b", "n_words", "runs", "collapsed"]
    got = {r["text"]: r for r in out.collect()}
    assert out.count() == len(texts) and all(got[t]["n_words"] == 0 and got[t]["runs"] == [] and got[t]["collapsed"] == "" for t in texts[:3])
    assert [tuple(r) for r in got[texts[3]]["runs"]] == [(0, 40, 2)] and got[texts[3]]["collapsed"] == "a b c"
    assert [tuple(r) for r in got[long]["runs"]] == [(0, 30_000, 1)] and got[long]["collapsed"] == "x y"
    assert got[texts[6]]["runs"] == [] and got[texts[6]]["collapsed"] == texts[6]
    assert [tuple(r) for r in got[texts[7]]["runs"]] == [(0, 24, 2)] and [tuple(r) for r in got[texts[8]]["runs"]] == [(0, 24, 2)]
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    backwards = periodic_runs.periodic_runs(df.where("text like 'one%'"), key="doc_id", reading=lambda _, n: np.arange(n)[::-1])
    assert backwards.first()["collapsed"] == "three two one"
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs.periodic_runs(df, least_periods=1)
