"""Mixing sources: targets against a plain loop, tilts against a solver of their own, copies by what they must hold."""

import math
import re
from collections import defaultdict

import pytest

from sheetspark.llm import source_mix
from sheetspark.llm.queries import queries


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def wanted(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Dealt by weight; what a source has too much is dealt again, until none is over."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, free, rest = {}, list(names), share * sum(sizes.values())
    while free:
        unit = rest / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
            free.remove(s)
    return out


def check(rows, docs, most=2):
    """docs: (doc_id, text, source) with unique ids."""
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += words(t)
    targets, taken, by = wanted(dict(sizes)), defaultdict(int), {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    smallest = {}
    for i, t, s in docs:
        r = by[i]
        assert r["size"] == words(t) and r["source_size"] == sizes[s] and math.isclose(r["target"], targets[s], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r["taken"] <= most * r["size"] and r["taken"] % max(r["size"], 1) == 0
        taken[s] += r["taken"]
        if r["size"]:
            smallest[s] = min(smallest.get(s, r["size"]), r["size"])
    return targets, taken, smallest


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries()["op12_source_mix"](spark, sf).collect()
    targets, taken, smallest = check(rows, docs)
    assert all(abs(taken[s] - targets[s]) <= max(3.0, 0.02 * targets[s]) for s in targets)
    assert sorted(rows) == sorted(queries()["op12_source_mix"](spark, sf).collect())


@pytest.mark.parametrize("tilt", ["documents", "words"])
def test_rates_are_nearest_to_the_common_one(spark, tilt):
    """The tilt of each source solves its own equation, and rates follow it."""
    sizes = {"a": [3, 5, 9, 40, 41, 200], "b": [1000] * 30, "c": [1, 2] * 300, "": [7] * 10, None: [10, 30]}
    docs = [(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate((s, n) for s in sizes for n in sizes[s])]
    rows = source_mix.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), tilt=tilt).collect()
    targets, taken, smallest = check(rows, docs)
    for s, of in sizes.items():
        assert abs(taken[s] - targets[s]) <= smallest[s] / 2 + 1e-3 * targets[s]
        rates = {r["size"]: r["rate"] for r in rows if r["source"] == s}
        if targets[s] >= 2 * sum(of):
            assert set(rates.values()) == {2.0}
            continue
        scale = sum(n * n for n in of) / sum(of)
        tilted = lambda n, t: 2 / (1 + math.exp(-(math.log(3) + t * (n / scale if tilt == "documents" else 1))))  # noqa: B023, E731
        low, high = -500.0, 500.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * tilted(n, mid) for n in of) < targets[s] else (low, mid)
        assert all(math.isclose(rates[n], tilted(n, low), rel_tol=1e-4, abs_tol=1e-6) for n in rates)


def test_other_weights_and_hidden_names(spark):
    docs = [(k, " ".join(["w"] * (k % 13 + 1)), "xyz"[k % 3]) for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("doc_id", "text", "source", "7 as rate", "8 as `name`", "9 as chance", "1 as cell", "2 as `a.b`")
    out = source_mix.mix(df, weights=(1.0,), share=0.5, most_copies=3)
    assert out.columns == ["doc_id", "text", "source", "name", "chance", "cell", "a.b", *source_mix.RESULTS]
    rows = out.collect()
    assert {tuple(r[c] for c in ("name", "chance", "cell", "a.b")) for r in rows} == {(8, 9, 1, 2)}
    total = sum(r["size"] for r in rows)
    for s in "xyz":
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - total / 6) <= 1
    copies = source_mix.repeated(out)
    assert copies.count() == sum(r["copies"] for r in rows)
    with pytest.raises(ValueError, match="weights"):
        source_mix.mix(df, weights=(0.0,))
    with pytest.raises(ValueError, match="tilt"):
        source_mix.mix(df, tilt="lines")


def test_at_the_edges(spark):
    kind = "doc_id long, text string, source string"
    docs = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "x", None), (None, None, None), (2, "", "t"), (3, " \n\t", "t"), (4, "w " * 50_000, "u")]
    rows = source_mix.mix(spark.createDataFrame(docs, kind), keep=["doc_id", "source"]).collect()
    assert len(rows) == 7 and sorted(r["size"] for r in rows) == [0, 0, 0, 1, 3, 3, 50_000]
    assert {(r["source"], r["target"]) for r in rows} == {("s", 12.0), ("t", 0.0), (None, 2.0), ("u", 75_010.5 - 14)}
    assert all(r["taken"] <= 2 * r["size"] for r in rows) and sum(r["taken"] for r in rows if r["source"] == "s") == 12
    assert source_mix.mix(spark.createDataFrame([], kind)).count() == 0
    none = source_mix.mix(spark.createDataFrame([(1, None, "s"), (2, "", "s")], kind)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in none] == [(0, 0.0, 0)] * 2


def test_one_size_of_many_documents(spark):
    """A third of all rows in one class: each document gets the whole part or one more, and the class its total."""
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same words in each', concat_ws(' ', sequence(0, id % 50))) as text", "if(id % 2 = 0, 'a', 'b') as source")
    rows = source_mix.mix(docs, keep=["doc_id", "source"]).collect()
    for s in "ab":
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert len({r["copies"] for r in own if r["size"] == 4}) <= 2
