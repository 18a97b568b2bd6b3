"""Embedding whitening: a covariance in double-double, its eigenvectors, and every vector along them at unit variance.

Entries become whole numbers, ``floor(64 * c) + 1000000``, so that the mean is far larger
than the spread: sums of squares in plain doubles would lose what is looked for. Instead
the mean is exact (whole sums), vectors are centred first, and the outer products of the
centred vectors are added as pairs of doubles by error-free sums and products. A task keeps
one pair of triangles; the triangles of tasks merge in two rounds, high and low parts
together, in the order of the tasks. The eigenvectors are LAPACK's ``dsyevd``: reduction to
a tridiagonal matrix, then divide and conquer. The finished transform is measured over all
vectors once more: ``identity_error`` is how far their covariance is from the identity.

What goes to the driver is one triangle and one sum a dimension, whatever the number of
rows; at most ``MOST_DIMENSIONS`` dimensions are taken, more are an error.

Results at the edges: a row whose vector is null, or holds a null, a value that isn't
finite or one of 2^46 or more, is in neither the fit nor the result; so are vectors that
haven't the most frequent length (of equally frequent ones the longest counts), and empty ones; equal rows count
each; a direction without variance has an ``explained`` of 0 and null for ``whitened``; a deviation that a long can't hold is null; an empty
table gives an empty result. Columns besides the vector pass unchanged, but those that have the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetspark.llm.common import quoted, small_batches, tidy, with_arrow, without

SCALE, SHIFT = 64, 1_000_000
#: Values below this stay exact as doubles when scaled and shifted.
MOST_VALUE = float(2**46)
MOST_DIMENSIONS = 8192
COMPONENTS = 32
#: Entries of a triangle in one piece, and of all rows of a piece that are multiplied at once.
TILE, WORK = 1 << 16, 1 << 17
#: Groups that triangles of tasks meet in before the last one.
FIRST_ROUND = 256
LIMB = 26
FIELDS = [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]


@dataclass
class Model:
    """What whitening needs: exact sums, the mean as a pair of doubles, and directions by falling variance."""

    n: int
    sums: list[int]
    mean: tuple[np.ndarray, np.ndarray]
    directions: np.ndarray  # a column each
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0
    useful: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) if u else 0.0 for e, u in zip(self.variances, self.useful, strict=True)]


# ---- pairs of doubles


def two_sum(a, b):
    """a + b and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a):
    """a as the sum of two numbers of 26 bits."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def pair_sum(a_high, a_low, b_high, b_low):
    s, e = two_sum(a_high, b_high)
    t, f = two_sum(a_low, b_low)
    e = e + t
    high = s + e
    e = e - (high - s) + f
    top = high + e
    return top, e - (top - high)


def outer_sums(high: np.ndarray, low: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums over rows of entry i times entry j, as pairs; the number of rows is a power of two."""
    a, b = halves(high)
    x, y = high[:, i], high[:, j]
    p = x * y
    ai, bi, aj, bj = a[:, i], b[:, i], a[:, j], b[:, j]
    e = ((ai * aj - p) + ai * bj + bi * aj) + bi * bj
    e += x * low[:, j] + low[:, i] * y
    while len(p) > 1:
        half = len(p) // 2
        p, e = pair_sum(p[:half], e[:half], p[half:], e[half:])
    return p[0], e[0]


# ---- over the table


def usable(vector: str) -> Column:
    c = F.col(quoted(vector))
    return F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < MOST_VALUE)), F.lit(False))


def whole_numbers(column: pa.Array, size: int | None = None) -> Iterator[np.ndarray]:
    """The vectors of a column as whole numbers, a matrix for each length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    for d in np.unique(lengths).tolist():
        if d and size in (None, d):
            starts = (ends - lengths)[lengths == d]
            yield np.floor(SCALE * flat[starts[:, None] + np.arange(d)]).astype(np.int64) + SHIFT


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]] | None:
    """How many vectors have the most frequent length, and their sum in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            for x in whole_numbers(batch.column(0)):
                own = seen.setdefault(x.shape[1], [0, 0, 0])
                own[0] += len(x)
                own[1] = own[1] + (x >> LIMB).sum(0)
                own[2] = own[2] + (x & ((1 << LIMB) - 1)).sum(0)
        for d, (n, high, low) in seen.items():
            at = np.arange(d, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(at), pa.array(np.full(d, n, np.int64)), pa.array(high), pa.array(low)], names=["d", "at", "n", "high", "low"])
        tidy()

    parts = vectors.mapInArrow(run, "d int, at int, n long, high long, low long")
    by = parts.groupBy("d", "at").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])
    row = by.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "high", "low"))).alias("sums")).orderBy(F.desc("n"), F.desc("d")).first()
    return row and (row["n"], [(s["high"] << LIMB) + s["low"] for s in row["sums"]])


def outer_products(vectors: DataFrame, dim: int, prepare: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """The sum over all vectors of the outer product of what ``prepare`` makes of them (high and low parts, ``width`` entries)."""
    i, j = np.triu_indices(width)
    tiles = [(a, min(a + TILE, len(i))) for a in range(0, len(i), TILE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [(np.zeros(b - a), np.zeros(b - a)) for a, b in tiles]
        any_row = False
        for batch in batches:
            for x in whole_numbers(batch.column(0), dim):
                any_row = True
                for k, (a, b) in enumerate(tiles):
                    rows = 1 << max(0, (WORK // (b - a)).bit_length() - 1)
                    for at in range(0, len(x), rows):
                        high, low = prepare(x[at : at + rows])
                        short = rows - len(high)
                        if short:
                            high, low = np.pad(high, ((0, short), (0, 0))), np.pad(low, ((0, short), (0, 0)))
                        total[k] = pair_sum(*total[k], *outer_sums(high, low, i[a:b], j[a:b]))
        if any_row:
            part = TaskContext.get().partitionId()
            for k, pair in enumerate(total):
                yield triangle(k, part, *pair)
        tidy()

    found = vectors.mapInArrow(run, TRIANGLE)
    for groups in (FIRST_ROUND, 1):
        found = merged(found, groups)
    out = np.zeros((width, width))
    for row in found.toLocalIterator():
        a, b = tiles[row["tile"]]
        out[i[a:b], j[a:b]] = out[j[a:b], i[a:b]] = np.array(row["high"]) + np.array(row["low"])
    return out


TRIANGLE = "tile int, part int, high array<double>, low array<double>"


def triangle(tile: int, part: int, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([part], pa.int32()), pa.array([high], pa.list_(pa.float64())), pa.array([low], pa.list_(pa.float64()))], names=["tile", "part", "high", "low"])


def merged(parts: DataFrame, groups: int) -> DataFrame:
    """One triangle for each tile and group of tasks; they come in the order of the tasks, so a rerun adds alike."""
    rows = parts.select("tile", F.expr(f"part % {groups}").alias("group"), "part", "high", "low")
    rows = rows.repartition("tile", "group").sortWithinPartitions("tile", "group", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pair = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                tile, group = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                given = [batch.column(c)[k].values.to_numpy() for c in (3, 4)]
                if own != (tile, group):
                    if own:
                        yield triangle(*own, *pair)
                    own, pair = (tile, group), given
                else:
                    pair = pair_sum(*pair, *given)
        if own:
            yield triangle(*own, *pair)

    return rows.mapInArrow(run, TRIANGLE)


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    s, e = two_sum(x.astype(np.float64), -mean[0])
    e = e - mean[1]
    high = s + e
    return high, e - (high - s)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """Mean and directions of all usable vectors, and how well they whiten; None where there is no vector."""
    small_batches(df.sparkSession)
    vectors = df.where(usable(vector)).select(F.col(quoted(vector)).alias("vector"))
    found = exact_sums(vectors)
    if found is None:
        return None
    n, sums = found
    d = len(sums)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; {MOST_DIMENSIONS} are the most")
    means = [Fraction(s, n) for s in sums]
    high = np.array([float(m) for m in means])
    mean = high, np.array([float(m - Fraction(h)) for m, h in zip(means, high.tolist(), strict=True)])
    covariance = outer_products(vectors, d, lambda x: centred(x, mean), d) / n
    values, directions = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, directions = values[order], directions[:, order]
    model = Model(n, sums, mean, directions, values, float(np.trace(covariance)))
    model.useful = values > d * np.finfo(float).eps * max(values.max(), 0.0)
    k = int(model.useful.sum())

    def measured(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.column_stack([whitened(x, model), np.ones(len(x))])
        return y, np.zeros_like(y)

    if k:
        sums_of = outer_products(vectors, d, measured, k + 1) / n
        off = sums_of[:k, :k] - np.outer(sums_of[:k, k], sums_of[:k, k]) - np.eye(k)
        model.identity_error = float(np.abs(off).max())
    return model


def whitened(x: np.ndarray, model: Model) -> np.ndarray:
    """Vectors along the directions that have variance."""
    return centred(x, model.mean)[0] @ (model.directions[:, model.useful] / np.sqrt(model.variances[model.useful]))


def deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2, exactly."""
    n, far = model.n, max(map(abs, model.sums), default=0) + model.n * int(np.abs(x).max(initial=0))
    if far < 2**62 and (spread := int(np.abs(n * x - np.array(model.sums)).max(initial=0))) ** 2 * len(model.sums) < 2**63:
        return ((n * x - np.array(model.sums)) ** 2).sum(1).tolist() if spread else [0] * len(x)
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, model.sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(df: DataFrame, model: Model | None, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Adds deviation and whitened (a value for each component) to every usable row; the others go."""
    kept = df.columns if keep is None else keep
    if model is None:
        return df.where(F.lit(False)).select(*[quoted(c) for c in without(kept, [f.name for f in FIELDS])], *[F.lit(None).cast(f.dataType).alias(f.name) for f in FIELDS])
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a bounded number of dimensions

    def make():
        own = shared.value
        d, k = len(own.sums), len(own.variances)

        def call(column: pa.Array) -> list[pa.Array]:
            x = next(whole_numbers(column, d), np.zeros((0, d), np.int64))
            y = np.zeros((len(x), k))
            y[:, own.useful] = whitened(x, own)
            empty = np.broadcast_to(~own.useful, y.shape).ravel()
            values = pa.array(y.ravel(), mask=empty)
            return [pa.array(deviations(x, own), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), values)]

        return call

    rows = df.where(usable(vector) & (F.size(F.col(quoted(vector))) == len(model.sums)))
    return with_arrow(rows, [vector], FIELDS, make, keep)
