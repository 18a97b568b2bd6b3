"""Connected components of a link table, by alternating stars, on DataFrames.

Each round hangs every node's larger neighbours on the smallest node that it
knows, then every node's smaller neighbours likewise; the links end as one star a
component. Rounds grow with the logarithm of the size; nothing goes to the driver
but counts, and each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetspark.llm.common import Scratch

MAX_ROUNDS = 60


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """The nodes of ``links`` (two long columns) with ``component``, the smallest node reachable.

    Self links and null ends are ignored, repeated links count once, and an empty
    table gives an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` <> `{b}`").distinct()
    edges = scratch.table(edges, "links")
    state = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = scratch.table(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if found == state:
            break
        state = found
    else:
        raise RuntimeError("components did not settle")
    tops = edges.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
    return edges.select("u", F.col("v").alias("component")).unionByName(tops).withColumnRenamed("u", "node")
