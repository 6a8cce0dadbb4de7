"""Connected components by alternating large-star and small-star.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each step only joins edges
with one minimum per node, so a hub costs no more than its edges: minima are pre-aggregated before
the shuffle and written, so that the join with them is dealt anew and may be split where a node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.workdir import materialize, release


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """One step over edges (u > v, distinct), and the written minima it reads: links each node's neighbours to its least one.

    The large star moves the larger neighbours of every node, the small star the smaller ones.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = materialize(least.select("u", F.least("u", "m").alias("m")), "least")
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct(), least


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes on an edge (a, b); component is the least node reached.

    Self-loops and nulls are ignored; repeated edges count once. Rounds go on until the edges no
    longer change; 60 rounds suffice for any graph that fits a cluster, and more raise an error.
    """
    now = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and u <> v")
        .distinct()
    )
    now = materialize(now, "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen or mark.n == 0:
            break
        seen = mark
        for large in (True, False):
            moved, least = _star(now, large)
            before, now = now, materialize(moved, "edges")
            release(before)
            release(least)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
