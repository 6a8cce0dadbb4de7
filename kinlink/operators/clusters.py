"""Clusters of linked records: connected components, and pivots that keep long chains apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.sources.store import forget, keep


def components(pairs: DataFrame) -> DataFrame:
    """(id, cluster): the least id reached over pairs (s1_id, cand_id), by least labels that jump to their label's label.

    Rounds grow with the logarithm of the longest chain. Ids of both sides live in one space.
    """
    edges = keep(pairs.where("s1_id is not null and cand_id is not null").select(F.col("s1_id").alias("a"), F.col("cand_id").alias("b")))
    both = edges.union(edges.select("b", "a")).distinct()
    labels = keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("cluster")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("near"))
        hooked = labels.join(near, "id").select("id", "cluster", F.least("cluster", "near").alias("low"))
        # Whoever has a label is told the least label that any of its bearers has seen; then labels jump.
        told = hooked.groupBy("cluster").agg(F.min("low").alias("told"))
        now = hooked.join(told, "cluster").select("id", F.least("low", "told").alias("cluster"))
        jump = now.select(F.col("id").alias("cluster"), F.col("cluster").alias("next"))
        then = keep(now.join(jump, "cluster", "left").select("id", F.coalesce("next", "cluster").alias("cluster")))
        moved = not then.join(labels.withColumnRenamed("cluster", "before"), "id").where("cluster <> before").isEmpty()
        forget(labels)
        labels = then
        if not moved:
            forget(edges)
            return labels


def pivots(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """(id, cluster): correlation clustering of pairs (s1_id, cand_id) taken as alike, by parallel pivots.

    In each round every id that comes first among its neighbours, in the order of a hash, is a pivot, and neighbours join
    their first pivot; so no cluster reaches further than one link from its pivot.
    """
    edges = pairs.where("s1_id <> cand_id").select(F.col("s1_id").alias("a"), F.col("cand_id").alias("b"))
    both = keep(edges.union(edges.select("b", "a")).distinct())
    order = lambda c: F.struct(F.xxhash64(F.lit(seed), c), F.col(c))
    done = None
    while not both.isEmpty():
        first = both.groupBy("a").agg(F.min(order("b")).alias("least")).where(order("a") < F.col("least")).select(F.col("a").alias("cluster"))
        first = keep(first)
        joined = both.join(first, F.col("a") == F.col("cluster")).groupBy(F.col("b").alias("id")).agg(F.min(order("a"))["a"].alias("cluster"))
        found = keep(joined.union(first.select(F.col("cluster").alias("id"), "cluster")))
        done = found if done is None else done.union(found)
        gone = found.select("id")
        left = both.join(gone, F.col("a") == F.col("id"), "left_anti").join(gone, F.col("b") == F.col("id"), "left_anti")
        alone = both.join(gone, F.col("a") == F.col("id"), "left_anti").select(F.col("a").alias("id")).distinct()
        then = keep(left)
        single = keep(alone.join(then.select(F.col("a").alias("id")).distinct(), "id", "left_anti").withColumn("cluster", F.col("id")))
        done = done.union(single)
        forget(both)
        both = then
    return done if done is not None else edges.limit(0).selectExpr("a as id", "a as cluster")
