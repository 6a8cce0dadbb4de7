"""Similarity searches by scanning: every query name against every distinct gallery name, in blocks.

For what no key or shared term finds: a fallback for anchors without candidates, and exact rankings of small query sets. Queries go
out in blocks of QUERY_BLOCK distinct names; each scan of the gallery's distinct names keeps a bounded list for each query, and the
lists are merged by rank. Cost is the product of distinct names by its meaning, so give it few queries.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.functions.fuzzy import weighted_ratio_many
from kinlink.operators.blocking import CLEAN_NAME, cap_candidates

QUERY_BLOCK = 2_000
SCAN_ROWS = 4_000


def _best(queries: list[tuple[str, str]], most: int, threshold: float):
    """For each query (scope, name) the best names (scope, t, first) of a task's batches; ties go to the lower first id."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, SCAN_ROWS):
                batch = whole.slice(at, SCAN_ROWS)
                scopes, names, first = (np.array(batch.column(c).to_pylist(), dtype=object) for c in ("scope", "t", "first"))
                out = ([], [], [], [], [])
                for scope, query in queries:
                    mine = np.flatnonzero(scopes == scope)
                    if not len(mine):
                        continue
                    score = weighted_ratio_many([query] * len(mine), names[mine].tolist())
                    good = np.flatnonzero((score >= threshold) & (score > 0))
                    order = good[np.lexsort((first[mine[good]].astype(str), -score[good]))][:most]
                    for column, values in zip(out, ([scope] * len(order), [query] * len(order), names[mine[order]], first[mine[order]], score[order]), strict=True):
                        column.extend(values)
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["scope", "q", "t", "first", "score"])

    return run


def fuzzy_scan(anchors: DataFrame, gallery: DataFrame, threshold: float = 0.4, most: int = 50, scope: Column | None = None) -> DataFrame:
    """(s1_id, cand_id, score): for each anchor the `most` gallery records of the highest weighted name ratio, if that is
    at least the threshold and above 0; ties go to the lower id. scope: only records of an equal value are compared.
    """
    group = F.lit("") if scope is None else F.coalesce(scope.cast("string"), F.lit(""))
    name = F.coalesce(F.col(CLEAN_NAME), F.lit(""))
    a = anchors.select(F.col("entity_id").alias("s1_id"), group.alias("scope"), name.alias("q")).where("q <> ''")
    b = gallery.select(F.col("entity_id").alias("cand_id"), group.alias("scope"), name.alias("t")).where("t <> ''")
    queries, names = a.select("scope", "q").distinct(), b.groupBy("scope", "t").agg(F.min("cand_id").alias("first"))
    blocks = -(-queries.count() // QUERY_BLOCK)
    parts = []
    for k in range(blocks):
        block = [tuple(r) for r in queries.where(F.pmod(F.xxhash64("scope", "q"), F.lit(blocks)) == k).collect()]
        parts.append(names.mapInArrow(_best(block, most, threshold), "scope string, q string, t string, first string, score double"))
    if not parts:
        return a.limit(0).selectExpr("s1_id", "s1_id as cand_id", "cast(0 as double) as score")
    w = Window.partitionBy("scope", "q").orderBy(F.desc("score"), "first")
    ranked = reduce(DataFrame.union, parts).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    rows = ranked.join(a, ["scope", "q"]).join(b, ["scope", "t"]).select("s1_id", "cand_id", "score")
    return cap_candidates(rows, most, "score")


def brute_top_k(anchors: DataFrame, gallery: DataFrame, k: int = 15) -> DataFrame:
    """(s1_id, cand_id, score): the k most similar names of each anchor, whatever their score but 0."""
    return fuzzy_scan(anchors, gallery, 0.0, k)
