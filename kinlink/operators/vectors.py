"""Nearest vectors by cosine: queries go out in blocks of bounded size, and each scan of the vectors keeps a bounded list for each query."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERY_BLOCK = 4_096
SCAN_ROWS = 8_192


def _unit(rows: list) -> np.ndarray:
    matrix = np.array(rows, dtype=np.float64)
    return matrix / np.maximum(np.sqrt((matrix * matrix).sum(axis=1, keepdims=True)), 1e-300)


def _nearest(shared, k: int, places: int):
    def run(batches):
        import pyarrow as pa

        ids, queries = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, SCAN_ROWS):
                batch = whole.slice(at, SCAN_ROWS)
                mine = np.array(batch.column("id").to_pylist())
                cos = np.round(queries @ _unit(batch.column("v").to_pylist()).T, places)
                cos[ids[:, None] == mine[None, :]] = -np.inf
                out_q, out_v, out_c = [], [], []
                for q in range(len(ids)):
                    order = np.lexsort((mine, -cos[q]))[:k] if len(mine) <= k else _first(cos[q], mine, k)
                    order = order[np.isfinite(cos[q][order])]
                    out_q.append(np.repeat(ids[q], len(order)))
                    out_v.append(mine[order])
                    out_c.append(cos[q][order])
                columns = [np.concatenate(c) for c in (out_q, out_v, out_c)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "id", "cos"])

    return run


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best scores, ties by id."""
    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
    some = np.flatnonzero(scores >= cut)
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, places: int = 6) -> DataFrame:
    """(query_id, id, cos): for each query the k nearest of the other vectors, cosines to `places`, ties to the lower id.

    vectors, queries: id (long), v (array of numbers, none null).
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = []
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "v").collect()
        if rows:
            shared = spark.sparkContext.broadcast((np.array([r.id for r in rows]), _unit([r.v for r in rows])))
            parts.append(vectors.select("id", "v").mapInArrow(_nearest(shared, k, places), "query_id long, id long, cos double"))
    if not parts:
        return vectors.limit(0).selectExpr("id as query_id", "id", "cast(0 as double) as cos")
    w = Window.partitionBy("query_id").orderBy(F.desc("cos"), "id")
    return reduce(DataFrame.union, parts).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
