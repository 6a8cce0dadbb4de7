"""Streaming: gallery records arrive over time and are linked with a static anchor table.

Each micro-batch is normalised, blocked by exact keys and written with its batch number; a replayed batch overwrites itself, so
a restart does not repeat links. Windowed counts with a watermark report arrivals by country.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinlink.functions.text import apply_normalization
from kinlink.operators import blocking


def link_batch(anchors: DataFrame, batch: DataFrame) -> DataFrame:
    """Candidates of a batch by address, core-name and PIN keys."""
    return blocking.distinct_pairs(blocking.key_legs(anchors, apply_normalization(batch)))


def latest_rows(batch: DataFrame) -> DataFrame:
    """The last row of each entity, in the order in which the batch is read."""
    others = [c for c in batch.columns if c != "entity_id"]
    numbered = batch.withColumn("_n", F.monotonically_increasing_id())
    last = numbered.groupBy("entity_id").agg(F.max_by(F.struct(*others), "_n").alias("_row"))
    return last.select("entity_id", *[F.col("_row")[c].alias(c) for c in others])


def start_linking(arrivals: DataFrame, anchors: DataFrame, out_dir: str, checkpoint: str, link: Callable[[DataFrame, DataFrame], DataFrame] = link_batch) -> StreamingQuery:
    """arrivals: a stream of raw gallery records; anchors: normalised. Results go to out_dir/batch=N."""

    def write(batch: DataFrame, number: int) -> None:
        link(anchors, latest_rows(batch)).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def arrivals_by_country(arrivals: DataFrame, time_column: str = "ts", delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, country, n): arrivals in tumbling windows; later ones than the delay are left out."""
    return arrivals.withWatermark(time_column, delay).groupBy(F.window(time_column, width), "country").agg(F.count("*").alias("n"))
