"""Bitmaps of 64-bit hashes: a first test of bounded size before an exact join.

Each value sets two bits, by its lower and its upper half. Bits are joined by OR inside Spark, so the driver gets the bitmap
alone, whose size is a parameter. A full bitmap lets everything pass; results never depend on it, only how much is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(rows: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of the values (long) of a column; bits: a power of two, from 64 to 2**32."""
    both = rows.select(F.explode(F.array(F.col(column), F.shiftrightunsigned(column, 32))).alias("v"))
    low = F.col("v").bitwiseAND(F.lit(63)).cast("int")
    words = (
        both.select(
            F.shiftright(F.col("v").bitwiseAND(F.lit(bits - 1)), 6).cast("int").alias("w"),
            F.call_function("shiftleft", F.lit(1).cast("long"), low).alias("b"),
        )
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.tobytes()


def _bit(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def holds(bitmap: bytes, values: np.ndarray) -> np.ndarray:
    """Which of the values (unsigned or signed 64-bit) may be in the bitmap."""
    table, values = np.frombuffer(bitmap, dtype=np.uint64), values.view(np.uint64)
    mask = np.uint64(len(table) * 64 - 1)
    found = _bit(table, values & mask)
    some = np.flatnonzero(found)
    found[some] = _bit(table, (values[some] >> np.uint64(32)) & mask)
    return found
