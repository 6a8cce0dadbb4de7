"""Shared working storage: the folder every executor and the driver can reach."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Most bytes of an Arrow batch; a single longer row makes a batch of its own.
BATCH_BYTES = 4 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session sends batches of BATCH_BYTES at most to Python workers."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def held(key: str, make: Callable[[], object]):
    """What make gives, kept over the tasks of a Python worker. Only the latest key is, so that operators do not add up there."""
    slot = sys.modules.setdefault("_kinlink_held", types.ModuleType("_kinlink_held"))
    if getattr(slot, "key", None) != key:
        slot.key = slot.value = None
        slot.value = make()
        slot.key = key
    return slot.value


def trimmed(run: Callable) -> Callable:
    """A function of batches that gives freed memory back to the system when its task ends, where the C library can."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where the setting is missing, a session within one machine gets a temporary folder of its own, removed at its end; on a
    cluster that is an error, as executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kinlink-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new, not yet existing folder below the shared root."""
    return f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write a DataFrame to shared storage and read it back: cuts lineage, survives lost executors."""
    path = fresh_folder(df.sparkSession, what)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.kept_in = path
    return made


def release(made: DataFrame) -> None:
    """Delete what materialize wrote. Only for tables that nothing still to be computed reads."""
    spark = made.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(made.kept_in)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
