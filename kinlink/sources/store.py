"""Intermediate tables in Parquet, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple[str, str, str], DataFrame] = {}
_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a session within one machine gets a temporary one, removed at its
    end; on a cluster that is an error, as executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="kinlink-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = f"file://{folder}"
    return _own[app]


def keep(df: DataFrame) -> DataFrame:
    """Write a table and read it back: cuts lineage, and survives lost executors."""
    path = f"{shared_root(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.kept_in = path
    return made


def forget(made: DataFrame) -> None:
    """Delete what keep wrote. Only for tables that nothing still to be computed reads."""
    spark = made.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(made.kept_in)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _stamp(spark: SparkSession, path: str) -> str:
    """When a table was last written and how large it is, so that a changed input is not taken for the old one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return ""
    return f"{files.getFileStatus(at).getModificationTime()}-{files.getContentSummary(at).getLength()}"


def written(spark: SparkSession, name: str, make: Callable[[], DataFrame], source: str = "") -> DataFrame:
    """The table of this name; made and written when it is first asked for in the application, or its source has changed."""
    key = (spark.sparkContext.applicationId, name, _stamp(spark, source) if source else "")
    if key not in _written:
        _written[key] = keep(make())
    return _written[key]
