"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Named by spark.checkpoint.dir; a temporary folder of this machine only where
    that is unset and everything runs in one JVM."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="strandlog-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_written: dict[tuple, tuple[str, object]] = {}


def stamp(spark: SparkSession, path: str) -> tuple:
    """Length and time of change of all files of a table."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in status)


def written(spark: SparkSession, name: str, tables: list[str], build: Callable[[], DataFrame], key: str, order: str) -> DataFrame:
    """What ``build`` makes of these tables, written once for a session as long as they
    do not change: rows of a key together and in order, so that a filter by key skips
    row groups."""
    at = (spark.sparkContext.applicationId, name, *((t, stamp(spark, t)) for t in tables))
    if at not in _written:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        made = build()
        made.repartition(key).sortWithinPartitions(key, order).write.parquet(path)
        _written[at] = path, made.schema
    path, schema = _written[at]
    return spark.read.schema(schema).parquet(path)
