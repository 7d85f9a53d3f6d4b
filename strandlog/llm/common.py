"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows at most that go to a Python worker at once.
ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: batches of ROWS keep the memory of workers, and of the JVM's
    buffers for them, small. Holds for what the session plans from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, str(ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    A temporary folder of this machine is used only where the setting is unset
    and everything runs in one JVM (tests).
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="strandlog-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: cuts the
    lineage, survives lost executors, and gives the planner a true size."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(col="doc_id"):
    """crc32 of the id written as decimal text; the hold-out rules use its remainder."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def text_of(col="text"):
    return F.coalesce(F.col(col), F.lit(""))


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until no column (of any case) has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def smallest_hashes(rows: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """The ``most`` rows (doc_id and others) with the smallest hash of their id. A
    threshold lets through little more than that many, so that no partition sorts or
    sends all it has; should it let through fewer, which chance all but excludes, it is raised."""
    order = F.xxhash64("doc_id", F.lit(seed))
    n = rows.count()
    share = (most + 6 * most**0.5 + 10) / max(n, 1)
    while True:
        some = rows if share >= 1 else rows.where(order < int(share * 2**64) - 2**63)
        if share >= 1 or some.count() >= most:
            return some.orderBy(order, *rows.columns).limit(most)
        share *= 2


def label_sample(labels: DataFrame, column: str, train, most: int) -> dict[int, int]:
    """At most ``most`` labelled rows that satisfy ``train``, those with the
    smallest hash of their id: {doc_id: label}. Rows without an id or a label are
    left out; of several labels for one id the largest counts."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & train).select("doc_id", F.col(column).cast("int").alias("y"))
    found: dict[int, int] = {}
    for r in smallest_hashes(rows, most).collect():
        found[r.doc_id] = max(r.y, found.get(r.doc_id, 0))
    return found
