"""Appends with version checks, snapshots, trimming and archiving, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .views import KEY


def resolve(requests: DataFrame, heads: DataFrame) -> DataFrame:
    """requests (aggregate_key, expected, n_events) with actual head and accepted."""
    return requests.join(heads, KEY, "left").withColumn("actual", F.coalesce("head", F.lit(0)).cast("long")).withColumn("accepted", F.col("expected") == F.col("actual")).drop("head")


def conflicts(resolved: DataFrame, log: DataFrame) -> DataFrame:
    """Rejected requests with the number of events since the expected sequence (0 if that is ahead)."""
    bad = resolved.where(~F.col("accepted"))
    tail = bad.join(log.select(F.col(KEY).alias("k"), "sequence"), (F.col(KEY) == F.col("k")) & (F.col("sequence") >= F.col("expected")), "left")
    return tail.groupBy(KEY, "expected", "actual").agg(F.count("sequence").alias("n_new"))


def chain(requests: DataFrame, heads: DataFrame) -> DataFrame:
    """Several requests for one entity, in order of arrival: each is accepted if it
    expects the head that those accepted before it have left."""
    asked = requests.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("arrival", "expected", "n_events"))).alias("rs"))
    empty = F.expr("cast(array() as array<struct<arrival: bigint, actual: bigint, accepted: boolean>>)")

    def step(acc, r):
        ok = r["expected"] == acc["head"]
        done = F.array(F.struct(r["arrival"].cast("long").alias("arrival"), acc["head"].alias("actual"), ok.alias("accepted")))
        return F.struct((acc["head"] + F.when(ok, r["n_events"]).otherwise(0)).cast("long").alias("head"), F.concat(acc["done"], done).alias("done"))

    start = F.struct(F.coalesce("head", F.lit(0)).cast("long").alias("head"), empty.alias("done"))
    return asked.join(heads, KEY, "left").select(KEY, F.inline(F.aggregate("rs", start, step, lambda a: a["done"])))


def newest(snapshots: DataFrame) -> DataFrame:
    """Of several saves the one of the greatest sequence, then version; an older one never replaces it."""
    w = Window.partitionBy(KEY).orderBy(F.desc("snapshot_seq"), F.desc("version"))
    return snapshots.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def retained(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events that trimming below the snapshots leaves."""
    base = snapshots.groupBy(KEY).agg(F.max("snapshot_seq").alias("base"))
    return log.join(base, KEY, "left").where("sequence >= coalesce(base, 0)").drop("base")


def due(log: DataFrame, snapshots: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Entities whose tail, in bytes, outweighs their snapshot by more than ratio (strictly)."""
    tail = log.join(snapshots, KEY).where("sequence >= snapshot_seq")
    sizes = tail.groupBy(KEY).agg(F.sum(F.octet_length("data")).cast("long").alias("tail_bytes"), F.max(F.octet_length("snapshot_data")).cast("long").alias("snapshot_bytes"))
    return sizes.where(F.col("tail_bytes") / F.col("snapshot_bytes") > ratio)


def absent(ids: DataFrame, heads: DataFrame) -> DataFrame:
    return ids.join(heads, KEY, "left_anti")


def archive(log: DataFrame, snapshots: DataFrame, keys: DataFrame) -> DataFrame:
    """Archive records of the given entities: newest snapshot and the events kept with it."""
    kept = retained(log, snapshots).join(keys, KEY, "left_semi").groupBy(KEY).agg(F.count(F.lit(1)).alias("n_events"))
    return kept.join(newest(snapshots).select(KEY, "snapshot_seq"), KEY, "left").select(KEY, F.coalesce("snapshot_seq", F.lit(0)).alias("snapshot_seq"), "n_events")


def live(heads: DataFrame, archived: DataFrame) -> DataFrame:
    return heads.join(archived.select(KEY), KEY, "left_anti")


def pending(archived: DataFrame, acks: DataFrame) -> DataFrame:
    return archived.join(acks.select("stream_id"), "stream_id", "left_anti")
