"""Logs from plain tables: users' events, and orders with their items.

To number events takes a shuffle and a sort of the whole table; so a log is written once
for a session, rows of an entity together and in order, and all queries read that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import views
from .shared import written

STATUS = {"signup": "active", "purchase": "paid", "error": "failed"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See ``number_users``."""
    return written(spark, "user-log", [f"{sf_dir}/events.parquet"], lambda: number_users(spark, sf_dir), "aggregate_key", "sequence")


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See ``number_orders``."""
    return written(spark, "order-log", [f"{sf_dir}/orders.parquet", f"{sf_dir}/lineitem.parquet"], lambda: number_orders(spark, sf_dir), "aggregate_key", "sequence")


def number_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream for each user; a commit holds the events of a user's day.

    user_id, aggregate_id, aggregate_key, sequence, commit_seq, event_at, event_at_ns,
    event_type, data, status (null: no change), labels (value '': removal)."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = (
        ev.withColumn("sequence", (F.row_number().over(stream) - 1).cast("long"))
        .withColumn("commit_seq", F.min("sequence").over(Window.partitionBy("user_id", F.to_date("ts"))))
        .select(
            "user_id", F.array(F.lit("user"), F.col("user_id").cast("string")).alias("aggregate_id"), "sequence", "commit_seq",
            F.col("ts").alias("event_at"), (F.unix_micros("ts") * 1000).alias("event_at_ns"), "event_type", F.col("props").alias("data"),
        )
        .withColumn("aggregate_key", ids.key(F.col("aggregate_id")))
    )
    k = F.get_json_object("data", "$.k").cast("int")
    status = F.coalesce(*(F.when(F.col("event_type") == t, F.lit(s)) for t, s in STATUS.items()))
    return views.indexed(numbered, status, F.create_map(F.lit("k"), F.when(k % 10 == 0, F.lit("")).otherwise(k.cast("string"))))


def number_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, aggregate_key, sequence, event_type, product_id, quantity, cents:
    created, the items in order, and how the order ended."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    rest = [c for c in li.columns if c not in ("l_orderkey", "l_linenumber")]
    items = li.withColumn("sequence", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", *rest)).cast("long"))
    items = items.select(
        F.col("l_orderkey").alias("o_orderkey"), "sequence", F.lit("order.item_added").alias("event_type"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )
    none = [F.lit(None).cast("long").alias(c) for c in ("product_id", "quantity", "cents")]
    first = o.select("o_orderkey", F.lit(0).cast("long").alias("sequence"), F.lit("order.created").alias("event_type"), *none)
    counts = items.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    ended = F.when(F.col("o_orderstatus") == "O", "order.confirmed").when(F.col("o_orderstatus") == "P", "order.shipped").otherwise("order.delivered")
    last = o.join(counts, "o_orderkey", "left").select("o_orderkey", (F.coalesce("n", F.lit(0)) + 1).alias("sequence"), ended.alias("event_type"), *none)
    whole = first.union(items.join(o.select("o_orderkey"), "o_orderkey", "left_semi")).union(last)
    return whole.withColumn("aggregate_key", ids.key(F.array(F.lit("order"), F.col("o_orderkey").cast("string"))))
