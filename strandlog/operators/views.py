"""Everything derived from a log is a query over it, for all entities at once."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "aggregate_key"


def scan(log: DataFrame, key: str, start: int = 0) -> DataFrame:
    """One entity's events from a sequence on (negative: all), in order."""
    return log.where((F.col(KEY) == key) & (F.col("sequence") >= max(0, start))).orderBy("sequence")


def heads(log: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """aggregate_key, head: the next sequence, by events and snapshots."""
    ends = log.groupBy(KEY).agg((F.max("sequence") + 1).alias("end"))
    if snapshots is None:
        return ends.withColumnRenamed("end", "head")
    best = snapshots.groupBy(KEY).agg(F.max("snapshot_seq").alias("s"))
    return ends.join(best, KEY, "full").select(KEY, F.greatest("end", "s", F.lit(0)).alias("head"))


def commits(log: DataFrame) -> DataFrame:
    """aggregate_key, commit_seq, n_events, status (last one set), status_at (time of the commit's last event)."""
    return log.groupBy(KEY, "commit_seq").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.expr("max_by(status, sequence) FILTER (WHERE status IS NOT NULL)").alias("status"),
        F.max_by("event_at", "sequence").alias("status_at"),
    )


def status_current(log: DataFrame) -> DataFrame:
    """aggregate_key, status, status_at of entities that have one; '' clears."""
    last = commits(log).where("status IS NOT NULL").groupBy(KEY).agg(F.max_by(F.struct("status", "status_at"), "commit_seq").alias("s"))
    return last.select(KEY, "s.status", "s.status_at").where("status <> ''")


def status_entered(log: DataFrame) -> DataFrame:
    """status_current with entered_at: since when the status is the present one without a change."""
    c = commits(log).where("status IS NOT NULL")
    w = Window.partitionBy(KEY).orderBy("commit_seq")
    c = c.withColumn("new", F.coalesce(F.lag("status").over(w) != F.col("status"), F.lit(True)))
    last = c.groupBy(KEY).agg(F.max_by(F.struct("status", "status_at"), "commit_seq").alias("s"), F.expr("max_by(status_at, commit_seq) FILTER (WHERE new)").alias("entered_at"))
    return last.select(KEY, "s.status", "s.status_at", "entered_at").where("status <> ''")


def labels_current(log: DataFrame) -> DataFrame:
    """aggregate_key, label, value: the last value of each label; '' removes it."""
    each = log.where("labels IS NOT NULL").select(KEY, "sequence", F.explode("labels").alias("label", "value"))
    return each.groupBy(KEY, "label").agg(F.max_by("value", "sequence").alias("value")).where("value <> ''")


def label_values(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label", "value").agg(F.count(F.lit(1)).alias("n_aggregates"))


def by_status(log: DataFrame, status: str) -> DataFrame:
    """Entities in a status by time, then key; '' names no status."""
    return status_current(log).where((F.col("status") == status) & (F.col("status") != "")).orderBy("status_at", KEY)


def by_label(log: DataFrame, label: str, value: str) -> DataFrame:
    found = labels_current(log).where((F.col("label") == label) & (F.col("value") == value))
    return found.join(heads(log), KEY)


def counter(log: DataFrame, plus: str = "purchase", minus: str = "view", reset: str = "error", state: DataFrame | None = None) -> DataFrame:
    """aggregate_key, value: a counter with reset, as sums since the last reset.
    ``state`` (aggregate_key, snapshot_seq, start) is where the fold begins; without it, at zero."""
    change = F.when(F.col("event_type") == plus, 1).when(F.col("event_type") == minus, -1).otherwise(0)
    log = log.select(KEY, "sequence", "event_type")
    if state is None:
        resets = log.groupBy(KEY).agg(F.max(F.when(F.col("event_type") == reset, F.col("sequence"))).alias("last_reset"))
        since = F.col("last_reset").isNull() | (F.col("sequence") > F.col("last_reset"))
        return log.join(resets, KEY).groupBy(KEY).agg(F.sum(F.when(since, change).otherwise(0)).cast("long").alias("value"))
    # A state without a tail still counts.
    tail = log.join(state, KEY).where("sequence >= snapshot_seq")
    resets = tail.where(F.col("event_type") == reset).groupBy(KEY).agg(F.max("sequence").alias("last_reset"))
    since = tail.join(resets, KEY, "left").where("last_reset is null or sequence > last_reset").groupBy(KEY).agg(F.sum(change).alias("change"))
    begun = state.join(resets, KEY, "left").join(since, KEY, "left")
    begin = F.when(F.col("last_reset").isNull(), F.col("start")).otherwise(0)
    return begun.select(KEY, (begin + F.coalesce("change", F.lit(0))).cast("long").alias("value"))


def running_counter(log: DataFrame, plus: str = "purchase", minus: str = "view") -> DataFrame:
    """The state as of each event that an applier handles."""
    w = Window.partitionBy(KEY).orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    handled = log.where(F.col("event_type").isin(plus, minus))
    return handled.select(KEY, "sequence", F.sum(F.when(F.col("event_type") == plus, 1).otherwise(-1)).over(w).cast("long").alias("value"))


def indexed(events: DataFrame, status: Column, labels: Column) -> DataFrame:
    """events with what an indexer of column expressions says of each: status (null: no
    change, '': cleared) and labels (a map; value '': removed)."""
    return events.withColumns({"status": status, "labels": labels})


def typed(events: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    """events with ``value``, decoded from their data. What cannot be decoded is left out,
    so that a fold keeps its state; with ``strict`` it is an error."""
    options = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    value = F.from_json("data", schema if strict else f"{schema}, _corrupt string", options)
    events = events.withColumn("value", value)
    return events if strict else events.where("value is not null and value._corrupt is null").withColumn("value", F.col("value").dropFields("_corrupt"))


def fold(log: DataFrame, init: Column, step) -> DataFrame:
    """aggregate_key, state: an ordered left fold by column expressions, step(state,
    event), for entities whose events fit into a row (others: sums, as in ``counter``)."""
    events = F.sort_array(F.collect_list(F.struct("sequence", "event_type", "data")))
    return log.groupBy(KEY).agg(events.alias("e")).select(KEY, F.aggregate("e", init, step).alias("state"))


def fold_python(log: DataFrame, initial, appliers: dict) -> DataFrame:
    """aggregate_key, state (JSON): an ordered left fold by Python appliers, {type:
    f(state, data)}; types without one are skipped. Events stream by, an entity's one
    after the other, so that only one state is held."""

    def run(batches):
        key, state, seen = None, None, False
        for p in batches:
            done = []
            for k, kind, data in zip(p[KEY], p["event_type"], p["data"], strict=True):
                if not seen or k != key:
                    if seen:
                        done.append((key, json.dumps(state)))
                    key, state, seen = k, initial(), True
                if kind in appliers:
                    state = appliers[kind](state, data)
            yield pd.DataFrame(done, columns=[KEY, "state"])
        if seen:
            yield pd.DataFrame([(key, json.dumps(state))], columns=[KEY, "state"])

    return log.select(KEY, "sequence", "event_type", "data").repartition(KEY).sortWithinPartitions(KEY, "sequence").mapInPandas(run, f"{KEY} string, state string")


def order_state(log: DataFrame) -> DataFrame:
    """aggregate_key, status, n_items, total_cents: a product added again replaces the earlier item."""
    item = log.where("event_type = 'order.item_added'").groupBy(KEY, "product_id").agg(F.max_by(F.struct("quantity", "cents"), "sequence").alias("i"))
    totals = item.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col("i.quantity") * F.col("i.cents")).alias("total_cents"))
    status = log.where("event_type <> 'order.item_added'").groupBy(KEY).agg(F.max_by(F.substring_index("event_type", ".", -1), "sequence").alias("status"))
    return status.join(totals, KEY, "left").select(KEY, "status", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("total_cents", F.lit(0)).cast("long").alias("total_cents"))


def audit(log: DataFrame) -> DataFrame:
    """One row: events, gaps and repeated sequences."""
    w = Window.partitionBy(KEY).orderBy("sequence")
    step = F.col("sequence") - F.coalesce(F.lag("sequence").over(w), F.lit(-1))
    return log.select(step.alias("step")).agg(F.count(F.lit(1)).alias("n_events"), F.count(F.when(F.col("step") > 1, 1)).alias("n_gaps"), F.count(F.when(F.col("step") < 1, 1)).alias("n_repeats"))
