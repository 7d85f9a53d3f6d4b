"""Committed events as a stream: publishing, dispatch by type, and live projections.

Files of a micro-batch arrive in no set order, so state keeps what came early
until its turn, contracted to runs of events without a gap; what was applied already
is dropped. Handlers run at least once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import views

COLUMNS = "aggregate_key string, sequence long, event_type string, data string"


def feed(spark: SparkSession, path: str, schema: str = COLUMNS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def publish(store, handler: Callable[[DataFrame], None], checkpoint: str, kind: str = "commit"):
    """A stream writer: hands the events of each commit (kind ``archived``: each archive
    record) that a store publishes from now on to the handler, in order of versions. What
    was published before the first start is not handed on; after a restart with the same
    checkpoint the stream goes on where it stopped. A handler's error stops the stream,
    and the commit comes again."""
    from ..sources.store import ARCHIVE, EVENTS

    spark, schema, now = store.spark, ARCHIVE if kind == "archived" else EVENTS, store.version()
    since = f"{checkpoint.removeprefix('file://')}-since"
    try:
        with open(since, "x") as f:
            f.write(str(now))
    except FileExistsError:
        with open(since) as f:
            now = int(f.read())
    manifests = spark.readStream.schema("commit string, archived string").option("pathGlobFilter", "*.json").json(f"file://{store.path}/manifests")
    number = F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("long")
    added = manifests.select(number.alias("version"), F.col(kind).alias("path")).where((F.col("version") > now) & F.col("path").isNotNull())

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy("version").collect():  # a manifest's name and a path each
            handler(store.read([row["path"]], schema))

    return added.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def dispatcher(handlers: dict[str, Callable[[DataFrame], None]]) -> Callable[[DataFrame], None]:
    """Hands each type's events to its handler; other types are ignored, errors go on to the caller."""

    def run(events: DataFrame) -> None:
        for kind, handler in handlers.items():
            handler(events.where(events.event_type == kind))

    return run


def typed_handler(schema: str, handler: Callable[[DataFrame], None]) -> Callable[[DataFrame], None]:
    """A handler of events with ``value``, decoded from their data; data that cannot be decoded is an error."""
    return lambda events: handler(views.typed(events, schema, strict=True))


def dispatch(events: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str):
    """Each micro-batch's events of a type go to its handler."""
    run = dispatcher(handlers)
    return events.writeStream.foreachBatch(lambda batch, _: run(batch)).option("checkpointLocation", checkpoint)


def runs(sequence: np.ndarray, plus: np.ndarray, reset: np.ndarray) -> Iterable[list]:
    """[first, end, was reset, value since] of stretches without a gap. Repeats are dropped."""
    if not len(sequence):
        return
    sequence, at = np.unique(sequence, return_index=True)
    plus, reset = plus[at], reset[at]
    begins = np.flatnonzero(np.diff(sequence, prepend=sequence[:1] - 2) != 1)
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(sequence)], strict=True):
        last = np.flatnonzero(reset[lo:hi])
        since = lo + last[-1] + 1 if len(last) else lo
        yield [int(sequence[lo]), int(sequence[hi - 1]) + 1, bool(len(last)), int(plus[since:hi].sum())]


def merged(some: list[list]) -> list[list]:
    """Runs that touch are one."""
    out: list[list] = []
    for first, end, was_reset, value in sorted(some):
        if out and out[-1][1] == first:
            out[-1] = [out[-1][0], end, was_reset or out[-1][2], value if was_reset else out[-1][3] + value]
        else:
            out.append([first, end, was_reset, value])
    return out


def counters(events: DataFrame, plus: str = "purchase", minus: str = "view", reset: str = "error") -> DataFrame:
    """aggregate_key, value, next_seq after each micro-batch that changed them."""

    def run(key, batches, state: GroupState):
        value, following, early = state.get if state.exists else (0, 0, "[]")
        waiting = json.loads(early)
        for p in batches:
            sequence, kind = p.sequence.to_numpy(), p.event_type.to_numpy()
            new = sequence >= following
            for first, end, _, _ in waiting:
                new &= (sequence < first) | (sequence >= end)
            sequence, kind = sequence[new], kind[new]
            waiting = merged([*waiting, *runs(sequence, (kind == plus).astype(int) - (kind == minus), kind == reset)])
        if waiting and waiting[0][0] == following:
            _, following, was_reset, since = waiting.pop(0)
            value = since if was_reset else value + since
        state.update((value, following, json.dumps(waiting)))
        yield pd.DataFrame({"aggregate_key": [key[0]], "value": [value], "next_seq": [following]})

    return events.groupBy("aggregate_key").applyInPandasWithState(run, "aggregate_key string, value long, next_seq long", "value long, next_seq long, early string", "update", GroupStateTimeout.NoTimeout)
