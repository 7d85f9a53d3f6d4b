"""Event codecs: JSON as column expressions, and a binary form for import and export."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JSON_SCHEMA = "event_at_ns bigint, event_type string, aggregate_id array<string>, data string, sequence bigint"


def to_json(*columns: str) -> Column:
    return F.to_json(F.struct(*(columns or [c.split()[0] for c in JSON_SCHEMA.split(", ")])))


def from_json(text: Column) -> Column:
    return F.from_json(text, JSON_SCHEMA)


def write_lines(events: DataFrame, path: str) -> None:
    """Events as JSON lines."""
    events.select(*(c.split()[0] for c in JSON_SCHEMA.split(", "))).write.json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as events; a line that is none is an error."""
    return spark.read.schema(JSON_SCHEMA).option("mode", "FAILFAST").json(path)


class Corrupt(ValueError):
    """Input ends early or has bytes left over."""


def encode_event(event_at_ns: int, sequence: int, aggregate_id, event_type: str, data: str) -> bytes:
    def sized(b: bytes) -> bytes:
        return struct.pack(">I", len(b)) + b

    ids = struct.pack(">I", len(aggregate_id)) + b"".join(sized(p.encode()) for p in aggregate_id)
    return struct.pack(">qq", event_at_ns, sequence) + ids + sized(event_type.encode()) + sized(data.encode())


def decode_event(b: bytes) -> tuple[int, int, list[str], str, str]:
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(b):
            raise Corrupt("short input")
        at += n
        return b[at - n : at]

    def sized() -> str:
        return take(struct.unpack(">I", take(4))[0]).decode()

    ns, seq = struct.unpack(">qq", take(16))
    ids = [sized() for _ in range(struct.unpack(">I", take(4))[0])]
    kind, data = sized(), sized()
    if at != len(b):
        raise Corrupt("bytes left over")
    return ns, seq, ids, kind, data


def encoded(events: DataFrame) -> DataFrame:
    """aggregate_key, sequence, payload binary."""

    def run(batches):
        for p in batches:
            rows = zip(p.event_at_ns, p.sequence, p.aggregate_id, p.event_type, p.data, strict=True)
            yield pd.DataFrame({"aggregate_key": p.aggregate_key, "sequence": p.sequence, "payload": [encode_event(int(a), int(s), list(i), t, d) for a, s, i, t, d in rows]})

    return events.select("aggregate_key", "sequence", "event_at_ns", "aggregate_id", "event_type", "data").mapInPandas(run, "aggregate_key string, sequence long, payload binary")


def decoded(payloads: DataFrame) -> DataFrame:
    def run(batches):
        for p in batches:
            rows = [decode_event(b) for b in p.payload]
            yield pd.DataFrame({"aggregate_key": p.aggregate_key, "event_at_ns": [r[0] for r in rows], "sequence": [r[1] for r in rows], "aggregate_id": [r[2] for r in rows], "event_type": [r[3] for r in rows], "data": [r[4] for r in rows]}).astype({"event_at_ns": "int64", "sequence": "int64"})

    return payloads.select("aggregate_key", "payload").mapInPandas(run, "aggregate_key string, event_at_ns long, sequence long, aggregate_id array<string>, event_type string, data string")
