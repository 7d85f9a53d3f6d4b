"""An event store on files: commits are Parquet folders, published by a manifest.

A version is one JSON file that lists the folders; it is created only if it does
not exist yet (a hard link), which decides between writers. That holds on POSIX
file systems; an object store needs its own conditional put. A reader sees one
version throughout. Writers check versions against the version they read and
publish the next; whoever loses re-reads and checks again.

Folders are merged in tiers of ``FAN``, so that a row is rewritten a few times at most
and a manifest stays short; what is archived, trimmed or superseded goes then. Every row carries the version that published it; to
archive an entity is to note the version up to which its rows are gone.

Status and labels are kept apart from events, as index rows, and outlive trimming.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import logging
import os
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import views, writes

KEY = views.KEY
EVENTS = "aggregate_id array<string>, aggregate_key string, sequence long, commit_seq long, event_at timestamp, event_at_ns long, event_type string, data string, status string, labels map<string,string>, version long"
SNAPSHOTS = "aggregate_id array<string>, aggregate_key string, snapshot_seq long, snapshot_data string, version long"
ARCHIVE = "stream_id string, aggregate_key string, snapshot_seq long, snapshot_data string, events array<struct<sequence:long,event_type:string,data:string>>"
#: Index rows have the columns of events, so that the same views serve both.
KINDS = {"events": EVENTS, "index": EVENTS, "snapshots": SNAPSHOTS}
#: Folders of a tier that are merged into one of the next.
FAN = 16
_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Config:
    snapshot_ratio: float | None = 1.0
    max_retries: int | None = 16
    trim: bool | None = False
    archiving: bool | None = True
    cache: int | None = 128

    def overlaid(self, **settings) -> Config:
        """None inherits."""
        new = replace(self, **{k: v for k, v in settings.items() if v is not None})
        if new.max_retries < 1 or new.snapshot_ratio < 0 or new.cache < 0:
            raise ValueError("max_retries, snapshot_ratio and cache must be positive")
        return new


class Closed(RuntimeError):
    pass


class ArchivingDisabled(RuntimeError):
    pass


class MaxRetriesExceeded(RuntimeError):
    pass


class VersionConflict(RuntimeError):
    def __init__(self, expected: int, actual: int, new_events: list):
        super().__init__(f"expected sequence {expected}, found {actual}")
        self.expected, self.actual, self.new_events = expected, actual, new_events


def timestamp(ns: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(0, dt.UTC) + dt.timedelta(microseconds=ns // 1000)


class EventStore:
    """indexer: list of events (dicts) to list of (status, labels); null and missing mean no change, '' removes."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, indexer=None):
        self.spark, self.path, self.config, self.indexer, self.closed = spark, path, config or Config(), indexer, False
        os.makedirs(f"{path}/manifests", exist_ok=True)

    def close(self) -> None:
        self.closed = True

    def _open(self) -> None:
        if self.closed:
            raise Closed("the store is closed")

    def ready(self) -> bool:
        return not self.closed and os.path.isdir(f"{self.path}/manifests")

    def wait_ready(self, seconds: float) -> bool:
        """Whether the store is ready, by then."""
        end = time.monotonic() + seconds
        while not self.ready() and time.monotonic() < end:
            time.sleep(0.05)
        return self.ready()

    # Versions

    def version(self) -> int:
        self._open()
        return max((int(n[:-5]) for n in os.listdir(f"{self.path}/manifests") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """kinds: lists of [path, tier]; archive: list of [stream id, path], oldest first;
        gone: {key: version}; commit and archived: what this version has added."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "events": [], "index": [], "snapshots": [], "archive": [], "gone": {}}
        with open(f"{self.path}/manifests/{version:020d}.json") as f:
            return json.load(f) | {"version": version}

    def publish(self, manifest: dict, **added) -> bool:
        """The next version, unless another writer has it."""
        tmp = f"{self.path}/manifests/{uuid.uuid4().hex}.tmp"
        with open(tmp, "w") as f:
            json.dump({k: v for k, v in manifest.items() if k not in ("version", "commit", "archived")} | added, f)
        try:
            os.link(tmp, f"{self.path}/manifests/{manifest['version'] + 1:020d}.json")
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(tmp)

    def read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"file://{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"file://{self.path}/{name}")
        return name

    def _write_rows(self, rows: list, kind: str, schema: str | None = None) -> str:
        return self._write(self.spark.createDataFrame(rows, schema or KINDS[kind]).coalesce(1), kind)

    def _merge(self) -> None:
        """Merges full tiers; what another writer has changed meanwhile is left for the next time."""
        for kind, schema in KINDS.items():
            m = self.manifest()
            for tier in {t for _, t in m[kind]}:
                old = [p for p, t in m[kind] if t == tier]
                if len(old) < FAN:
                    continue
                rows = self._alive(self.read(old, schema), m)
                if kind == "events" and self.config.trim and m["snapshots"]:
                    rows = writes.retained(rows, self.snapshots(m))
                name = self._write((writes.newest(rows) if kind == "snapshots" else rows).coalesce(1 if tier == 0 else 8), kind)
                m = self.manifest()
                if set(old) <= {p for p, _ in m[kind]}:
                    kept = [x for x in m[kind] if x[0] not in old]
                    self.publish(m | {kind: [[name, tier + 1], *kept]})

    # Reading

    def _alive(self, rows: DataFrame, m: dict, key: str | None = None) -> DataFrame:
        if key is not None:
            return rows.where((F.col(KEY) == key) & (F.col("version") > m["gone"].get(key, 0)))
        if not m["gone"]:
            return rows
        gone = self.spark.createDataFrame(list(m["gone"].items()), "gone_key string, gone_version long")
        return rows.join(gone, (F.col(KEY) == F.col("gone_key")) & (F.col("version") <= F.col("gone_version")), "left_anti")

    def _rows(self, kind: str, m: dict | None, key: str | None) -> DataFrame:
        """Of one entity, if a key is given: the filter goes down to the files."""
        m = m or self.manifest()
        return self._alive(self.read([p for p, _ in m[kind]], KINDS[kind]), m, key)

    def snapshots(self, m: dict | None = None, key: str | None = None) -> DataFrame:
        return writes.newest(self._rows("snapshots", m, key))

    def events(self, m: dict | None = None, key: str | None = None) -> DataFrame:
        m = m or self.manifest()
        log = self._rows("events", m, key)
        return writes.retained(log, self.snapshots(m, key)) if self.config.trim and m["snapshots"] else log

    def index(self, m: dict | None = None, key: str | None = None) -> DataFrame:
        """The last event of each commit that sets a status or labels, trimmed or not."""
        return self._rows("index", m, key)

    def heads(self, m: dict | None = None, key: str | None = None) -> DataFrame:
        m = m or self.manifest()
        return views.heads(self.events(m, key), self.snapshots(m, key))

    def key(self, aggregate_id: list[str]) -> str:
        if not aggregate_id:
            raise ValueError("an id needs at least one part")
        return "".join(f"{len(p.encode())}:{p};" for p in aggregate_id)

    def get_events(self, aggregate_id: list[str], start: int = 0) -> list:
        self._open()
        key = self.key(aggregate_id)
        return views.scan(self.events(None, key), key, start).collect()

    def head(self, aggregate_id: list[str], m: dict | None = None) -> int:
        row = self.heads(m, self.key(aggregate_id)).first()
        return row["head"] if row else 0

    def list_aggregates(self, prefix: list[str] | None = None) -> DataFrame:
        """aggregate_id, aggregate_key of entities that have events or a snapshot."""
        m = self.manifest()
        every = self._rows("events", m, None).select("aggregate_id", KEY).union(self._rows("snapshots", m, None).select("aggregate_id", KEY))
        return every.where(ids.has_prefix(F.col("aggregate_id"), prefix or [])).distinct()

    def status_of(self, aggregate_id: list[str]) -> str:
        """'' if it has none."""
        self._open()
        row = views.status_current(self.index(None, self.key(aggregate_id))).first()
        return row["status"] if row else ""

    def list_by_status(self, status: str) -> DataFrame:
        """aggregate_key, status, status_at, by time."""
        return views.by_status(self.index(), status)

    def list_by_label(self, label: str, value: str) -> DataFrame:
        """aggregate_key of the entities whose label has this value now."""
        return views.labels_current(self.index()).where((F.col("label") == label) & (F.col("value") == value)).select(KEY)

    def list_label_values(self, label: str) -> DataFrame:
        """value: those that the label has for some entity now."""
        return views.labels_current(self.index()).where(F.col("label") == label).select("value").distinct()

    # Writing

    def append(self, aggregate_id: list[str], expected: int, events: list[dict]) -> None:
        """events: dicts of event_at_ns, event_type, data. An empty list only checks the version."""
        self._open()
        key = self.key(aggregate_id)
        deltas = list(self.indexer(events)) if events and self.indexer else []
        status = next((s for s, _ in reversed(deltas) if s is not None), None)
        labels: dict[str, str] = {}
        for _, more in deltas:
            labels |= more or {}
        while True:
            m = self.manifest()
            actual = self.head(aggregate_id, m)
            if expected != actual:
                raise VersionConflict(expected, actual, views.scan(self.events(m, key), key, expected).collect() if expected < actual else [])
            if not events:
                return
            last, version = len(events) - 1, m["version"] + 1
            rows = [(list(aggregate_id), key, expected + i, expected, timestamp(e["event_at_ns"]), e["event_at_ns"], e["event_type"], e["data"], status if i == last else None, labels if i == last and labels else None, version) for i, e in enumerate(events)]
            name = self._write_rows(rows, "events")
            new = {"events": [*m["events"], [name, 0]]}
            if status is not None or labels:
                new["index"] = [*m["index"], [self._write_rows(rows[-1:], "index"), 0]]
            if self.publish(m | new, commit=name):
                self._merge()
                return

    def load(self, log: DataFrame, snapshots: DataFrame | None = None) -> None:
        """Publishes a whole log (and snapshots) of new entities as one commit.
        log: the columns of EVENTS less version; snapshots: those of SNAPSHOTS less version."""
        self._open()
        while True:
            m = self.manifest()
            version = F.lit(m["version"] + 1).cast("long").alias("version")
            name = self._write(log.select(*[c.split()[0] for c in EVENTS.split(", ")[:-1]], version), "events")
            rows = self.read([name], EVENTS)
            index = self._write(rows.where("status is not null or labels is not null"), "index")
            new = {"events": [*m["events"], [name, 9]], "index": [*m["index"], [index, 9]]}
            if snapshots is not None:
                kept = self._write(snapshots.select(*[c.split()[0] for c in SNAPSHOTS.split(", ")[:-1]], version), "snapshots")
                new["snapshots"] = [*m["snapshots"], [kept, 9]]
            if self.publish(m | new, commit=name):
                return

    def put_snapshot(self, aggregate_id: list[str], state, sequence: int) -> None:
        self._open()
        data = json.dumps(state)
        while True:
            m = self.manifest()
            name = self._write_rows([(list(aggregate_id), self.key(aggregate_id), sequence, data, m["version"] + 1)], "snapshots")
            if self.publish(m | {"snapshots": [*m["snapshots"], [name, 0]]}):
                self._merge()
                return

    def snapshot_and_tail(self, aggregate_id: list[str], m: dict | None = None) -> dict:
        """state (None: no snapshot), sequence, tail of events; bytes of both."""
        self._open()
        m, key = m or self.manifest(), self.key(aggregate_id)
        row = self.snapshots(m, key).first()
        text, seq = (row["snapshot_data"], row["snapshot_seq"]) if row else (None, 0)
        tail = views.scan(self._rows("events", m, key), key, seq).collect()
        size = len(text.encode()) if text is not None else 0
        return {"state": json.loads(text) if text is not None else None, "sequence": seq, "tail": tail, "snapshot_bytes": size, "tail_bytes": sum(len(e["data"].encode()) for e in tail)}

    def get_snapshot(self, aggregate_id: list[str]):
        """(state or None, sequence, tail of events)."""
        found = self.snapshot_and_tail(aggregate_id)
        return found["state"], found["sequence"], found["tail"]

    # Archive

    def archive(self, aggregate_id: list[str]) -> None:
        """Moves the entity out of the live log, so that its id can begin anew; a missing one is no error."""
        self._open()
        if not self.config.archiving:
            raise ArchivingDisabled("this store does not archive")
        key = self.key(aggregate_id)
        while True:
            m = self.manifest()
            found = self.snapshot_and_tail(aggregate_id, m)
            state, tail = found["state"], found["tail"]
            if state is None and not tail:
                return
            stream = f"{m['version'] + 1:020d}"
            row = (stream, key, found["sequence"], json.dumps(state) if state is not None else None, [(e["sequence"], e["event_type"], e["data"]) for e in tail])
            name = self._write_rows([row], "archive", ARCHIVE)
            if self.publish(m | {"archive": [*m["archive"], [stream, name]], "gone": m["gone"] | {key: m["version"]}}, archived=name):
                return

    def archived(self, m: dict | None = None) -> DataFrame:
        """Records that are not acknowledged yet."""
        m = m or self.manifest()
        return self.read([p for _, p in m["archive"]], ARCHIVE)

    def consume_archive(self, handler) -> bool:
        """Hands the oldest record that is not acknowledged to the handler; false if there is none. An error keeps the record."""
        self._open()
        m = self.manifest()
        if not m["archive"]:
            return False
        stream, path = m["archive"][0]
        handler(self.read([path], ARCHIVE).first())
        while True:
            m = self.manifest()
            if self.publish(m | {"archive": [x for x in m["archive"] if x[0] != stream]}):
                return True


class Command:
    """What a command raises events by. Calling it, with type and data, appends an
    event and returns the state after it."""

    def __init__(self, aggregate_id, state, fold: Callable):
        self.id, self.value, self.events, self.hooks, self._fold = aggregate_id, state, [], [], fold

    def __call__(self, event_type: str, data: str, event_at_ns: int = 0):
        self.events.append({"event_type": event_type, "data": data, "event_at_ns": event_at_ns})
        self.value = self._fold(self.value, self.events[-1:])
        return self.value

    def on_success(self, hook) -> None:
        """hook(state, events) runs once the events are stored, after the executor's own."""
        self.hooks.append(hook)


def make_applier(decode, f):
    """An applier f(state, value) of decoded data; what cannot be decoded leaves the state as it is."""

    def apply(state, data):
        try:
            value = decode(data)
        except (ValueError, KeyError, TypeError):
            return state
        return f(state, value)

    return apply


class Executor:
    """Runs commands on one entity: fold, command, append; again after a conflict.

    appliers: {event type: f(state, data) -> state}; types without one are skipped.
    States are cached; after a conflict the events that came between are folded in. A
    state that was read from the store is saved as a snapshot if its tail outweighs
    the last one by more than the store's ratio."""

    def __init__(self, store: EventStore, initial, appliers: dict, on_success=()):
        self.store, self.initial, self.appliers, self.on_success = store, initial, appliers, tuple(on_success)
        self._cache: OrderedDict[str, tuple] = OrderedDict()

    def _fold(self, state, events):
        for e in events:
            f = self.appliers.get(e["event_type"])
            if f:
                with contextlib.suppress(ValueError, KeyError, TypeError):  # what cannot be read leaves the state as it is
                    state = f(state, e["data"])
        return state

    def _keep(self, key: str, state, head: int) -> None:
        self._cache[key] = (state, head)
        self._cache.move_to_end(key)
        while len(self._cache) > self.store.config.cache:
            self._cache.popitem(last=False)

    def load(self, aggregate_id):
        """(state, next sequence), from the cache or the store."""
        key = self.store.key(aggregate_id)
        if key in self._cache:
            self._cache.move_to_end(key)
            return self._cache[key]
        found = self.store.snapshot_and_tail(aggregate_id)
        tail = found["tail"]
        state = self._fold(self.initial() if found["state"] is None else found["state"], tail)
        head = max(found["sequence"], tail[-1]["sequence"] + 1 if tail else 0)
        if tail and (not found["snapshot_bytes"] or found["tail_bytes"] / found["snapshot_bytes"] > self.store.config.snapshot_ratio):
            self.store.put_snapshot(aggregate_id, state, head)
        self._keep(key, state, head)
        return state, head

    def _caught_up(self, aggregate_id, state, conflict: VersionConflict) -> None:
        """The cached state after a conflict, if the events between are all there."""
        key, new = self.store.key(aggregate_id), conflict.new_events
        if new and [e["sequence"] for e in new] == list(range(conflict.expected, conflict.actual)):
            self._keep(key, self._fold(state, new), conflict.actual)
        else:
            self._cache.pop(key, None)

    def exec(self, aggregate_id, command):
        """command(state, raise_event): raise_event is a Command."""
        for _ in range(self.store.config.max_retries):
            state, head = self.load(aggregate_id)
            run = Command(aggregate_id, state, self._fold)
            command(state, run)
            try:
                self.store.append(aggregate_id, head, run.events)
            except VersionConflict as conflict:
                self._caught_up(aggregate_id, state, conflict)
                continue
            if run.events:
                self._keep(self.store.key(aggregate_id), run.value, head + len(run.events))
            for hook in (*self.on_success, *run.hooks):
                try:
                    hook(run.value, run.events)
                except Exception:
                    _log.exception("a success action of %s failed", aggregate_id)
            return run.value
        raise MaxRetriesExceeded(str(aggregate_id))

    def get(self, aggregate_id):
        return self.exec(aggregate_id, lambda state, raise_event: None)

    def save_snapshot(self, aggregate_id) -> None:
        state, head = self.load(aggregate_id)
        self.store.put_snapshot(aggregate_id, state, head)
