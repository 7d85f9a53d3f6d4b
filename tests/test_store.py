import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlog.functions import codec, ids
from strandlog.operators import views
from strandlog.sources.store import ArchivingDisabled, Closed, Config, EventStore, Executor, MaxRetriesExceeded, VersionConflict, make_applier
from strandlog.streaming import feed

AWKWARD = [["order:1", "part\\2", 'quoted["3"]'], ["order:1", "item"], ["order", "1", "item"], ["mem\x1f1", "item"], ["mem", "1\x1fitem"], ["", ""]]


def event(kind="test", data="{}", at=1_700_000_000_000_000_123):
    return {"event_at_ns": at, "event_type": kind, "data": data}


def test_append_load_and_conflicts(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    a = ["order", "1"]
    assert store.get_events(a) == []
    store.append(a, 0, [event(), event("other")])
    got = store.get_events(a)
    assert [(e["sequence"], e["event_at_ns"]) for e in got] == [(0, 1_700_000_000_000_000_123), (1, 1_700_000_000_000_000_123)]
    with pytest.raises(VersionConflict) as stale:
        store.append(a, 1, [event()])
    assert (stale.value.actual, [e["sequence"] for e in stale.value.new_events]) == (2, [1])
    with pytest.raises(VersionConflict) as ahead:
        store.append(a, 5, [])
    assert ahead.value.new_events == []
    store.append(a, 2, [])
    with pytest.raises(ValueError):
        store.append([], 0, [event()])
    store.close()
    with pytest.raises(Closed):
        store.get_events(a)


def test_one_of_many_writers_wins(spark, tmp_path):
    store, won = EventStore(spark, str(tmp_path / "s")), []

    def write():
        try:
            store.append(["a"], 0, [event()])
            won.append(1)
        except VersionConflict:
            pass

    threads = [threading.Thread(target=write) for _ in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1


def test_snapshot_trim_archive(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), Config(trim=True))
    store.append(["a"], 0, [event() for _ in range(4)])
    store.put_snapshot(["a"], {"n": 2}, 2)
    store.put_snapshot(["a"], {"n": 1}, 1)
    state, seq, tail = store.get_snapshot(["a"])
    assert (state, seq, [e["sequence"] for e in tail]) == ({"n": 2}, 2, [2, 3])
    assert [e["sequence"] for e in store.get_events(["a"])] == [2, 3]
    assert store.head(["a"]) == 4
    store.archive(["missing"])
    store.archive(["a"])
    assert store.get_events(["a"]) == [] and store.head(["a"]) == 0
    with pytest.raises(RuntimeError):
        store.consume_archive(lambda r: (_ for _ in ()).throw(RuntimeError("no")))
    seen = []
    assert store.consume_archive(seen.append) and not store.consume_archive(seen.append)
    assert seen[0]["snapshot_seq"] == 2 and len(seen[0]["events"]) == 2
    with pytest.raises(ArchivingDisabled):
        EventStore(spark, str(tmp_path / "t"), Config(archiving=False)).archive(["a"])


def test_executor(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    hooks = []
    ex = Executor(store, int, {"inc": lambda s, d: s + int(d), "reset": lambda s, d: 0}, [lambda s, r: 1 / 0, lambda s, r: hooks.append(len(r))])
    assert ex.exec(["c"], lambda s, put: [put("inc", "5"), put("inc", "bad"), put("odd", "1"), put("inc", "2")]) == 7
    assert ex.get(["c"]) == 7 and hooks == [4, 0]
    ex.save_snapshot(["c"])
    assert ex.load(["c"]) == (7, 4)


def test_ids(spark):
    table = spark.createDataFrame([(a,) for a in AWKWARD], "a array<string>")
    assert table.select(ids.key(F.col("a"))).distinct().count() == len(AWKWARD)
    for sep in (":", "\x1f"):
        joined = [r[0] for r in table.select(ids.escaped(F.col("a"), sep)).collect()]
        assert [ids.parse_escaped(j, sep) for j in joined] == AWKWARD and len(set(joined)) == len(AWKWARD)


def test_binary_codec():
    b = codec.encode_event(123_000_000_456, 7, ["flow", "1"], "event.test", '{"value":1}')
    assert codec.decode_event(b) == (123_000_000_456, 7, ["flow", "1"], "event.test", '{"value":1}')
    for n in range(len(b)):
        with pytest.raises(codec.Corrupt):
            codec.decode_event(b[:n])


def indexer(events):
    return [(json.loads(e["data"]).get("status"), json.loads(e["data"]).get("labels")) for e in events]


def test_index_outlives_trimming(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), Config(trim=True), indexer)
    store.append(["a"], 0, [event(data='{"status": "open", "labels": {"env": "dev", "x": "1"}}'), event(data='{"labels": {"x": ""}}')])
    store.append(["b"], 0, [event(data='{"status": "open", "labels": {"env": "prod"}}', at=1)])
    store.put_snapshot(["a"], {}, 2)
    store.put_snapshot(["c"], {}, 3)
    assert store.events().where("aggregate_key = '1:a;'").count() == 0 and store.head(["a"]) == 2
    assert store.status_of(["a"]) == "open" and store.status_of(["c"]) == "" == store.status_of(["none"])
    assert [r.aggregate_key for r in store.list_by_status("open").collect()] == ["1:b;", "1:a;"] and store.list_by_status("").count() == 0
    assert {r.aggregate_key for r in store.list_by_label("env", "dev").collect()} == {"1:a;"}
    assert {r.value for r in store.list_label_values("env").collect()} == {"dev", "prod"} and store.list_label_values("x").count() == 0
    assert {tuple(r.aggregate_id) for r in store.list_aggregates().collect()} == {("a",), ("b",), ("c",)}
    assert store.list_aggregates(["c"]).count() == 1
    # The views of a log serve the store's.
    plain = EventStore(spark, str(tmp_path / "s"))
    assert views.status_current(plain.events()).count() == 2 == views.status_entered(plain.events()).count()
    assert views.by_label(plain.events(), "env", "dev").first().head == 2
    store.append(["a"], 2, [event(data='{"status": ""}')])
    assert store.status_of(["a"]) == ""


def test_archived_id_begins_anew(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), None, indexer)
    store.append(["a"], 0, [event(data='{"status": "open"}')])
    store.append(["b"], 0, [event()])
    store.archive(["a"])
    assert store.status_of(["a"]) == "" and {tuple(r.aggregate_id) for r in store.list_aggregates().collect()} == {("b",)}
    store.append(["a"], 0, [event("new")])
    assert [e["event_type"] for e in store.get_events(["a"])] == ["new"] and store.archived().count() == 1


def test_folders_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("strandlog.sources.store.FAN", 3)
    store = EventStore(spark, str(tmp_path / "s"))
    for i in range(10):
        store.append(["a"], i, [event(str(i))])
    assert len(store.manifest()["events"]) <= 4 and [e["event_type"] for e in store.get_events(["a"])] == list(map(str, range(10)))
    trims = EventStore(spark, str(tmp_path / "t"), Config(trim=True))
    trims.append(["a"], 0, [event(str(i)) for i in range(5)])
    trims.put_snapshot(["a"], {}, 4)
    for i in (5, 6):
        trims.append(["a"], i, [event(str(i))])
    m = trims.manifest()
    assert len(m["events"]) == 1 and trims.read([m["events"][0][0]], "sequence long").count() == 3 and trims.head(["a"]) == 7


def test_filter_by_key_reaches_the_files(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    store.append(["a"], 0, [event()])
    store.archive(["b"])
    assert "EqualTo(aggregate_key,1:a;)" in store.heads(None, "1:a;")._jdf.queryExecution().toString()


def test_ready(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    assert store.wait_ready(1)
    store.close()
    assert not store.wait_ready(0.1)


def test_snapshot_by_ratio_hooks_and_retries(spark, tmp_path, caplog):
    store, order = EventStore(spark, str(tmp_path / "s"), Config(snapshot_ratio=2.0, max_retries=2)), []
    appliers = {"inc": make_applier(int, lambda s, n: s + n)}
    first = Executor(store, int, appliers, [lambda s, e: order.append("default"), lambda s, e: 1 / 0])

    def command(state, put):
        put.on_success(lambda s, e: order.append(("own", s, len(e))))
        put("inc", "1")
        put("inc", "bad")

    assert first.exec(["c"], command) == 1 and order == ["default", ("own", 1, 2)] and "ZeroDivisionError" in caplog.text
    assert store.get_snapshot(["c"])[1] == 0  # what is cached is not saved
    assert Executor(store, int, appliers).load(["c"]) == (1, 2) and store.get_snapshot(["c"])[:2] == (1, 2)
    first.exec(["c"], lambda s, put: put("inc", "1"))
    assert Executor(store, int, appliers).load(["c"]) == (2, 3) and store.get_snapshot(["c"])[1] == 2  # one byte is not more than twice one
    # A conflict is caught up with what came between.
    other = Executor(store, int, appliers)
    other.exec(["c"], lambda s, put: put("inc", "5"))
    assert first.get(["c"]) == 7
    with pytest.raises(MaxRetriesExceeded):
        first.exec(["c"], lambda s, put: (other.exec(["c"], lambda t, more: more("inc", "1")), put("inc", "1")))


def test_publish_from_now_on(spark, tmp_path):
    store, seen = EventStore(spark, str(tmp_path / "s")), []
    store.append(["a"], 0, [event("before")])

    def go(handler):
        feed.publish(store, handler, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    def handler(batch):
        seen.extend(r.event_type for r in batch.orderBy("sequence").collect())

    go(handler)
    store.append(["a"], 1, [event("one"), event("two")])
    store.append(["b"], 0, [event("three")])
    with pytest.raises(Exception, match="no"):
        go(lambda batch: (_ for _ in ()).throw(RuntimeError("no")))
    go(handler)
    store.append(["a"], 3, [event("four")])
    go(handler)
    assert seen == ["one", "two", "three", "four"]


def test_typed_handlers(spark):
    rows = [("a", 0, "n", '{"k": 1}'), ("a", 1, "n", '{"k": '), ("a", 2, "odd", "x")]
    events, got = spark.createDataFrame(rows, feed.COLUMNS), []
    assert [r.value.k for r in views.typed(events.where("event_type = 'n'"), "k bigint").collect()] == [1]
    run = feed.dispatcher({"n": feed.typed_handler("k bigint", lambda e: got.extend(r.value.k for r in e.collect()))})
    run(events.where("sequence <> 1"))
    assert got == [1]
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        run(events)


def test_runs_of_early_events():
    rng = random.Random(4)
    for _ in range(300):
        kinds = [rng.choice(["purchase", "view", "error", "click"]) for _ in range(rng.randint(1, 30))]
        value, following, waiting = 0, 0, []
        order = list(range(len(kinds))) + [rng.randrange(len(kinds)) for _ in range(5)]
        rng.shuffle(order)
        for at in range(0, len(order), 4):
            part = np.array([i for i in order[at : at + 4] if i >= following and not any(a <= i < b for a, b, _, _ in waiting)], int)
            kind = np.array([kinds[i] for i in part], object)
            waiting = feed.merged([*waiting, *feed.runs(part, (kind == "purchase").astype(int) - (kind == "view"), kind == "error")])
            if waiting and waiting[0][0] == following:
                _, following, was_reset, since = waiting.pop(0)
                value = since if was_reset else value + since
        want = 0
        for k in kinds:
            want = 0 if k == "error" else want + (k == "purchase") - (k == "view")
        assert (value, following, waiting) == (want, len(kinds), [])


def test_stream_after_a_restart_and_rebuilt(spark, tmp_path):
    rows = [("a", i, k, "{}") for i, k in enumerate(["purchase", "purchase", "error", "view", "purchase", "purchase"])]
    log, out = spark.createDataFrame(rows, feed.COLUMNS), {}

    def go(checkpoint):
        def keep(batch, n):
            out.update({r.aggregate_key: (r.value, r.next_seq) for r in batch.collect()})

        feed.counters(feed.feed(spark, str(tmp_path / "in"))).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()

    log.where("sequence <> 1").write.parquet(str(tmp_path / "in"))
    go("cp")
    assert out == {"a": (1, 1)}
    log.where("sequence < 3").write.mode("append").parquet(str(tmp_path / "in"))
    go("cp")
    assert out == {"a": (1, 6)}
    out.clear()
    go("anew")  # a projection is rebuilt from the log by a new checkpoint
    assert out == {"a": (1, 6)} == {r.aggregate_key: (r.value, 6) for r in views.counter(log).collect()}


def test_json_lines_are_checked(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"event_at_ns": 1, "event_type": "n", "aggregate_id": ["a"], "data": "", "sequence": 0}\n{"event_at_ns": \n')
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        codec.read_lines(spark, str(tmp_path / "bad.json")).collect()


def test_archive_records_as_a_stream(spark, tmp_path):
    store, seen = EventStore(spark, str(tmp_path / "s")), []
    for a in ("a", "b"):
        store.append([a], 0, [event(a)])

    def go():
        feed.publish(store, lambda batch: seen.extend(r.aggregate_key for r in batch.collect()), str(tmp_path / "cp"), "archived").trigger(availableNow=True).start().awaitTermination()

    go()
    store.archive(["b"])
    store.archive(["a"])
    go()
    assert seen == ["1:b;", "1:a;"]


def test_config():
    c = Config().overlaid(max_retries=3, trim=None)
    assert (c.max_retries, c.trim, c.overlaid(trim=True).max_retries) == (3, False, 3)
    for bad in ({"max_retries": 0}, {"snapshot_ratio": -1.0}, {"cache": -1}):
        with pytest.raises(ValueError):
            Config().overlaid(**bad)


def test_large_batches_and_payloads(spark, tmp_path):
    store, a = EventStore(spark, str(tmp_path / "s")), ["big\x1f", "ä;3:"]
    store.append(a, 0, [event(str(i)) for i in range(300)])
    big = json.dumps({"x": "é" * 98_304})
    store.append(a, 300, [event("big", big) for _ in range(24)])
    got = store.get_events(a, 299)
    assert [e["sequence"] for e in got] == list(range(299, 324)) and got[-1]["data"] == big and got[0]["aggregate_id"] == a
    assert store.get_events(a, -5)[0]["sequence"] == 0 and store.get_events(a, 400) == [] and store.head(a) == 324


def test_versions_are_stable(spark, tmp_path):
    """A reader of one version does not see later ones."""
    store = EventStore(spark, str(tmp_path / "s"))
    store.append(["a"], 0, [event()])
    old = store.manifest()
    store.append(["a"], 1, [event()])
    store.archive(["a"])
    assert store.events(old).count() == 1 and store.head(["a"], old) == 1 and store.head(["a"]) == 0
