"""Named queries over the test tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, ids, values
from ..operators import views, writes
from ..sources.adapters import order_log, user_log
from ..sources.shared import shared_dir
from ..sources.store import Config, EventStore

KEY = views.KEY


def _snapshots(log: DataFrame) -> DataFrame:
    """Every user at floor(head / 2); of even users also an older save, at floor(head / 4)."""
    h = log.groupBy(KEY, "user_id").agg((F.max("sequence") + 1).alias("head"))
    data = F.concat(F.lit('{"n":'), F.col("snapshot_seq").cast("string"), F.lit("}"))
    new = h.select(KEY, "user_id", F.expr("head div 2").alias("snapshot_seq"), F.lit(2).cast("long").alias("version"))
    old = h.where("user_id % 2 = 0").select(KEY, "user_id", F.expr("head div 4").alias("snapshot_seq"), F.lit(1).cast("long").alias("version"))
    return new.union(old).withColumn("snapshot_data", data)


def _requests(log: DataFrame) -> DataFrame:
    h = log.groupBy(KEY, "user_id").agg((F.max("sequence") + 1).alias("head"))
    expected = F.when(F.col("user_id") % 7 == 0, F.col("head") + 3).when(F.col("user_id") % 2 == 0, F.col("head")).otherwise(F.col("head") - 1)
    return h.select(KEY, expected.alias("expected"), F.when(F.col("user_id") % 11 == 0, 0).otherwise(1).cast("long").alias("n_events"))


def _archive(log: DataFrame) -> DataFrame:
    a = writes.archive(log, _snapshots(log), log.where("user_id % 10 = 0").select(KEY).distinct())
    return a.join(log.select(KEY, "user_id").distinct(), KEY).withColumn("stream_id", F.lpad(F.col("user_id").cast("string"), 20, "0"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q10(spark, sf_dir)


def q01(s, d):
    return user_log(s, d).select(KEY, "sequence", "commit_seq", "event_type")


def q02(s, d):
    return views.scan(user_log(s, d), "4:user;1:7;", 10).select(KEY, "sequence", "event_type", "data")


def q03(s, d):
    return user_log(s, d).select(KEY).distinct().union(order_log(s, d).select(KEY).distinct())


def q04(s, d):
    every = user_log(s, d).select("aggregate_id", KEY).distinct().union(order_log(s, d).select(F.array(F.lit("order"), F.col("o_orderkey").cast("string")), KEY).distinct())
    return every.where(ids.has_prefix(F.col("aggregate_id"), ["order"])).select(KEY)


def q05(s, d):
    """Some entities have a snapshot and no events."""
    log = user_log(s, d)
    only = s.range(900_000, 900_003).select(ids.key(F.array(F.lit("user"), F.col("id").cast("string"))).alias(KEY))
    return log.select(KEY).union(_snapshots(log).select(KEY)).union(only).distinct()


def q06(s, d):
    return user_log(s, d).select(KEY, "sequence", F.get_json_object("data", "$.k").cast("long").alias("k"))


def q07(s, d):
    return user_log(s, d).select(KEY, ids.escaped(F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.lit("a\\b")), ":").alias("joined")).distinct()


def q08(s, d):
    log = user_log(s, d)
    return views.heads(log, _snapshots(log).withColumn("snapshot_seq", F.expr("snapshot_seq * 3")))


def q09(s, d):
    """With an indexer by which a click clears the status."""
    log = user_log(s, d)
    return views.status_current(views.indexed(log, F.when(F.col("event_type") == "click", F.lit("")).otherwise(F.col("status")), F.col("labels")))


def q10(s, d):
    return views.by_status(user_log(s, d), "paid")


def q11(s, d):
    return views.status_entered(user_log(s, d))


def q12(s, d):
    return views.labels_current(user_log(s, d))


def q13(s, d):
    return views.by_label(user_log(s, d), "k", "7")


def q14(s, d):
    return views.counter(user_log(s, d))


def q15(s, d):
    return views.order_state(order_log(s, d))


def q16(s, d):
    return views.running_counter(user_log(s, d))


def q17(s, d):
    return writes.newest(_snapshots(user_log(s, d))).select(KEY, "snapshot_seq", "version")


def q18(s, d):
    log = user_log(s, d)
    snap = writes.newest(_snapshots(log)).select(KEY, "snapshot_seq")
    before = log.join(snap, KEY).where("sequence < snapshot_seq")
    state = snap.join(views.counter(before).withColumnRenamed("value", "start"), KEY, "left").select(KEY, "snapshot_seq", F.coalesce("start", F.lit(0)).cast("long").alias("start"))
    return views.counter(log, state=state)


def q19(s, d):
    log = user_log(s, d)
    return writes.due(log, writes.newest(_snapshots(log)).select(KEY, "snapshot_seq", F.repeat("snapshot_data", 25).alias("snapshot_data")))


def q20(s, d):
    log = user_log(s, d)
    return writes.resolve(_requests(log), views.heads(log)).select(KEY, "expected", "actual", "accepted")


def q21(s, d):
    log = user_log(s, d)
    return writes.conflicts(writes.resolve(_requests(log), views.heads(log)), log)


def q22(s, d):
    log = user_log(s, d)
    return writes.retained(log, _snapshots(log)).select(KEY, "sequence")


def q23(s, d):
    log = user_log(s, d)
    wanted = s.range(0, 2000).select(ids.key(F.array(F.lit("user"), F.col("id").cast("string"))).alias(KEY))
    return writes.absent(wanted, views.heads(log))


def q24(s, d):
    return _archive(user_log(s, d)).select(KEY, "snapshot_seq", "n_events")


def q25(s, d):
    log = user_log(s, d)
    return writes.live(views.heads(log), _archive(log))


def q26(s, d):
    a = _archive(user_log(s, d))
    return writes.pending(a, a.where("user_id % 20 = 0")).orderBy("stream_id").select("stream_id", KEY)


def q27(s, d):
    """Of a log in which some users lack an event and some have one twice."""
    log = user_log(s, d)
    return views.audit(log.where("user_id % 5 <> 0 or sequence <> 1").union(log.where("user_id % 3 = 0 and sequence = 0")))


def q28(s, d):
    """What handlers get of a stream, by type; types without one are ignored."""
    from ..streaming.feed import dispatch, feed

    path, log = f"{shared_dir(s)}/dispatch-{uuid.uuid4().hex}", user_log(s, d).select(KEY, "sequence", "event_type", "data")
    log.write.parquet(f"{path}/in")

    def handler(kind):
        return lambda batch: batch.write.mode("append").parquet(f"{path}/out/{kind}")

    dispatch(feed(s, f"{path}/in"), {k: handler(k) for k in ("purchase", "view", "error")}, f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = s.read.parquet(f"{path}/out/*").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    every = log.groupBy("event_type").agg(F.count(F.lit(1)).alias("m"))
    return every.join(got, "event_type", "left").select("event_type", F.col("n").isNotNull().alias("handled"), F.coalesce("n", "m").alias("n"))


def q29(s, d):
    return views.label_values(views.labels_current(user_log(s, d))).orderBy("value")


def q30(s, d):
    return views.commits(user_log(s, d)).groupBy(KEY).agg(F.sum("n_events").alias("n_events"), F.count(F.lit(1)).alias("n_commits"))


def q31(s, d):
    return codec.decoded(codec.encoded(user_log(s, d))).select(KEY, "sequence", "event_at_ns", "event_type", "data")


def q32(s, d):
    """The stream's projection after all that is there, by keeping each entity's last
    value. Events come in two parts, mixed, the second with some of the first again; the stream is started anew for it."""
    from ..streaming.feed import counters, feed

    path, log = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}", user_log(s, d).select(KEY, "sequence", "event_type", "data")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/out/b{n}")

    for part in ("sequence % 3 <> 1", "sequence % 3 <> 2"):
        log.where(part).write.mode("append").parquet(f"{path}/in")
        counters(feed(s, f"{path}/in")).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    out = s.read.parquet(f"{path}/out/*")
    return out.groupBy(KEY).agg(F.max_by("value", F.struct("next_seq", "batch")).alias("value"))


def q33(s, d):
    log = user_log(s, d)
    h = views.heads(log)
    r = h.select(KEY, F.explode(F.expr("sequence(0L, 3L)")).alias("arrival"), F.col("head").alias("h"))
    r = r.select(KEY, "arrival", (F.col("h") + F.when(F.col("arrival") == 3, 2).otherwise(F.expr("arrival div 2"))).alias("expected"), F.lit(1).cast("long").alias("n_events"))
    return writes.chain(r, h)


def q34(s, d):
    """The counter as an ordered fold."""
    def step(state, e):
        kind = e["event_type"]
        return F.when(kind == "error", F.lit(0).cast("long")).otherwise(state + F.when(kind == "purchase", 1).when(kind == "view", -1).otherwise(0))

    return views.fold(user_log(s, d), F.lit(0).cast("long"), step).withColumnRenamed("state", "value")


def q43(s, d):
    """The counter as a fold by Python appliers."""
    appliers = {"purchase": lambda n, _: n + 1, "view": lambda n, _: n - 1, "error": lambda n, _: 0}
    return views.fold_python(user_log(s, d), int, appliers).select(KEY, F.col("state").cast("long").alias("value"))


def q44(s, d):
    """Events as JSON lines and back."""
    path = f"{shared_dir(s)}/lines-{uuid.uuid4().hex}"
    codec.write_lines(user_log(s, d), path)
    return codec.read_lines(s, path).select(ids.key(F.col("aggregate_id")).alias(KEY), "sequence", "event_at_ns", "event_type", "data")


def q45(s, d):
    """Labels by laying each event's map over those before."""
    maps = F.transform(F.sort_array(F.collect_list(F.struct("sequence", F.to_json("labels").alias("m")))), lambda e: F.from_json(e["m"], "map<string,string>"))
    return user_log(s, d).groupBy(KEY).agg(maps.alias("maps")).select(KEY, F.explode(values.overlaid(F.col("maps"))).alias("label", "value"))


def q46(s, d):
    """Times of events."""
    odd = F.col("event_at_ns") + F.pmod(F.col("sequence"), F.lit(3)) * 7
    return user_log(s, d).select(KEY, "sequence", values.millis(odd).alias("millis"), values.rfc3339(odd).alias("at"))


def q47(s, d):
    """Commits as arrays of events, numbered again by their place from the commit's sequence on."""
    events = F.transform(F.sort_array(F.collect_list(F.struct("sequence", "event_type"))), lambda e: e["event_type"])
    batches = user_log(s, d).groupBy(KEY, "commit_seq").agg(events.alias("batch"))
    return batches.select(KEY, "commit_seq", F.posexplode("batch").alias("place", "event_type")).select(KEY, (F.col("commit_seq") + F.col("place")).alias("sequence"), "event_type")


def q35(s, d):
    """Forms of an id and of a sequence."""
    heads = user_log(s, d).groupBy("aggregate_id", KEY).agg(F.max("sequence").alias("last"))
    return heads.select(KEY, ids.display(F.col("aggregate_id")).alias("display"), ids.base64url(F.col(KEY)).alias("encoded"), ids.padded(F.col("last")).alias("last"))


def q36(s, d):
    """Events as JSON and back."""
    log = user_log(s, d)
    back = log.select(KEY, codec.from_json(codec.to_json("event_at_ns", "event_type", "aggregate_id", "data", "sequence")).alias("e"))
    return back.select(KEY, "e.sequence", "e.event_at_ns", "e.event_type", "e.data", F.element_at("e.aggregate_id", 2).alias("user"))


def q37(s, d):
    """A typed fold; events whose data cannot be decoded leave the sum as it is."""
    log = user_log(s, d)
    cut = log.withColumn("data", F.when(F.col("sequence") % 4 == 3, F.expr("left(data, length(data) - 1)")).otherwise(F.col("data")))
    sums = views.typed(cut, "k bigint").groupBy(KEY).agg(F.sum("value.k").alias("total"))
    return views.heads(log).join(sums, KEY, "left").select(KEY, F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def _store(s, d) -> EventStore:
    """The users' log in a store that trims at its snapshots; every entity's newest is at its head, and one has nothing else."""
    path = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    if not path.startswith(("file:", "/")):
        raise ValueError("an EventStore needs a POSIX file system")
    store = EventStore(s, path.removeprefix("file://"), Config(trim=True))
    log = user_log(s, d)
    at = log.groupBy("aggregate_id", KEY).agg((F.max("sequence") + 1).alias("snapshot_seq"))
    only = F.array(F.lit("user"), F.lit("900000"))
    at = at.union(s.range(1).select(only.alias("aggregate_id"), ids.key(only).alias(KEY), F.lit(5).cast("long").alias("snapshot_seq")))
    store.load(log, at.withColumn("snapshot_data", F.lit("{}")))
    return store


def q38(s, d):
    return _store(s, d).list_by_status("paid")


def q39(s, d):
    return _store(s, d).list_by_label("k", "7")


def q40(s, d):
    store = _store(s, d)
    return store.list_aggregates(["user"]).join(store.heads(), KEY).select(KEY, "head")


def q41(s, d):
    return _store(s, d).list_label_values("k")


def q42(s, d):
    """The status of one entity."""
    store = _store(s, d)
    return s.createDataFrame([(u, store.status_of(["user", str(u)])) for u in (1, 7, 900000)], "user_id long, status string")


_U = """ev0 AS (SELECT user_id, event_id, CAST(ts AS TIMESTAMP) AS ts, event_type, props, concat('4:user;', length(CAST(user_id AS VARCHAR)), ':', user_id, ';') AS aggregate_key,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence,
  CASE event_type WHEN 'signup' THEN 'active' WHEN 'purchase' THEN 'paid' WHEN 'error' THEN 'failed' END AS st, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ev AS (SELECT *, min(sequence) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS commit_seq FROM ev0),
h AS (SELECT user_id, aggregate_key, max(sequence) + 1 AS head FROM ev GROUP BY ALL),
sn AS (SELECT user_id, aggregate_key, head // 2 AS snapshot_seq, CAST(2 AS BIGINT) AS version FROM h UNION ALL SELECT user_id, aggregate_key, head // 4, 1 FROM h WHERE user_id % 2 = 0),
sm AS (SELECT user_id, aggregate_key, max(snapshot_seq) AS snapshot_seq FROM sn GROUP BY ALL),
cm AS (SELECT aggregate_key, commit_seq, count(*) AS n_events, arg_max(st, sequence) FILTER (WHERE st IS NOT NULL) AS status, arg_max(ts, sequence) AS status_at FROM ev GROUP BY ALL),
sc AS (SELECT aggregate_key, arg_max(status, commit_seq) AS status, arg_max(status_at, commit_seq) AS status_at FROM cm WHERE status IS NOT NULL GROUP BY 1),
lc AS (SELECT aggregate_key, 'k' AS label, arg_max(CASE WHEN k % 10 = 0 THEN '' ELSE CAST(k AS VARCHAR) END, sequence) AS value FROM ev GROUP BY 1),
lv AS (SELECT * FROM lc WHERE value <> ''),
lr AS (SELECT aggregate_key, max(sequence) FILTER (WHERE event_type = 'error') AS r FROM ev GROUP BY 1),
ct AS (SELECT aggregate_key, CAST(sum(CASE WHEN sequence > coalesce(r, -1) THEN CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN -1 ELSE 0 END ELSE 0 END) AS BIGINT) AS value FROM ev JOIN lr USING (aggregate_key) GROUP BY 1),
rq AS (SELECT aggregate_key, CASE WHEN user_id % 7 = 0 THEN head + 3 WHEN user_id % 2 = 0 THEN head ELSE head - 1 END AS expected, head AS actual FROM h),
ar AS (SELECT h.user_id, h.aggregate_key, snapshot_seq, head - snapshot_seq AS n_events, lpad(CAST(h.user_id AS VARCHAR), 20, '0') AS stream_id FROM h JOIN sm USING (aggregate_key) WHERE h.user_id % 10 = 0)"""
_O = "concat('5:order;', length(CAST(o_orderkey AS VARCHAR)), ':', o_orderkey, ';') AS aggregate_key"


def _sql() -> dict[str, str]:
    it = """it AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem),
li AS (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY n DESC) = 1),
t AS (SELECT l_orderkey, count(*) AS n_items, sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT)) AS total_cents FROM li GROUP BY 1)"""
    body = {
        "q01": "SELECT aggregate_key, sequence, commit_seq, event_type FROM ev",
        "q02": "SELECT aggregate_key, sequence, event_type, props AS data FROM ev WHERE user_id = 7 AND sequence >= 10",
        "q03": f"SELECT aggregate_key FROM h UNION ALL SELECT DISTINCT {_O} FROM orders",
        "q04": f"SELECT DISTINCT {_O} FROM orders",
        "q05": "SELECT aggregate_key FROM h UNION SELECT aggregate_key FROM sn UNION SELECT concat('4:user;6:', i, ';') FROM range(900000, 900003) t(i)",
        "q06": "SELECT aggregate_key, sequence, k FROM ev",
        "q07": "SELECT DISTINCT aggregate_key, concat('user\\:', user_id, ':a\\\\b') AS joined FROM ev",
        "q08": "SELECT aggregate_key, greatest(head, 3 * snapshot_seq, 0) AS head FROM h JOIN sm USING (aggregate_key)",
        "q09": "SELECT * FROM (SELECT aggregate_key, arg_max(status, commit_seq) AS status, arg_max(status_at, commit_seq) AS status_at FROM (SELECT aggregate_key, commit_seq, arg_max(s2, sequence) FILTER (WHERE s2 IS NOT NULL) AS status, arg_max(ts, sequence) AS status_at FROM (SELECT *, CASE event_type WHEN 'click' THEN '' ELSE st END AS s2 FROM ev) GROUP BY ALL) WHERE status IS NOT NULL GROUP BY 1) WHERE status <> ''",
        "q10": "SELECT * FROM sc WHERE status = 'paid'",
        "q11": "SELECT sc.*, entered_at FROM sc JOIN (SELECT aggregate_key, max(status_at) AS entered_at FROM (SELECT *, lag(status) OVER (PARTITION BY aggregate_key ORDER BY commit_seq) AS p FROM cm WHERE status IS NOT NULL) WHERE p IS NULL OR p <> status GROUP BY 1) USING (aggregate_key)",
        "q12": "SELECT * FROM lv",
        "q13": "SELECT lv.*, head FROM lv JOIN h USING (aggregate_key) WHERE value = '7'",
        "q14": "SELECT * FROM ct",
        "q15": f"SELECT {_O}, CASE o_orderstatus WHEN 'O' THEN 'confirmed' WHEN 'P' THEN 'shipped' ELSE 'delivered' END AS status, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, CAST(coalesce(total_cents, 0) AS BIGINT) AS total_cents FROM orders LEFT JOIN t ON l_orderkey = o_orderkey",
        "q16": "SELECT aggregate_key, sequence, CAST(sum(CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END) OVER (PARTITION BY aggregate_key ORDER BY sequence) AS BIGINT) AS value FROM ev WHERE event_type IN ('purchase', 'view')",
        "q17": "SELECT aggregate_key, snapshot_seq, version FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_key ORDER BY snapshot_seq DESC, version DESC) AS r FROM sn) WHERE r = 1",
        "q18": "SELECT * FROM ct",
        "q19": "SELECT * FROM (SELECT ev.aggregate_key, CAST(sum(strlen(props)) AS BIGINT) AS tail_bytes, CAST(25 * strlen(concat('{\"n\":', snapshot_seq, '}')) AS BIGINT) AS snapshot_bytes FROM ev JOIN sm USING (aggregate_key) WHERE sequence >= snapshot_seq GROUP BY ev.aggregate_key, snapshot_seq) WHERE tail_bytes / snapshot_bytes > 1.0",
        "q20": "SELECT *, expected = actual AS accepted FROM rq",
        "q21": "SELECT rq.*, greatest(actual - expected, 0) AS n_new FROM rq WHERE expected <> actual",
        "q22": "SELECT ev.aggregate_key, sequence FROM ev JOIN sm USING (aggregate_key) WHERE sequence >= snapshot_seq",
        "q23": "SELECT w.aggregate_key FROM (SELECT concat('4:user;', length(CAST(i AS VARCHAR)), ':', i, ';') AS aggregate_key FROM range(2000) t(i)) w ANTI JOIN h USING (aggregate_key)",
        "q24": "SELECT aggregate_key, snapshot_seq, n_events FROM ar",
        "q25": "SELECT aggregate_key, head FROM h ANTI JOIN ar USING (aggregate_key)",
        "q26": "SELECT stream_id, aggregate_key FROM ar WHERE user_id % 20 <> 0",
        "q27": "SELECT CAST(sum(head - (user_id % 5 = 0 AND head > 1)::INT + (user_id % 3 = 0)::INT) AS BIGINT) AS n_events, count(*) FILTER (WHERE user_id % 5 = 0 AND head > 2) AS n_gaps, count(*) FILTER (WHERE user_id % 3 = 0) AS n_repeats FROM h",
        "q28": "SELECT event_type, event_type IN ('purchase', 'view', 'error') AS handled, count(*) AS n FROM ev GROUP BY ALL",
        "q29": "SELECT label, value, count(*) AS n_aggregates FROM lv GROUP BY ALL",
        "q30": "SELECT aggregate_key, CAST(sum(n_events) AS BIGINT) AS n_events, count(*) AS n_commits FROM cm GROUP BY 1",
        "q31": "SELECT aggregate_key, sequence, epoch_us(ts) * 1000 AS event_at_ns, event_type, props AS data FROM ev",
        "q32": "SELECT * FROM ct",
        "q34": "SELECT * FROM ct",
        "q43": "SELECT * FROM ct",
        "q44": "SELECT aggregate_key, sequence, epoch_us(ts) * 1000 AS event_at_ns, event_type, props AS data FROM ev",
        "q45": "SELECT * FROM lv",
        "q46": "SELECT aggregate_key, sequence, epoch_us(ts) // 1000 AS millis, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE WHEN ns = 0 THEN '' ELSE concat('.', rtrim(lpad(CAST(ns AS VARCHAR), 9, '0'), '0')) END, 'Z') AS at FROM (SELECT *, (epoch_us(ts) * 1000 + 7 * (sequence % 3)) % 1000000000 AS ns FROM ev)",
        "q47": "SELECT aggregate_key, sequence, event_type FROM ev",
        "q35": "SELECT aggregate_key, concat('[\"user\",\"', user_id, '\"]') AS display, replace(replace(rtrim(to_base64(encode(aggregate_key)), '='), '+', '-'), '/', '_') AS encoded, lpad(CAST(head - 1 AS VARCHAR), 20, '0') AS last FROM h",
        "q36": "SELECT aggregate_key, sequence, epoch_us(ts) * 1000 AS event_at_ns, event_type, props AS data, CAST(user_id AS VARCHAR) AS user FROM ev",
        "q37": "SELECT aggregate_key, CAST(coalesce(sum(CASE WHEN sequence % 4 <> 3 THEN k END), 0) AS BIGINT) AS total FROM ev GROUP BY 1",
        "q38": "SELECT * FROM sc WHERE status = 'paid'",
        "q39": "SELECT aggregate_key FROM lv WHERE value = '7'",
        "q40": "SELECT aggregate_key, head FROM h UNION ALL SELECT '4:user;6:900000;', 5",
        "q41": "SELECT DISTINCT value FROM lv",
        "q42": "SELECT u AS user_id, coalesce(status, '') AS status FROM (VALUES (1), (7), (900000)) t(u) LEFT JOIN sc ON aggregate_key = concat('4:user;', length(CAST(u AS VARCHAR)), ':', u, ';')",
        "q33": "SELECT aggregate_key, CAST(a AS BIGINT) AS arrival, head + CASE a WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS actual, a IN (0, 2, 3) AS accepted FROM h, range(4) r(a)",
    }
    return {q: f"WITH {_U}, {it} {sql}" for q, sql in body.items()}


NAMES = {
    "q01": "q01_sequence", "q02": "q02_scan", "q03": "q03_list", "q04": "q04_prefix", "q05": "q05_union_ids", "q06": "q06_payload", "q07": "q07_escaped_id", "q08": "q08_heads",
    "q09": "q09_status", "q10": "q10_by_status", "q11": "q11_status_entered", "q12": "q12_labels", "q13": "q13_by_label", "q14": "q14_counter", "q15": "q15_orders", "q16": "q16_running",
    "q17": "q17_newest_snapshot", "q18": "q18_snapshot_tail", "q19": "q19_snapshot_due", "q20": "q20_append", "q21": "q21_conflicts", "q22": "q22_retained", "q23": "q23_absent",
    "q24": "q24_archive", "q25": "q25_live", "q26": "q26_pending", "q27": "q27_audit", "q28": "q28_dispatch", "q29": "q29_label_values", "q30": "q30_counts", "q31": "q31_binary_codec", "q32": "q32_stream", "q33": "q33_chain",
    "q34": "q34_fold", "q35": "q35_id_forms", "q36": "q36_json_codec", "q37": "q37_typed", "q38": "q38_store_by_status", "q39": "q39_store_by_label", "q40": "q40_store_list", "q41": "q41_store_label_values", "q42": "q42_store_status",
    "q43": "q43_fold_python", "q44": "q44_json_lines", "q45": "q45_label_overlay", "q46": "q46_times", "q47": "q47_unnested_commits",
}


def queries() -> dict:
    return {name: globals()[q] for q, name in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    sql = _sql()
    return {name: sql[q] for q, name in NAMES.items() if q in sql}
