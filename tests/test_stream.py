"""Streams end to end, over rows of the events table: appends, points in time, migration, pruning, retention, life, exactly-once, live views."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerframe.errors import (
    AcknowledgedRowsLost, CommitConflict, CursorMovedBack, FellBehind, LogSealed, NotReplayable, OffsetsOutOfOrder, RowsRefused, SchemaRefused, SequenceGap, SnapshotUnavailable, StoreBehindBroker, StreamExists, StreamMismatch, StreamNotFound, StreamRetired, TailTooLarge,
)
from ledgerframe.functions import codec
from ledgerframe.limits import OFFSET, TS
from ledgerframe.operators import dedupe, keyed, outbox
from ledgerframe.queries import V1, V2
from ledgerframe.schema import to_struct
from ledgerframe.sources.files import Files
from ledgerframe.sources.log import Log
from ledgerframe.sources.publish import Publication, Writer
from ledgerframe.sources.stream import Stream
from ledgerframe.streaming import windows
from ledgerframe.streaming.live import Cursor, Live, append_batches, catch_up, register
from ledgerframe.streaming.subscribe import Subscription, in_order

KINDS = "event_id long, user_id long, event_type string, value double"


def events(a, b):
    return [{"event_id": i, "user_id": i % 5, "event_type": ("view", "click")[i % 2], "value": i / 2} for i in range(a, b)]


@pytest.fixture()
def root(tmp_path):
    return f"file://{tmp_path}/streams"


@pytest.fixture()
def two_logs(spark, root):
    s = Stream.open(spark, root, "visits", V1)
    s.send_many(events(0, 6), ts=1000)
    s.migrate(V2)
    s.send_many([{**r, "props": "x"} for r in events(6, 10)], ts=2000)
    return s


def test_append_and_read(spark, root):
    s = Stream.open(spark, root, "t", V1)
    assert s.snapshot().count() == 0 and s.send_many([]) == []
    assert s.send(events(0, 1)[0]) == 1
    assert s.send_many(events(1, 5), ts=77) == [2, 3, 4, 5]
    big = spark.range(1000, numPartitions=7).select((F.col("id") + 5).alias("event_id"), (F.col("id") % 9).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"))
    assert s.append(big) == (6, 1006)
    got = s.scan(columns=[OFFSET, "event_id"]).collect()
    assert [r[0] for r in got] == list(range(1, 1006)) and [r.event_id for r in got[5:]] == list(range(5, 1005))
    assert {r[TS] for r in s.scan(start_offset=2, end_offset=6).collect()} == {77}
    assert s.stats().rows == 1005 and s.stats().end_offset == 1006
    again = Stream.open(spark, root, "t", V1)
    assert again.sql("SELECT count(*) AS n, max(value) AS p FROM log").first() == (1005, 2.0)
    s.compact()
    assert s.scan(columns=["event_id"]).collect() == [(r.event_id,) for r in got] and s.stats().rows == 1005


@pytest.mark.parametrize(
    "rows,first",
    [([*events(0, 1), {**events(1, 2)[0], "event_id": None}], 1), ([{**events(0, 1)[0], "value": float("nan")}], 0), ([*events(0, 2), {**events(2, 3)[0], "value": float("inf")}], 2)],
)
def test_bad_rows_refuse_all(spark, root, rows, first):
    s = Stream.open(spark, root, "t", V1)
    with pytest.raises(RowsRefused) as e:
        s.send_many(rows)
    assert e.value.row == first and s.snapshot().count() == 0 and s.snapshot().end_offset == 1


def test_ingest_casts_only_what_survives(spark, root):
    s = Stream.open(spark, root, "t", {"type": "object", "properties": {"user_id": {"type": "integer", "format": "int32"}, "value": {"type": "number"}}, "required": ["user_id", "value"]})
    good = spark.createDataFrame([(1, 2)], "user_id long, value int")
    assert s.ingest(good) == (1, 2)
    for bad in (spark.createDataFrame([(1, 2.0), (1 << 40, 2.0)], "user_id long, value double").coalesce(1), spark.createDataFrame([(1.0, 1.0), (1.5, 1.0)], "user_id double, value double").coalesce(1)):
        with pytest.raises(RowsRefused) as e:
            s.ingest(bad)
        assert e.value.row == 1
    with pytest.raises(RowsRefused):
        s.ingest(good.withColumn("other", F.lit(1)))
    with pytest.raises(RowsRefused):
        s.ingest(good.withColumn(TS, F.lit(1)))
    with pytest.raises(RowsRefused):
        s.send({"user_id": 1, "value": 1.0, "x": 1})


def test_open_intents(spark, root):
    with pytest.raises(StreamNotFound):
        Stream.open(spark, root, "t", V1, intent="open_existing")
    s = Stream.open(spark, root, "t", V1)
    for error, cells in ((StreamExists, {"schema": V1, "intent": "create"}), (CommitConflict, {"schema": V2}), (StreamMismatch, {"stream_id": "other"})):
        with pytest.raises(error):
            Stream.open(spark, root, "t", **cells)
    with pytest.raises(ValueError):
        Stream.open(spark, root, "a/b", V1)
    other = Stream.open(spark, root, "t")
    other.retain(5)
    with pytest.raises(CommitConflict):
        s.migrate(V2)


def test_union_by_name(two_logs):
    s = two_logs
    got = s.scan().collect()
    assert [r[OFFSET] for r in got] == list(range(1, 11)) and [r.props for r in got] == [None] * 6 + ["x"] * 4
    assert s.scan().columns == ["event_id", "user_id", "event_type", "value", "props", OFFSET, TS]
    assert s.snapshot().floor() == 1 and [o for o, _, _ in s.snapshot().rows(5, 8)] == [5, 6, 7]
    s.migrate(V1)
    assert "props" in s.scan().columns and s.snapshot().end_offset == 11
    assert s.send(events(10, 11)[0]) == 11
    with pytest.raises(SchemaRefused):
        s.migrate({"type": "object", "properties": {"value": {"type": "string"}}, "required": ["value"]})


def test_pruning_opens_no_skipped_log(two_logs):
    view = two_logs.snapshot()
    assert [p.entry.name for p in view.relevant([("value", ">", 50.0)])] == ["visits-v2"]
    assert [p.entry.name for p in view.relevant([("props", "==", "x")])] == ["visits-v2"]
    assert [p.entry.name for p in view.relevant(None, 1, 7)] == ["visits-v1"] and len(view.relevant([("value", "!=", 3.0)])) == 2
    assert two_logs.scan(filters=[("value", ">=", 2.5)]).count() == 5 and two_logs.scan(where="props IS NULL").count() == 6
    df = two_logs.scan(columns=["value"], where="value > 4", ordered=False)
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert plan.count("GreaterThan(value,4.0)") >= 2 and "ReadSchema: struct<value:double,ledger_offset:bigint>" in plan


def test_points_in_time(two_logs):
    s = two_logs
    assert s.sql("SELECT count(*) AS n FROM log", as_of_offset=4).first().n == 3
    assert s.sql("SELECT count(*) AS n FROM log", as_of_ts=1000).first().n == 6
    assert s.sql("SELECT count(*) AS n FROM log", as_of_ts=2000).first().n == 10
    for cells in ({"as_of_offset": 12}, {"as_of_ts": 2001}):
        with pytest.raises(SnapshotUnavailable):
            s.snapshot(**cells)
    with pytest.raises(ValueError):
        s.snapshot(as_of_offset=1, as_of_ts=1)
    pinned = s.snapshot()
    s.send({**events(10, 11)[0], "props": None})
    assert pinned.count() == 10 and s.snapshot().count() == 11


def test_two_readers_views_are_apart(spark, two_logs):
    a, b = two_logs.sql("SELECT count(*) AS n FROM log", end_offset=3), two_logs.sql("SELECT count(*) AS n FROM log")
    assert (a.first().n, b.first().n) == (2, 10) and not spark.catalog.tableExists("log")


def test_tail(spark, two_logs):
    tail = lambda a, b: spark.createDataFrame([(i, 1, "view", 1.0, "tail", i, 3000) for i in range(a, b)], f"{KINDS}, props string, {OFFSET} long, {TS} long")
    assert two_logs.snapshot(tail=tail(9, 14)).count() == 13
    with pytest.raises(SnapshotUnavailable):
        two_logs.snapshot(tail=tail(12, 14))
    with pytest.raises(TailTooLarge):
        two_logs.snapshot(tail=tail(9, 14), max_tail=2)


def test_short_table_is_refused(two_logs):
    log = two_logs._log(two_logs.meta.logs[0])
    log.commit(log.state(), remove=[f["path"] for f in log.state().files], end=7)
    with pytest.raises(SnapshotUnavailable):
        two_logs.snapshot().count()
    # A query that the log can't take part in is answered.
    assert two_logs.scan(filters=[("value", ">", 50.0)]).count() == 0


def test_records_answer_extents(spark, root):
    s = Stream.open(spark, root, "t", V1)
    s.send_many(events(0, 5)), s.restore(100), s.send_many(events(5, 8))
    log = s.live
    assert log.extent() == (1, 109, 8) and log.next_offset(6) == 106 and log.next_offset(109) is None
    assert [log.rows_from(n) for n in (1, 3, 6, 107)] == [8, 6, 3, 2]


def test_conflicting_writers(spark, root):
    s = Stream.open(spark, root, "t", V1)
    base = s.live.state()
    s.send_many(events(0, 2))
    with pytest.raises(CommitConflict):
        s.live.commit(base, add=[], end=9)
    assert s.snapshot().end_offset == 3


def test_a_batch_is_appended_once(spark, root):
    s = Stream.open(spark, root, "t", V1)
    df = spark.createDataFrame(events(0, 4), KINDS)
    assert s.append(df, batch="q:1") == (1, 5) and s.append(df, batch="q:1") == (1, 5) and s.append(df, batch="q:2") == (5, 9)


def test_retention(spark, root):
    s = Stream.open(spark, root, "t", V1)
    s.send_many(events(0, 4), ts=100)
    s.migrate(V2)
    more = lambda a, b, ts: s.send_many([{**r, "props": None} for r in events(a, b)], ts=ts)
    more(4, 6, 200), more(6, 8, 500), more(8, 10, 150)
    assert s.retention_begin(1000) == 1
    s.retain(800)
    # The smallest offset newer than 200 is 7, though later rows have older stamps.
    assert s.retention_begin(1000) == 7
    assert [e.name for e in s.meta.logs] == ["t-v2"] and s.snapshot().count() == 4 and s.snapshot().floor() == 7
    with pytest.raises(NotReplayable) as e:
        s.resume(3)
    assert e.value.reason == "evicted"
    with pytest.raises(SnapshotUnavailable):
        s.snapshot(as_of_offset=3)
    assert not s.retention_finish(2000) and s.retention_finish(2000, grace_us=10)
    assert s.meta.pending is None and s.snapshot().count() == 4 and s.live.state().rows == 4
    assert s.retention_begin(10_000) == 11 and s.snapshot().count() == 0
    s.migrate(V1)
    assert s.meta.live.name == "t-v3" and s.send(events(0, 1)[0]) == 11


def test_retire_and_revive(spark, root):
    s = Stream.open(spark, root, "t", V1)
    s.send_many(events(0, 2))
    s.retire()
    with pytest.raises(StreamRetired):
        s.send_many(events(2, 3))
    assert s.snapshot().count() == 2
    assert s.revive().send_many(events(2, 3)) == [3]


def test_resume_and_replay(two_logs):
    s = two_logs
    assert s.resume(0) == 1 and s.resume(11) == 11
    for requested, cells, reason in ((12, {}, "ahead"), (1, {"max_replay": 5}, "too_old"), (1, {"durable": False}, "not_durable")):
        with pytest.raises(NotReplayable) as e:
            s.resume(requested, **cells)
        assert e.value.reason == reason
    assert [r[OFFSET] for r in s.replay(5, {"event_type": "click"}).collect()] == [6, 8, 10]
    s.restore(1 << 20)
    assert s.resume(1, max_replay=10) == 1  # a fence isn't rows


def test_publish_exactly_once(spark, root):
    s = Stream.open(spark, root, "t", V1)
    df = lambda a, b: spark.createDataFrame(events(a, b), KINDS)
    assert s.publish("p", 1, df(0, 3), order_by=["event_id"]) == (1, 4)
    assert s.publish("p", 1, df(0, 3), order_by=["event_id"]) is None
    assert s.publish("p", 2, df(1, 5), order_by=["event_id"]) == (4, 6)
    with pytest.raises(SequenceGap):
        s.publish("p", 7, df(6, 7))
    s.migrate(V2)
    assert s.publish("p", 5, df(4, 6).withColumn("props", F.lit("p")), order_by=["event_id"]) == (6, 7)
    assert s.live.state().marks["p"] == {"last_seq": 6, "last_offset": 6}
    assert [r.event_id for r in s.scan(columns=["event_id"]).collect()] == [0, 1, 2, 3, 4, 5]
    for bad in ("", "x" * 129):
        with pytest.raises(RowsRefused):
            s.publish(bad, 1, df(0, 1))


def test_judge(spark):
    frames = [("a", 1, 1, 2), ("a", 2, 1, 2), ("a", 3, 2, 3), ("a", 4, 9, 1), ("a", 5, 5, 4), ("a", 6, 9, 1), ("b", 1, 2, 1), ("b", 2, 1, 2)]
    df = spark.createDataFrame(frames, "publisher string, arrival long, seq long, count long").repartition(3)
    got = [(r.publisher, r.arrival, r.skip, r["append"], r.gap, r.last) for r in dedupe.judge(df).orderBy("publisher", "arrival").collect()]
    assert got == [("a", 1, 0, 2, False, 2), ("a", 2, 2, 0, False, 2), ("a", 3, 1, 2, False, 4), ("a", 4, 0, 0, True, 4), ("a", 5, 0, 4, False, 8), ("a", 6, 0, 1, False, 9), ("b", 1, 0, 0, True, 0), ("b", 2, 0, 2, False, 2)]
    marks = spark.createDataFrame([("b", 1)], "publisher string, last_seq long")
    assert [(r.skip, r["append"], r.gap) for r in dedupe.judge(df.where("publisher = 'b'"), marks).orderBy("arrival").collect()] == [(0, 1, False), (2, 0, False)]
    assert dedupe.judge(df.limit(0)).count() == 0
    rng = random.Random(3)
    many, want, standing = [], [], []
    for p in range(30):
        last, base = 0, rng.randint(0, 5)
        for arrival in range(25):
            seq, count = max(1, last + 1 - rng.randint(0, 3) + (5 if p % 3 == 0 and rng.random() < 0.1 else 0)), rng.randint(1, 4)
            if arrival == 0:
                last = base
            many.append((str(p), arrival, seq, count))
            skip, append, gap, last = dedupe.judge_one(last, seq, count)
            want.append((str(p), arrival, seq, count, skip, append, gap, last))
        standing.append((str(p), base))
    frame = spark.createDataFrame(many, df.schema).repartition(3)
    got = dedupe.judge(frame, spark.createDataFrame(standing, "publisher string, last_seq long"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(w[6] for w in want)


def test_judge_stream_agrees(spark, tmp_path):
    frames = [("a", 1, 1, 2), ("a", 2, 2, 3), ("b", 3, 2, 1), ("a", 4, 9, 1), ("b", 5, 1, 1), ("b", 6, 2, 1)]
    df = spark.createDataFrame(frames, "publisher string, arrival long, seq long, count long")
    for i in (0, 3):
        spark.createDataFrame(frames[i : i + 3], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = dedupe.judge_stream(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: sorted((r.publisher, r.arrival, r["append"], r.gap, r.last) for r in d.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(dedupe.judge(df))


def test_live_view(spark, two_logs):
    s = two_logs
    live = Live(s)
    frozen = live.scan(columns=[OFFSET])
    s.send_many([{**r, "props": "l"} for r in events(10, 13)], ts=3000)
    live.offer(s.snapshot().frame(start_offset=8))
    assert live.scan(columns=[OFFSET]).count() == 13 and frozen.count() == 10
    live.rebase()
    assert [r[0] for r in live.scan(columns=[OFFSET]).collect()] == list(range(1, 14)) and live.tail_rows == 0
    assert live.wait_for(offset=13, timeout=1) and live.wait_for(ts=2500, timeout=1) and not live.wait_for(ts=3000, timeout=0.3)
    assert live.sql("SELECT count(*) AS n FROM log").first().n == 13 and live.recent(3000, 0.0005).count() == 3
    assert Live(s, where={"props": ["l"]}).scan().count() == 3
    small = Live(s, max_tail=1)
    small.end_offset = 5
    with pytest.raises(TailTooLarge):
        small.offer(s.snapshot().frame())


def test_source_follows_commits(spark, two_logs):
    register(spark)
    log = two_logs.live
    df = spark.readStream.format("ledger").schema(log.stored).option("path", log.path.removeprefix("file://")).option("startingOffset", 8).load()

    q = df.select(OFFSET, "props").writeStream.format("memory").queryName("followed").trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
        two_logs.send_many([{**r, "props": "n"} for r in events(10, 12)])
        q.processAllAvailable()
        assert sorted(r[0] for r in spark.table("followed").collect()) == [8, 9, 10, 11, 12]
    finally:
        q.stop()


def test_stream_into_stream(spark, root, tmp_path):
    s = Stream.open(spark, root, "t", V1)
    for i in range(3):
        spark.createDataFrame(events(i * 2, i * 2 + 2), KINDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = append_batches(s, source, "copy", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert s.snapshot().count() == 6 and len(s.live.state().batches) == 3


def test_cursor(spark, tmp_path):
    c = Cursor(spark, f"file://{tmp_path}/c", every=100)
    assert c.load() is None and c.save(5) and c.load() == 5
    assert not c.save(6) and c.save(7, force=True) and c.load() == 7
    with pytest.raises(CursorMovedBack):
        c.save(3)
    assert c.save(3, rewind=True) and c.load() == 3


def test_codec(spark):
    spec = {
        "type": "object",
        "properties": {"id": {"type": "string", "contentEncoding": "base16", "format": "bytes2"}, "nested": {"type": ["object", "null"], "additionalProperties": {"type": "object", "properties": {"b": {"type": ["string", "null"], "contentEncoding": "base64"}}}}, "tags": {"type": ["array", "null"], "items": {"type": "string", "contentEncoding": "base16"}}},
        "required": ["id"],
    }
    struct = to_struct(spec)
    raw = spark.createDataFrame([(bytes([0, 255]), {"m": (bytes(range(200)),)}, [b"\x01", b""], 1, 2), (b"ab", None, None, 2, 3)], f"id binary, nested map<string,struct<b:binary>>, tags array<binary>, {OFFSET} long, {TS} long")
    sent = raw.select(codec.frames(struct).alias("f"))
    assert '"id":"00ff"' in sent.first().f and "\\r" not in sent.first().f
    back = sent.select(*codec.parse_frames(F.col("f"), struct)).select(OFFSET, TS, "row.*")
    assert [tuple(r) for r in back.select(*codec.inbound(struct)).collect()] == [tuple(r)[:3] for r in raw.collect()]
    for bad in ("zz", "0"):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "x string").select(codec.to_bytes(F.col("x"), "base16")).collect()
    with pytest.raises(RowsRefused):
        codec.decode_text("zz", "base16")


def test_outbox(spark):
    now = outbox.Standing(10, 4)
    assert outbox.reconcile(now, 7, "s") == outbox.Standing(10, 7, "s")
    for error, args in ((AcknowledgedRowsLost, (3, "s")), (StoreBehindBroker, (10, "s"))):
        with pytest.raises(error):
            outbox.reconcile(now, *args)
    with pytest.raises(StreamMismatch):
        outbox.reconcile(outbox.Standing(10, 4, "other"), 7, "s")
    df = spark.createDataFrame([("s", "p", i, "row", i) for i in range(1, 6)] + [("s", "q", 3, "row", 1)], outbox.OUTBOX)
    assert [r.seq for r in outbox.drop_refused(df, "s", "p", 3).where("publisher_id = 'p'").orderBy("seq").collect()] == [1, 2, 3, 4]
    assert [r.seq for r in outbox.pending(df, "s", "p", 2).collect()] == [1, 2]
    got = outbox.enqueue(spark.range(100, numPartitions=5).select(F.col("id")), "id", 7)
    assert [(r.id, r.seq) for r in got.orderBy("id").collect()] == [(i, i + 7) for i in range(100)]
    h = outbox.Hysteresis(10)
    assert [h.see(n) for n in (9, 10, 6, 5, 4, 9)] == [False, True, True, True, False, False]
    subs = spark.createDataFrame([("s", "u", 2, "id")], outbox.SUBSCRIBERS)
    inbox = spark.createDataFrame([("s", "u", i, 0, "r", 0) for i in range(1, 5)], outbox.INBOX)
    new = outbox.insertable(inbox, subs)
    assert sorted(r.offset for r in new.collect()) == [3, 4] and outbox.positions(subs, new).first().last_received_offset == 4
    assert [r.offset for r in outbox.take(inbox, "s", "u", 2).collect()] == [1, 2]


def test_catch_up(two_logs):
    df, frontier = catch_up(two_logs, 2, {"event_type": "view"}, max_replay=3)
    assert [r[OFFSET] for r in df.collect()] == [3, 5, 7, 9] and frontier == 11
    with pytest.raises(NotReplayable):
        catch_up(two_logs, 12)


def test_running_and_keyed_streams(spark, tmp_path):
    rows = [("a", i, i % 3, i == 5) for i in range(6)] + [("b", 9, 4, False)]
    schema = "key string, offset long, amount long, gone boolean"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = keyed.running_stream(source(), "key", "amount", "total").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.key, r.offset, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((r.key, r.offset, r.total) for r in keyed.running(spark.createDataFrame(rows, schema), "key", "offset", F.col("amount"), "total").collect())
    q = source().writeStream.foreachBatch(keyed.upsert_into(f"{tmp_path}/view", "key", "offset")).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    view = keyed.materialized(spark, f"{tmp_path}/view", spark.createDataFrame(rows, schema).schema, "gone")
    assert [(r.key, r.offset) for r in view.collect()] == [("b", 9)]


# -- two writers, and writers that die


def test_two_writers_of_one_number_append_once(spark, root, monkeypatch):
    """The second one judges on the state that it commits upon, also if the first commits while it writes."""
    s, other = Stream.open(spark, root, "t", V1), Stream.open(spark, root, "t", V1)
    df = spark.createDataFrame(events(0, 2), KINDS)
    add, turns = Log._add, []

    def slow(self, rows):
        out = add(self, rows)
        if not turns:
            turns.append(1)
            assert other.publish("p", 1, df, order_by=["event_id"]) == (1, 3)
        return out

    monkeypatch.setattr(Log, "_add", slow)
    assert s.publish("p", 1, df, order_by=["event_id"]) is None
    assert [r.event_id for r in s.scan(columns=["event_id"]).collect()] == [0, 1]


def test_appends_that_race_both_count(spark, root, monkeypatch):
    s, other = Stream.open(spark, root, "t", V1), Stream.open(spark, root, "t", V1)
    add, turns = Log._add, []

    def slow(self, rows):
        out = add(self, rows)
        if not turns:
            turns.append(1)
            other.send_many(events(10, 13))
        return out

    monkeypatch.setattr(Log, "_add", slow)
    assert s.append(spark.createDataFrame(events(0, 2), KINDS).coalesce(1)) == (4, 6)
    assert [r.event_id for r in s.scan(columns=["event_id"]).collect()] == [10, 11, 12, 0, 1]


def test_a_repeated_frame_is_passed_over_by_place(spark, root):
    s = Stream.open(spark, root, "t", V1)
    frame = lambda ids: spark.createDataFrame([events(i, i + 1)[0] for i in ids], KINDS).coalesce(1)
    assert s.publish("p", 1, frame([9, 8])) == (1, 3) and s.publish("p", 1, frame([9, 8, 1])) == (3, 4)
    assert [r.event_id for r in s.scan(columns=["event_id"]).collect()] == [9, 8, 1]


@pytest.mark.parametrize("end", ["migrate", "retire"])
def test_an_old_handle_appends_nothing(spark, root, end):
    s, old, third = (Stream.open(spark, root, "t", V1) for _ in range(3))
    s.send_many(events(0, 2))
    s.migrate(V2) if end == "migrate" else s.retire()
    refused = LogSealed if end == "migrate" else StreamRetired
    with pytest.raises(refused):
        old.append(spark.createDataFrame(events(2, 3), KINDS))
    with pytest.raises(refused):
        third.send(events(2, 3)[0])
    assert s.snapshot().count() == 2
    if end == "migrate":
        assert old.send({**events(2, 3)[0], "props": None}) == 3  # the refusal has brought it up to date
    else:
        assert s.revive().send(events(2, 3)[0]) == 3 and old.refresh().send(events(3, 4)[0]) == 4


def test_a_migration_that_ended_half_way_is_finished(spark, root, monkeypatch):
    s = Stream.open(spark, root, "t", V1)
    s.send_many(events(0, 2))

    def dies(self, *args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Stream, "_succeed", dies)
        with pytest.raises(KeyboardInterrupt):
            s.migrate(V2)
    again = Stream.open(spark, root, "t")
    with pytest.raises(LogSealed):
        again.send(events(2, 3)[0])
    assert again.meta.live.name == "t-v2" and again.send({**events(2, 3)[0], "props": "p"}) == 3
    assert [r.event_id for r in again.scan(columns=["event_id"]).collect()] == [0, 1, 2]


def test_files_appear_whole_or_not_at_all(spark, root, monkeypatch):
    """What a writer left that died before its file took its name is no record, version or cursor."""
    s = Stream.open(spark, root, "t", V1)
    s.send_many(events(0, 2))
    for folder in (f"{s.live.path}/_commits", f"{root}/t.metadata"):
        Files(spark).replace(f"{folder}/_00.tmp", "half a rec")
    with pytest.raises(CommitConflict):
        Files(spark).write_new(f"{s.live.path}/_commits/00000000.json", "{}")
    assert Stream.open(spark, root, "t").snapshot().count() == 2
    Files(spark).delete(f"{root}/t.metadata/version-hint.text")
    assert Stream.open(spark, root, "t").retain(5).refresh().meta.retention_us == 5


def test_checkpoints_of_the_state(spark, root, monkeypatch):
    monkeypatch.setattr("ledgerframe.sources.log.CHECKPOINT_EVERY", 3)
    s = Stream.open(spark, root, "t", V1)
    log = s.live
    states = [log.state()]
    for i in range(7):
        states.append(log.commit(states[-1], end=10 * (i + 1), marks={f"p{i}": {"last_seq": i}}))
    assert Files(spark).names(f"{log.path}/_checkpoints") == ["00000002.json", "00000005.json"]
    read, opened = Files.read, []
    monkeypatch.setattr(Files, "read", lambda self, path: opened.append(path) or read(self, path))
    assert log.state() == states[-1] and len(opened) == 2
    assert [log.state(v) for v in range(7)] == states[1:]


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    at, schema = f"file://{tmp_path}/view", "key string, offset long, amount long"
    write = keyed.upsert_into(at, "key", "offset", buckets=4)
    first = spark.createDataFrame([("a", 1, 5), ("b", 2, 6), ("c", 3, 7)], schema)
    assert keyed.materialized(spark, at, first.schema).count() == 0
    write(first, 0)
    Files(spark).replace(f"{at}/data/00000001-dead/_b=0/part", "half")
    Files(spark).replace(f"{at}/versions/_00.tmp", "{")
    rows = lambda: sorted(map(tuple, keyed.materialized(spark, at, first.schema).collect()))
    assert rows() == [("a", 1, 5), ("b", 2, 6), ("c", 3, 7)]
    for n in (1, 1, 2, 3):
        write(spark.createDataFrame([("a", 10 + n, n)], schema), n)
    assert rows() == [("a", 13, 3), ("b", 2, 6), ("c", 3, 7)] and Files(spark).names(f"{at}/versions")[:-1] == ["00000002.json", "00000003.json"]


def test_enqueue_of_a_source_that_does_not_repeat_itself(spark):
    got = outbox.enqueue(spark.range(1000, numPartitions=6).select("id", F.rand().alias("r")).where("r < 0.7"), "id", 5).orderBy("id").collect()
    assert [r.seq for r in got] == list(range(5, 5 + len(got)))


# -- following


def test_subscription(spark, two_logs):
    sub = Subscription(two_logs, 1, {"event_type": "click"})
    assert [o for o, _, _ in sub.receive(3)] == [2, 4, 6] and [o for o, _, _ in sub.receive(3)] == [8, 10] and sub.receive(3, timeout=0) == []
    two_logs.send_many([{**r, "props": None} for r in events(10, 20)])
    with pytest.raises(FellBehind):
        late = Subscription(two_logs, 11, max_backlog=4)
        late.caught_up = True
        late.receive(3)
    assert [o for o, _, _ in sub.receive(9)] == [12, 14, 16, 18, 20]
    assert Subscription(two_logs).receive(5, timeout=0) == []  # from the end on
    with pytest.raises(OffsetsOutOfOrder):
        list(in_order([(1, 0, {}), (3, 0, {}), (3, 0, {})]))


def test_pages_follow_bytes_and_rows(two_logs):
    two_logs.restore(1000)
    two_logs.send_many([{**r, "props": "long " * 50} for r in events(10, 40)])
    for cells in ({}, {"page_rows": 1}, {"page_rows": 7}, {"page_bytes": 300}):
        got = list(two_logs.snapshot().rows(3, 1035, **cells))
        assert [o for o, _, _ in got] == [*range(3, 11), *range(1011, 1035)] and got[0][2]["props"] is None and list(got[0][2]) == ["event_id", "user_id", "event_type", "value", "props"]


def test_group_commit_and_publication(spark, root):
    s = Stream.open(spark, root, "t", V1)
    with Writer(s) as w:
        got = [w.submit(r) for r in [*events(0, 20), {**events(0, 1)[0], "value": float("nan")}, *events(20, 30)]]
    offsets = [f.exception() or f.result() for f in got]
    assert isinstance(offsets.pop(20), RowsRefused) and offsets == list(range(1, 31)) and s.live.state().version < 25
    p = Publication(s, "p", max_in_flight=4)
    assert p.submit_many(events(30, 36)) == [1, 2, 3, 4, 5, 6] and p.in_flight == 2 and p.flush() == 6
    again = Publication(s, "p")
    assert again.next_seq == 7
    again.next_seq = 4
    again.submit_many(events(33, 38))
    again.flush()
    assert [r.event_id for r in s.scan(columns=["event_id"], start_offset=31).collect()] == list(range(30, 38))


def test_live_view_keeps_itself_current(spark, two_logs):
    live = Live(two_logs)
    live.keep_current(0.1)
    try:
        two_logs.send_many([{**r, "props": None} for r in events(10, 12)])
        until = time.monotonic() + 60
        while live.end_offset < 13 and time.monotonic() < until:
            time.sleep(0.2)
        assert live.scan().count() == 12
    finally:
        live.close()


def test_windows_on_a_stream(spark, tmp_path):
    """A row counts that comes before the watermark of the batch before has passed its window, and no later one; a join within an interval gives what it gives on tables."""
    minute = 60_000_000
    parts = [[(1, 1 * minute), (1, 11 * minute)], [(1, 5 * minute), (1, 40 * minute)], [(1, 2 * minute), (1, 90 * minute)], [(1, 3 * minute), (1, 95 * minute)]]
    for part in parts:
        spark.createDataFrame(part, "k long, at long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema("k long, at long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run(df, name):
        q = df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    counts = windows.grouped(windows.with_time(source(), "at", late="15 minutes"), "10 minutes").count()
    got = {r.s // minute: r["count"] for r in run(counts.select(F.unix_micros("window.start").alias("s"), "count"), "counts").collect()}
    assert got[0] == 3 and got[10] == 1 and got[40] == 1
    left, right = (windows.with_time(source(), "at", late="200 minutes") for _ in range(2))
    joined = lambda a, b: windows.joined_within(a, b, "k", "10 minutes").select("at", "right_at")
    table = windows.with_time(spark.read.schema("k long, at long").parquet(f"{tmp_path}/in"), "at")
    assert sorted(map(tuple, run(joined(left, right), "joined").collect())) == sorted(map(tuple, joined(table, table).collect()))


def test_what_no_record_names_is_cleaned_after_the_grace(spark, two_logs):
    log = two_logs.live
    two_logs.send_many([{**events(10, 11)[0], "props": None}])
    two_logs.compact()
    Files(spark).replace(f"{log.path}/data/dead/part", "rows of a commit that never was")
    assert log.clean() == [] and log.clean(grace_us=0, now=1) == []
    gone = log.clean(grace_us=0)
    assert len(gone) == 3 and f"{log.path}/data/dead" in gone and two_logs.snapshot().count() == 11
    assert two_logs.snapshot().to_arrow(columns=["event_id"]).column(0).to_pylist() == list(range(11))


def test_stored_tables(spark, tmp_path):
    """Small tables become few files, whatever they were dealt to, and go when they are released; a cluster without a shared folder is refused."""
    from ledgerframe.errors import SourceUnreadable
    from ledgerframe.sources import files

    spark.range(100, numPartitions=90).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    now = files.stored(files.packed(df.repartition(70)), "t")
    assert sorted(r.id for r in now.collect()) == list(range(100)) and len(files.Files(spark).parquet(now.stored_at)) <= 4 * spark.sparkContext.defaultParallelism
    assert files.packed(df, mb=1).rdd.getNumPartitions() <= 16 and files.packed(spark.range(10, numPartitions=3)).rdd.getNumPartitions() == 3
    files.release(now)
    assert not files.Files(spark).exists(now.stored_at)
    files.release(df)

    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(dict)
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(SourceUnreadable):
        files.shared_folder(Cluster)
