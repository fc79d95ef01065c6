"""Queries over streams whose rows are written by append, publish and send, through their whole life, with DuckDB SQL.

``written`` holds ``events`` in three logs. The first quarter of the offsets comes from three appends, the second, after
a migration, from one whose order is reversed; the third from frames of a publisher that overlap and repeat; before
the rest lies a fence of 1,000 offsets.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import LedgerError, RowsRefused
from .functions import codec
from .limits import EARLIEST, OFFSET, TS
from .operators import dedupe, keyed, outbox
from .queries import V1, V2, events, query, read
from .schema import to_struct
from .sources.files import shared_folder
from .sources.publish import Publication, Writer
from .sources.stream import Stream
from .streaming.live import Cursor, Live, register
from .streaming.subscribe import Subscription, out_of_order

FENCE = 1000
_written: dict[tuple[str, str], Stream] = {}

#: DuckDB: the offsets that the rows of ``written`` get.
WRITTEN = f"""WITH c AS (SELECT count(*) AS n, count(*) // 4 AS q, count(*) // 2 AS h, count(*) * 3 // 4 AS t FROM events),
w AS (SELECT event_id, user_id, event_type, value, CASE WHEN event_id >= q THEN props END AS props, n, q, h, t,
 CASE WHEN event_id < q THEN event_id + 1 WHEN event_id < h THEN q + h - event_id WHEN event_id < t THEN event_id + 1 ELSE event_id + 1 + {FENCE} END AS ledger_offset,
 CASE WHEN event_id < q // 3 THEN 1000 WHEN event_id < q // 3 * 2 THEN 2000 WHEN event_id < q THEN 3000 WHEN event_id < h THEN 4000 END AS stamp FROM events, c) """


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")


def written(spark: SparkSession, sf_dir: str) -> Stream:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        rows = plain(spark, sf_dir)
        n = rows.count()
        q, h, t = n // 4, n // 2, n * 3 // 4
        part = lambda a, b: rows.where((F.col("event_id") >= a) & (F.col("event_id") < b))
        s = Stream.open(spark, fresh(spark, "written"), "written", V1)
        for i, (a, b) in enumerate(((0, q // 3), (q // 3, q // 3 * 2), (q // 3 * 2, q))):
            s.append(part(a, b).drop("props"), order_by=["event_id"], ts=1000 * (i + 1))
        s.migrate(V2)
        s.append(part(q, h).withColumn("_o", -F.col("event_id")).orderBy("_o").drop("_o"), ts=4000)
        d = (t - h) // 3
        for a, b in ((h, h + 2 * d), (h + d, t), (h, t)):
            s.publish("p", a - h + 1, part(a, b), order_by=["event_id"])
        s.restore(FENCE)
        s.append(part(t, n), order_by=["event_id"])
        _written[key] = s
    return _written[key]


def one_by_one(df: DataFrame) -> Iterator[dict]:
    """The rows of ``df`` in order, each by itself. They come to the driver in batches of Arrow, a partition at a time."""

    def packed(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    for r in df.mapInArrow(packed, "batch binary").toLocalIterator():
        yield from pa.ipc.open_stream(r.batch).read_all().to_pylist()


class Pages:
    """Rows that the driver has had, kept in files of the shared folder, 100,000 at a time."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.path, self.schema, self._rows = spark, fresh(spark, name), schema, []

    def add(self, rows: list[tuple]) -> None:
        self._rows += rows
        if len(self._rows) >= 100_000:
            self._write()

    def _write(self) -> None:
        names = [c.split()[0] for c in self.schema.split(", ")]
        table = pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*self._rows)] or [pa.array([], pa.int64())] * len(names), names)
        self.spark.createDataFrame(table, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        self._rows = []

    def frame(self) -> DataFrame:
        self._write()
        return self.spark.read.schema(self.schema).parquet(self.path)


def outcome(act) -> str:
    """The name of the refusal that ``act`` meets, or ``ok``."""
    try:
        act()
        return "ok"
    except LedgerError as e:
        return type(e).__name__


# -- appends, publishes, orders


@query(WRITTEN + "SELECT event_id, user_id, value, props, ledger_offset FROM w")
def written_offsets(spark, sf_dir):
    return written(spark, sf_dir).snapshot().frame().select("event_id", "user_id", "value", "props", OFFSET)


@query(WRITTEN + "SELECT stamp AS ledger_ts, count(*) AS n, min(ledger_offset) AS first, max(ledger_offset) AS last FROM w WHERE stamp IS NOT NULL GROUP BY stamp")
def written_stamps(spark, sf_dir):
    """One stamp for each commit; those without one of their own are of the time of writing."""
    return written(spark, sf_dir).sql(f"SELECT ledger_ts, count(*) AS n, min(ledger_offset) AS first, max(ledger_offset) AS last FROM log WHERE ledger_ts <= 4000 GROUP BY ledger_ts")


@query(WRITTEN + "SELECT row_number() OVER (ORDER BY ledger_offset) - 1 AS place, ledger_offset, event_id FROM w")
def rows_in_order(spark, sf_dir):
    """Where each row comes in the iterator over all logs, page by page."""
    got = [(i, o, r["event_id"]) for i, (o, _, r) in enumerate(written(spark, sf_dir).snapshot().rows(page_rows=5000))]
    return spark.createDataFrame(got, f"place long, {OFFSET} long, event_id long")


@query(WRITTEN + "SELECT row_number() OVER (ORDER BY ledger_offset) - 1 AS place, ledger_offset FROM w")
def scan_in_order(spark, sf_dir):
    """Where each row comes in a scan: partitions are in order, and rows within them."""
    scan = written(spark, sf_dir).scan(columns=[OFFSET])
    return spark.createDataFrame(scan.rdd.map(lambda r: r[0]).zipWithIndex().map(lambda x: (x[1], x[0])), f"place long, {OFFSET} long")


@query(WRITTEN + "SELECT 'p' AS publisher, t - h AS last_seq, t AS last_offset, t - h AS n_rows FROM c")
def publish_marks(spark, sf_dir):
    s = written(spark, sf_dir)
    mark, n = s.live.state().marks["p"], spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rows = s.snapshot().frame(start_offset=n // 2 + 1, end_offset=n * 3 // 4 + 1).count()
    return spark.createDataFrame([("p", mark["last_seq"], mark["last_offset"], rows)], "publisher string, last_seq long, last_offset long, n_rows long")


@query(
    WRITTEN
    + """SELECT 'again' AS what, 'ok' AS got, CAST(0 AS BIGINT) AS n FROM c UNION ALL SELECT 'gap', 'SequenceGap', 0 FROM c UNION ALL SELECT 'zero', 'RowsRefused', 0 FROM c UNION ALL SELECT 'no name', 'RowsRefused', 0 FROM c"""
)
def publish_refusals(spark, sf_dir):
    """What a repeat, a gap, a number below 1 and an empty name meet, and how many rows they add: none."""
    s = written(spark, sf_dir)
    before = s.snapshot().count()
    rows = plain(spark, sf_dir).where(F.col("event_id").between(before // 2, before * 3 // 4 - 1))
    acts = {"again": ("p", 1, rows), "gap": ("p", s.last_seq("p") + 2, rows), "zero": ("p", 0, rows), "no name": ("", 1, rows)}
    return spark.createDataFrame([(k, outcome(lambda: s.publish(*a)), s.snapshot().count() - before) for k, a in acts.items()], "what string, got string, n long")


@query("SELECT event_id, event_id + 1 AS ledger_offset, 1 + event_id // 2000 AS page FROM events")
def grouped_sends(spark, sf_dir):
    """Every row by itself through a writer that commits together what waits; read again in batches of 2,000."""
    s = Stream.open(spark, fresh(spark, "sends"), "sends", V1)
    rows = plain(spark, sf_dir).drop("props").orderBy("event_id")
    promised, kept = deque(), 0

    def check(every: bool) -> int:
        """How many promises, in order, are kept; those are let go of."""
        n = kept
        while promised and (every or promised[0].done()):
            n += 1
            assert promised.popleft().result() == n
        return n

    with Writer(s) as w:
        for r in one_by_one(rows):
            promised.append(w.submit(r))
            kept = check(False)
    kept = check(True)
    sub, out, page = Subscription(s, EARLIEST, max_backlog=kept), Pages(spark, "sends-read", f"event_id long, {OFFSET} long, page long"), 1
    while got := sub.receive(2000, timeout=0):
        out.add([(r["event_id"], o, page) for o, _, r in got])
        page += 1
    return out.frame()


@query("SELECT event_id, event_id + 1 AS ledger_offset FROM events")
def pipelined_publication(spark, sf_dir):
    """Every row by itself by a publisher with a window of rows in flight, begun anew half-way by one that sends a quarter of them again."""
    s = Stream.open(spark, fresh(spark, "publication"), "publication", V1)
    rows = plain(spark, sf_dir).drop("props")
    n = rows.count()
    first, again = Publication(s, "p", max_in_flight=4096), Publication(s, "p", max_in_flight=4096)
    again.next_seq = n // 4 + 1
    for p, own in ((first, rows.where(F.col("event_id") < n // 2)), (again, rows.where(F.col("event_id") >= n // 4))):
        for r in one_by_one(own.orderBy("event_id")):
            p.submit(r)
        p.flush()
    return s.snapshot().frame().select("event_id", OFFSET)


@query("SELECT 'required' AS what, 'RowsRefused' AS got, CAST(1 AS BIGINT) AS row UNION ALL SELECT 'infinite', 'RowsRefused', 0 UNION ALL SELECT 'wide', 'RowsRefused', 1 UNION ALL SELECT 'undeclared', 'RowsRefused', NULL UNION ALL SELECT 'own column', 'RowsRefused', NULL UNION ALL SELECT 'fits', 'ok', NULL")
def append_refusals(spark, sf_dir):
    """What rows that the schema doesn't admit meet, and which row is named; none of their frame is appended."""
    spec = {"type": "object", "properties": {"user_id": {"type": "integer", "format": "int32"}, "value": {"type": "number"}}, "required": ["user_id", "value"]}
    s = Stream.open(spark, fresh(spark, "refusals"), "refusals", spec)
    cases = {
        "required": ([(1, 1.0), (None, 2.0)], "user_id int, value double"), "infinite": ([(1, float("inf")), (2, 1.0)], "user_id int, value double"), "wide": ([(1, 1.0), (1 << 40, 1.0)], "user_id long, value double"),
        "undeclared": ([(1, 1.0, 2)], "user_id int, value double, more int"), "own column": ([(1, 1.0, 2)], f"user_id int, value double, {TS} long"), "fits": ([(7, 3)], "user_id long, value int"),
    }
    out = []
    for name, (rows, kinds) in cases.items():
        try:
            s.append(spark.createDataFrame(rows, kinds).coalesce(1))
            out.append((name, "ok", None))
        except RowsRefused as e:
            out.append((name, "RowsRefused", e.row))
    assert s.snapshot().count() == 1
    return spark.createDataFrame(out, "what string, got string, row long")


# -- life


@query(
    "SELECT 'append after migrate' AS what, 'LogSealed' AS got UNION ALL SELECT 'append once refreshed', 'ok' UNION ALL SELECT 'migrate from an old version', 'CommitConflict' UNION ALL SELECT 'append after retire', 'StreamRetired'"
    " UNION ALL SELECT 'append after revive', 'ok' UNION ALL SELECT 'create again', 'StreamExists' UNION ALL SELECT 'open what isn''t there', 'StreamNotFound' UNION ALL SELECT 'another schema', 'CommitConflict' UNION ALL SELECT 'another id', 'StreamMismatch' UNION ALL SELECT 'a type that changes', 'SchemaRefused'"
)
def stale_handles(spark, sf_dir):
    """What handles that were opened before a migration or the stream's end meet, and what each way to open does."""
    root = fresh(spark, "life")
    s, old = Stream.open(spark, root, "life", V1), Stream.open(spark, root, "life", V1)
    rows = plain(spark, sf_dir)
    s.migrate(V2)
    out = [("append after migrate", outcome(lambda: old.append(rows.drop("props")))), ("append once refreshed", outcome(lambda: old.append(rows)))]
    stale = Stream.open(spark, root, "life")
    s.retain(5_000_000)
    out.append(("migrate from an old version", outcome(lambda: stale.migrate(V1))))
    s.retire()
    out.append(("append after retire", outcome(lambda: old.append(rows))))
    s.revive()
    out.append(("append after revive", outcome(lambda: old.refresh().append(rows))))
    opened = lambda **cells: outcome(lambda: Stream.open(spark, root, cells.pop("name", "life"), **cells))
    out += [("create again", opened(schema=V2, intent="create")), ("open what isn't there", opened(name="other", intent="open_existing")), ("another schema", opened(schema=V1)), ("another id", opened(stream_id="x"))]
    out.append(("a type that changes", outcome(lambda: s.migrate({"type": "object", "properties": {"value": {"type": "string"}}, "required": ["value"]}))))
    return spark.createDataFrame(out, "what string, got string")


@query(WRITTEN + "SELECT 'written-v1' AS log, CAST(1 AS BIGINT) AS first, q AS last, q AS n_rows, true AS sealed FROM c UNION ALL SELECT 'written-v2', q + 1, n + 1000, n - q, false FROM c")
def log_coverage(spark, sf_dir):
    """Extents from records, summed over the entries of files."""
    s = written(spark, sf_dir)
    for e in s.meta.logs:
        state = s._log(e).state()
        assert sum(f["rows"] for f in state.files) == state.rows and all(f["path"].endswith(".parquet") for f in state.files)
    return spark.createDataFrame([(c["log"], c["first"], c["last"], c["rows"], c["sealed"]) for c in s.coverage()], "log string, first long, last long, n_rows long, sealed boolean")


@query(WRITTEN + "SELECT event_type, count(*) AS n, max(ledger_offset) AS last FROM w WHERE event_id < q GROUP BY event_type")
def one_log_sql(spark, sf_dir):
    return written(spark, sf_dir).log_sql("written-v1", "SELECT event_type, count(*) AS n, max(ledger_offset) AS last FROM log GROUP BY event_type")


@query(WRITTEN + "SELECT ledger_offset, user_id FROM w WHERE ledger_offset >= q // 2 AND event_type IN ('view', 'click')")
def replay_where(spark, sf_dir):
    s, n = written(spark, sf_dir), plain(spark, sf_dir).count()
    return s.replay(n // 4 // 2, {"event_type": ["view", "click"]}, max_replay=None).select(OFFSET, "user_id")


@query(WRITTEN + "SELECT 'earliest' AS what, '1' AS got UNION ALL SELECT 'end', CAST(n + 1001 AS VARCHAR) FROM c UNION ALL SELECT 'beyond', 'ahead' UNION ALL SELECT 'far', 'too_old' UNION ALL SELECT 'behind a fence', CAST(t + 1 AS VARCHAR) FROM c UNION ALL SELECT 'not kept', 'not_durable'")
def resume_answers(spark, sf_dir):
    from .errors import NotReplayable

    s, n = written(spark, sf_dir), plain(spark, sf_dir).count()
    end = n + 1 + FENCE
    asks = {"earliest": (EARLIEST, None, True), "end": (end, 10, True), "beyond": (end + 1, 10, True), "far": (1, n - 1, True), "behind a fence": (n * 3 // 4 + 1, n - n * 3 // 4, True), "not kept": (1, None, False)}
    out = []
    for name, (offset, most, durable) in asks.items():
        try:
            out.append((name, str(s.resume(offset, most, durable))))
        except NotReplayable as e:
            out.append((name, e.reason))
    return spark.createDataFrame(out, "what string, got string")


@query(
    "WITH n AS (SELECT count(*) AS n FROM events) SELECT 'truncated' AS what, n - n // 3 AS n_rows, n // 3 + 1 AS first, n AS last FROM n UNION ALL SELECT 'compacted', n - n // 3, n // 3 + 1, n FROM n"
    " UNION ALL SELECT 'restored', n - n // 3, n // 3 + 1, n + (1::BIGINT << 40) FROM n UNION ALL SELECT 'restored again', n - n // 3, n // 3 + 1, n + (1::BIGINT << 40) FROM n"
)
def upkeep(spark, sf_dir):
    """Rows below a floor dropped, also of a file that straddles it; files made one run; a lost writer's stream opened beyond all it may have given out."""
    root = fresh(spark, "upkeep")
    s = Stream.open(spark, root, "upkeep", V2)
    rows = plain(spark, sf_dir)
    n = rows.count()
    for i in range(3):
        s.append(rows.where(F.col("event_id") % 3 == i), order_by=["event_id"])
    out = []

    def note(name):
        state = s.live.state()
        r = s.snapshot().frame().agg(F.count("*").alias("n"), F.min(OFFSET).alias("a")).first()
        out.append((name, r.n, r.a, state.end - 1))

    s.live.truncate(n // 3 + 1)
    note("truncated")
    s.compact()
    note("compacted")
    for name in ("restored", "restored again"):
        s = Stream.open(spark, root, "upkeep", intent="restore_published")
        note(name)
    return spark.createDataFrame(out, "what string, n_rows long, first long, last long")


# -- following


@query(WRITTEN + "SELECT ledger_offset, event_id FROM w WHERE event_id >= q")
def followed_source(spark, sf_dir):
    """The streaming source over the live log's commits, into files."""
    register(spark)
    log = written(spark, sf_dir).live
    out = fresh(spark, "followed")
    df = spark.readStream.format("ledger").schema(log.stored).option("path", log.path).load().select(OFFSET, "event_id")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema(f"{OFFSET} long, event_id long").parquet(out)


@query("WITH c AS (SELECT count(*) AS n, count(*) // 3 AS q FROM events) SELECT 'first' AS what, q AS n, q AS cursor FROM c UNION ALL SELECT 'again', q, q FROM c UNION ALL SELECT 'rest', n - q - q, n FROM c UNION ALL SELECT 'back', n - 2, n FROM c")
def cursor_moves(spark, sf_dir):
    """A reader's batches and its cursor: a batch that isn't followed by another request is delivered again."""
    s = Stream.open(spark, fresh(spark, "cursor"), "cursor", V2)
    rows = plain(spark, sf_dir)
    n = rows.count()
    s.append(rows, order_by=["event_id"])
    at, out = fresh(spark, "cursor-file"), []

    def note(name, sub, got):
        out.append((name, sum(len(page) for page in got), sub.cursor.load()))

    reader = lambda **cells: Subscription(s, cursor=Cursor(spark, at, every=0), max_backlog=n, **cells)
    one = reader(offset=1)
    for _ in one.receive_pages(n // 3):
        pass
    note("first", one, one.receive_pages(n // 3))
    two = reader()
    note("again", two, two.receive_pages(n // 3))
    rest = [sum(len(page) for page in two.receive_pages(n))]
    two.close()
    note("rest", two, [range(x) for x in rest])
    two.commit(2)
    three = reader()
    rest = [sum(len(page) for page in three.receive_pages(n))]
    three.close()
    note("back", three, [range(x) for x in rest])
    return spark.createDataFrame(out, "what string, n long, cursor long")


@query("SELECT reader, arrival, received, before FROM (SELECT user_id AS reader, event_id AS arrival, event_id * 7919 % 1009 AS received, max(event_id * 7919 % 1009) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE received <= before")
def received_out_of_order(spark, sf_dir):
    e = plain(spark, sf_dir).select(F.col("user_id").alias("reader"), F.col("event_id").alias("arrival"), (F.col("event_id") * 7919 % 1009).alias("received"))
    return out_of_order(e, "reader", "arrival", "received")


@query("WITH m AS (SELECT max(epoch_us(ts)) AS m FROM events) SELECT event_id, user_id FROM events, m WHERE epoch_us(ts) >= m - 86400000000")
def live_recent(spark, sf_dir):
    """Rows of the last day, as of the newest, in a live view."""
    from .queries import stream

    live = Live(stream(spark, sf_dir))
    newest = live.sql("SELECT max(ledger_ts) AS m FROM log").first().m
    return live.recent(newest, 86400).select("event_id", "user_id")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'signup'")
def upserted_view(spark, sf_dir):
    """The latest row of each key, kept by three batches, of which one comes twice."""
    at = fresh(spark, "view")
    rows = plain(spark, sf_dir).select("user_id", "event_id", "value", (F.col("event_type") == "signup").alias("gone"))
    write = keyed.upsert_into(at, "user_id", "event_id", buckets=16)
    for n, m in enumerate((0, 1, 1, 2)):
        write(rows.where(F.col("event_id") % 3 == m), n - (n > 1))
    return keyed.materialized(spark, at, rows.schema, "gone").select("user_id", "event_id", "value")


# -- outbox, inbox, duplicates


@query("SELECT row_number() OVER (ORDER BY event_id) AS seq, epoch_us(ts) AS enqueued_at FROM events WHERE event_type = 'view' ORDER BY seq LIMIT 100")
def outbox_pending(spark, sf_dir):
    """The next rows of one stream's publisher, of an outbox of all."""
    rows = keyed.running(events(spark, sf_dir), "event_type", OFFSET, F.lit(1), "seq").select(F.col("event_type").alias("stream"), F.lit("p").alias("publisher_id"), "seq", F.col("props").alias("row"), F.col(TS).alias("enqueued_at"))
    return outbox.pending(rows, "view", "p", 100).select("seq", "enqueued_at")


@query("SELECT CASE WHEN r <= 25 AND user_id = 2 THEN 'taken' ELSE 'left' END AS side, count(*) AS n, min(event_id + 1) AS first, max(event_id + 1) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY side")
def inbox_taken(spark, sf_dir):
    """The lowest offsets of one subscriber, and the inbox without them."""
    rows = events(spark, sf_dir).select(F.lit("s").alias("stream"), F.col("user_id").cast("string").alias("subscriber_id"), F.col(OFFSET).alias("offset"))
    got, left = outbox.taken(rows, "s", "2", 25)
    side = lambda df, name: df.agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"))
    return side(got, "taken").unionByName(side(left, "left"))


@query(
    "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS publisher, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events), m AS (SELECT publisher, max(seq) AS m FROM e GROUP BY publisher)"
    " SELECT publisher, seq, CASE WHEN seq > m - 4 AND seq < m THEN seq * 10 WHEN seq = m THEN -seq END AS \"offset\" FROM e JOIN m USING (publisher)"
)
def duplicate_offsets(spark, sf_dir):
    """Of each row sent again the offset it got: from the publisher's three newest ranges, at its mark from the mark, else unknown."""
    e = keyed.running(plain(spark, sf_dir).select(F.col("user_id").cast("string").alias("publisher"), "event_id"), "publisher", "event_id", F.lit(1), "seq").drop("event_id")
    marks = e.groupBy("publisher").agg(F.max("seq").alias("last_seq")).withColumn("last_offset", -F.col("last_seq"))
    ranges = e.join(marks, "publisher").where("seq < last_seq").select("publisher", F.col("seq").alias("first_seq"), F.lit(1).cast("long").alias("count"), (F.col("seq") * 10).alias("first_offset"))
    return dedupe.original_offsets(e, ranges, 3, marks)


# -- nested columns, frames


NESTED = {
    "type": "object",
    "properties": {
        "event_id": {"type": "integer"}, "kind": {"type": "string", "contentEncoding": "base16"}, "tags": {"type": "array", "items": {"type": "integer"}},
        "attrs": {"type": "object", "additionalProperties": {"type": "object", "properties": {"string_value": {"type": ["string", "null"]}, "raw": {"type": ["string", "null"], "contentEncoding": "base64"}}}},
    },
    "required": ["event_id", "kind", "tags", "attrs"],
}


def nested(spark: SparkSession, sf_dir: str) -> Stream:
    key = (spark.sparkContext.applicationId, sf_dir + "#nested")
    if key not in _written:
        s = Stream.open(spark, fresh(spark, "nested"), "nested", NESTED)
        value = F.struct(F.col("event_type").alias("string_value"), F.col("props").cast("binary").alias("raw"))
        tags = F.sequence(F.col("event_id") % 5, F.col("event_id") % 5 + F.col("user_id") % 3)
        rows = plain(spark, sf_dir).select("event_id", F.col("event_type").cast("binary").alias("kind"), tags.alias("tags"), F.create_map(F.lit("outcome"), value).alias("attrs"))
        s.append(rows, order_by=["event_id"])
        _written[key] = s
    return _written[key]


@query("SELECT event_id, p AS pos, event_id % 5 + p AS tag FROM events, range(3) r(p) WHERE p <= user_id % 3")
def stored_arrays(spark, sf_dir):
    return nested(spark, sf_dir).sql("SELECT event_id, CAST(pos AS BIGINT) AS pos, tag FROM log LATERAL VIEW posexplode(tags) x AS pos, tag")


@query("SELECT event_type AS outcome, count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY event_type")
def stored_maps(spark, sf_dir):
    return nested(spark, sf_dir).sql("SELECT attrs['outcome'].string_value AS outcome, count(*) AS n, CAST(sum(octet_length(attrs['outcome'].raw)) AS BIGINT) AS bytes FROM log GROUP BY 1")


@query("SELECT event_id + 1 AS ledger_offset, event_id, lower(hex(encode(event_type))) AS kind, base64(encode(props)) AS raw FROM events")
def nested_codec(spark, sf_dir):
    """Binary cells inside maps of structs as text and back."""
    s = nested(spark, sf_dir)
    text = s.snapshot().frame().select(OFFSET, *codec.outbound(s.schema))
    back = text.select(OFFSET, *codec.inbound(s.schema))
    assert back.where("octet_length(attrs['outcome'].raw) IS NULL").isEmpty()
    return text.select(OFFSET, "event_id", "kind", F.col("attrs")["outcome"]["raw"].alias("raw"))


@query("SELECT event_id, '[' || (event_id + 1) || ',' || epoch_us(ts) || ',{\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\",\"note\":null}]' AS frame FROM events")
def wire_text(spark, sf_dir):
    """The text of each frame: offset, stamp, then the row's cells in the order of the schema, absent ones as null."""
    struct = to_struct({"type": "object", "properties": {"user_id": {"type": "integer"}, "event_type": {"type": "string"}, "note": {"type": ["string", "null"]}}, "required": ["user_id", "event_type"]})
    e = events(spark, sf_dir).withColumn("note", F.lit(None).cast("string"))
    return e.select("event_id", codec.frames(struct).alias("frame"))
