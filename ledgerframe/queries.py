"""The queries over the engine's operators, and the DuckDB SQL that gives the same rows.

``events`` is the stream: its offset is event_id + 1 and its stamp the event's time in microseconds. It is
stored once for each application and input as a stream of three logs: the first 40 % of the offsets
without ``props``, then up to 70 %, then the rest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import RowsRefused
from .functions import codec, terms
from .limits import DEDUPE_WINDOW, OFFSET, TS
from .operators import dedupe, keyed, outbox, retention
from .plans import manifest
from .schema import to_struct
from .sources.files import shared_folder
from .sources.stream import Stream
from .streaming.live import Live, catch_up

_int, _num, _str = {"type": "integer"}, {"type": "number"}, {"type": "string"}
V1 = {"type": "object", "properties": {"event_id": _int, "user_id": _int, "event_type": _str, "value": _num}, "required": ["event_id", "user_id", "event_type", "value"]}
V2 = {"type": "object", "properties": {**V1["properties"], "props": {"type": ["string", "null"]}}, "required": [*V1["required"], "props"]}
V3 = {"type": "object", "properties": {**V2["properties"], "note": {"type": ["string", "null"]}}, "required": [*V2["required"], "note"]}
_streams: dict[tuple[str, str], Stream] = {}

#: DuckDB: the stream as a table ``log``, with the columns that each of its logs lacks as null.
LOG = """WITH n AS (SELECT count(*) AS n FROM events), log AS (SELECT event_id, user_id, event_type, value,
 CASE WHEN event_id + 1 > n * 4 // 10 THEN props END AS props, CAST(NULL AS VARCHAR) AS note, event_id + 1 AS ledger_offset, epoch_us(ts) AS ledger_ts, n FROM events, n) """


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", (F.col("event_id") + 1).alias(OFFSET), F.unix_micros(F.col("ts").cast("timestamp")).alias(TS))


def stream(spark: SparkSession, sf_dir: str) -> Stream:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _streams:
        rows = events(spark, sf_dir)
        # The logs are cut by offset, so ids other than 0 to n - 1 would be left out of all of them.
        n, least, most, distinct = rows.agg(F.count("*"), F.min("event_id"), F.max("event_id"), F.countDistinct("event_id")).first()
        if n and (least, most, distinct) != (0, n - 1, n):
            raise RowsRefused(f"event ids aren't 0 to {n - 1}: {distinct} distinct ones from {least} to {most}")
        bounds = [0, n * 4 // 10, n * 7 // 10, n]
        s = Stream.open(spark, f"{shared_folder(spark)}/streams-{uuid.uuid4().hex}", "events", V1)
        for i, schema in enumerate((V1, V2, V3)):
            s.migrate(schema)
            own = rows.withColumn("note", F.lit(None).cast("string")).where((F.col(OFFSET) > bounds[i]) & (F.col(OFFSET) <= bounds[i + 1]))
            s.live.append_stamped(own.select(*s.live.stored.names))
        _streams[key] = s.refresh()
    return _streams[key]


def total(spark: SparkSession, sf_dir: str) -> int:
    return stream(spark, sf_dir).snapshot().end_offset - 1


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- scans, projections, predicates


@query(LOG + "SELECT event_id, user_id, event_type, value, props, note, ledger_offset, ledger_ts FROM log WHERE ledger_offset >= n // 4 AND ledger_offset < n // 2")
def scan_offset_range(spark, sf_dir):
    n = total(spark, sf_dir)
    return stream(spark, sf_dir).scan(start_offset=n // 4, end_offset=n // 2)


@query(LOG + "SELECT user_id, value FROM log")
def scan_project(spark, sf_dir):
    return stream(spark, sf_dir).scan(columns=["user_id", "value"])


@query(LOG + "SELECT ledger_offset, user_id, value FROM log WHERE value > 50 AND event_type <> 'error'")
def scan_where_expr(spark, sf_dir):
    return stream(spark, sf_dir).scan(columns=[OFFSET, "user_id", "value"], where="value > 50 AND event_type <> 'error'")


@query(LOG + "SELECT ledger_offset, value FROM log WHERE value >= 20 AND value < 60 AND user_id <> 3")
def filters_compare(spark, sf_dir):
    return stream(spark, sf_dir).scan(columns=[OFFSET, "value"], filters=[("value", ">=", 20.0), ("value", "<", 60.0), ("user_id", "!=", 3)])


@query(LOG + "SELECT ledger_offset, event_type FROM log WHERE event_type IN ('click', 'view')")
def filters_in(spark, sf_dir):
    return stream(spark, sf_dir).scan(columns=[OFFSET, "event_type"], filters=[("event_type", "in", ["click", "view", None])])


@query(LOG + "SELECT ledger_offset, event_type FROM log WHERE false")
def filters_in_empty(spark, sf_dir):
    return stream(spark, sf_dir).scan(columns=[OFFSET, "event_type"], filters=[("event_type", "in", [])])


@query(LOG + "SELECT ledger_offset, props FROM log WHERE props = NULL")
def filters_eq_null(spark, sf_dir):
    return stream(spark, sf_dir).scan(columns=[OFFSET, "props"], filters=[("props", "==", None)])


def _followed(spark, sf_dir, where):
    view = stream(spark, sf_dir).snapshot()
    return view.frame().where(terms.subscription(where, view.schema)).select(OFFSET, "user_id", "event_type")


@query(LOG + "SELECT ledger_offset, user_id, event_type FROM log WHERE user_id IS NOT DISTINCT FROM 7")
def sub_where_eq(spark, sf_dir):
    return _followed(spark, sf_dir, {"user_id": 7})


@query(LOG + "SELECT ledger_offset, user_id, event_type FROM log WHERE event_type IN ('error', 'signup')")
def sub_where_in(spark, sf_dir):
    return _followed(spark, sf_dir, {"event_type": ["error", "signup"]})


@query(LOG + "SELECT ledger_offset, user_id, event_type FROM log WHERE event_type = 'click' AND user_id IN (1, 2, 3)")
def sub_where_and(spark, sf_dir):
    return _followed(spark, sf_dir, {"event_type": "click", "user_id": [1, 2, 3.0]})


@query(LOG + "SELECT ledger_offset, user_id, event_type FROM log WHERE props IS NULL OR props = '{\"k\": 3}'")
def sub_where_null(spark, sf_dir):
    return _followed(spark, sf_dir, {"props": [None, '{"k": 3}']})


@query(LOG + "SELECT ledger_offset, user_id, event_type FROM log WHERE false")
def sub_where_type_mismatch(spark, sf_dir):
    return _followed(spark, sf_dir, {"user_id": "7"})


# -- union by name, points in time, tails


@query(LOG + "SELECT event_id, user_id, event_type, value, props, note, ledger_offset, ledger_ts FROM log")
def union_by_name_migration(spark, sf_dir):
    return stream(spark, sf_dir).snapshot().frame()


@query(LOG + "SELECT ledger_offset, props FROM log WHERE props = '{\"k\": 1}'")
def filter_on_added_column(spark, sf_dir):
    return stream(spark, sf_dir).scan(columns=[OFFSET, "props"], filters=[("props", "==", '{"k": 1}')])


@query(LOG + "SELECT event_type, count(*) AS n, max(ledger_offset) AS last FROM log WHERE ledger_offset < n // 2 GROUP BY event_type")
def snapshot_as_of_offset(spark, sf_dir):
    s = stream(spark, sf_dir)
    return s.sql("SELECT event_type, count(*) AS n, max(ledger_offset) AS last FROM log GROUP BY event_type", as_of_offset=total(spark, sf_dir) // 2)


@query(LOG + "SELECT event_type, count(*) AS n, max(ledger_ts) AS last_ts FROM log WHERE ledger_ts <= epoch_us(TIMESTAMP '2024-01-10 00:00:00') GROUP BY event_type")
def snapshot_as_of_ts(spark, sf_dir):
    return stream(spark, sf_dir).sql("SELECT event_type, count(*) AS n, max(ledger_ts) AS last_ts FROM log GROUP BY event_type", as_of_ts=1704844800000000)


def _tail(spark, sf_dir, start, count):
    e = events(spark, sf_dir).withColumn("note", F.lit("tail"))
    return e.where("event_id < %d" % count).withColumn(OFFSET, F.col("event_id") + F.lit(start)).select("event_id", "user_id", "event_type", "value", "props", "note", OFFSET, TS)


@query(LOG + "SELECT note, count(*) AS n, min(ledger_offset) AS first, max(ledger_offset) AS last FROM (SELECT note, ledger_offset FROM log UNION ALL SELECT 'tail', n + 1 + event_id FROM log WHERE event_id < 50) GROUP BY note")
def snapshot_with_tail(spark, sf_dir):
    n = total(spark, sf_dir)
    return stream(spark, sf_dir).sql("SELECT note, count(*) AS n, min(ledger_offset) AS first, max(ledger_offset) AS last FROM log GROUP BY note", tail=_tail(spark, sf_dir, n + 1, 50))


@query(LOG + "SELECT ledger_offset, user_id FROM log")
def live_rebase_once(spark, sf_dir):
    """A base of the first half and a tail that overlaps it: after a rebase each row counts once."""
    s = stream(spark, sf_dir)
    live, n = Live(s, max_tail=1 << 62), total(spark, sf_dir)
    live.base, live.end_offset = s.snapshot(as_of_offset=n // 2), n // 2
    live.offer(s.snapshot().frame(start_offset=n // 4))
    live.rebase()
    return live.scan(columns=[OFFSET, "user_id"])


# -- statistics and pruning


@query(
    LOG
    + """, p AS (SELECT CASE WHEN ledger_offset <= n * 4 // 10 THEN 'events-v1' WHEN ledger_offset <= n * 7 // 10 THEN 'events-v2' ELSE 'events-v3' END AS log, * FROM log)
SELECT log, count(*) AS n_rows, min(ledger_offset) AS first, max(ledger_offset) AS last, min(value) AS min_value, max(value) AS max_value, CAST(count(*) - count(value) AS BIGINT) AS nulls FROM p GROUP BY log"""
)
def manifest_stats(spark, sf_dir):
    s = stream(spark, sf_dir)
    rows = []
    for e in s.meta.logs:
        x = s._log(e).state().statistics()
        v = x["columns"]["value"]
        rows.append((e.name, x["rows"], x["first"], x["last"], v["min"], v["max"], v["null_count"]))
    return spark.createDataFrame(rows, "log string, n_rows long, first long, last long, min_value double, max_value double, nulls long")


@query(
    LOG
    + """SELECT 'events-v1' AS log, min(event_id) > 100 OR max(event_id) < 100 AS skipped FROM log WHERE ledger_offset <= n * 4 // 10
UNION ALL SELECT 'events-v2', min(event_id) > 100 OR max(event_id) < 100 FROM log WHERE ledger_offset > n * 4 // 10 AND ledger_offset <= n * 7 // 10"""
)
def manifest_pruned_logs(spark, sf_dir):
    """Sealed logs have manifest rows; the term event_id == 100 keeps only those whose range holds it."""
    s = stream(spark, sf_dir)
    rows = {m["log"]: m for m in s.meta.manifest}
    return spark.createDataFrame([(e.name, manifest.can_skip(rows[e.name], e.struct, [("event_id", "==", 100)])) for e in s.meta.logs[:-1]], "log string, skipped boolean")


@query(LOG + "SELECT min(ledger_offset) AS first, max(ledger_offset) + 1 AS past, count(*) AS n_rows FROM log")
def table_extent(spark, sf_dir):
    s = stream(spark, sf_dir)
    got = [s._log(e).extent() for e in s.meta.logs]
    return spark.createDataFrame([(min(g[0] for g in got), max(g[1] for g in got), sum(g[2] for g in got))], "first long, past long, n_rows long")


@query(LOG + "SELECT count(*) AS n_rows FROM log WHERE ledger_offset >= n // 3")
def rows_from(spark, sf_dir):
    s, n = stream(spark, sf_dir), total(spark, sf_dir)
    return spark.createDataFrame([(sum(s._log(e).rows_from(n // 3) for e in s.meta.logs),)], "n_rows long")


@query(LOG + "SELECT min(ledger_offset) AS next FROM log WHERE ledger_offset >= n * 4 // 10 + 1")
def next_offset_after_fence(spark, sf_dir):
    s, n = stream(spark, sf_dir), total(spark, sf_dir)
    return spark.createDataFrame([(min(x for e in s.meta.logs if (x := s._log(e).next_offset(n * 4 // 10 + 1)) is not None),)], "next long")


@query(LOG + "SELECT min(ledger_offset) AS floor FROM log")
def floor(spark, sf_dir):
    return spark.createDataFrame([(stream(spark, sf_dir).snapshot().floor(),)], "floor long")


CUTOFF = 1705276800000000  # 2024-01-15


@query(LOG + f"SELECT min(ledger_offset) AS floor FROM log WHERE ledger_ts > {CUTOFF}")
def retention_floor(spark, sf_dir):
    s = stream(spark, sf_dir)
    return spark.createDataFrame([(retention.floor(s.meta, s._log, CUTOFF),)], "floor long")


@query(LOG + f"SELECT ledger_offset, ledger_ts FROM log WHERE ledger_offset >= (SELECT min(ledger_offset) FROM log WHERE ledger_ts > {CUTOFF})")
def retained_rows(spark, sf_dir):
    s = stream(spark, sf_dir)
    meta = retention.begin(s.meta, retention.floor(s.meta, s._log, CUTOFF), 0)
    return Stream(spark, s.root, meta).snapshot().frame().select(OFFSET, TS)


# -- keyed views and running state


@query(LOG + "SELECT user_id, event_type, value, ledger_offset FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ledger_offset DESC) AS r FROM log) WHERE r = 1 AND event_type <> 'error'")
def keyed_latest(spark, sf_dir):
    df = stream(spark, sf_dir).snapshot().frame().select("user_id", "event_type", "value", OFFSET, (F.col("event_type") == "error").alias("gone"))
    return keyed.latest(df, "user_id", OFFSET, "gone").select("user_id", "event_type", "value", OFFSET)


@query(LOG + "SELECT user_id, value, ledger_offset FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ledger_offset DESC) AS r FROM log WHERE event_type = 'purchase') WHERE r = 1")
def keyed_latest_branch(spark, sf_dir):
    view = stream(spark, sf_dir).snapshot()
    df = view.frame().where(terms.subscription({"event_type": "purchase"}, view.schema)).select("user_id", "value", OFFSET)
    return keyed.latest(df, "user_id", OFFSET)


def _positions(spark, sf_dir):
    df = stream(spark, sf_dir).snapshot().frame().select(OFFSET, "user_id", "event_type", "value")
    signed = F.when(F.col("event_type") == "purchase", F.floor("value")).otherwise(-F.floor("value")).cast("long")
    return keyed.running(df, "user_id", OFFSET, signed, "position").select(OFFSET, "user_id", "position")


POSITIONS = ", p AS (SELECT ledger_offset, user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN floor(value) ELSE -floor(value) END) OVER (PARTITION BY user_id ORDER BY ledger_offset) AS BIGINT) AS position FROM log) "


@query(LOG + POSITIONS + "SELECT * FROM p")
def running_position(spark, sf_dir):
    return _positions(spark, sf_dir)


@query(LOG + POSITIONS + "SELECT * FROM p WHERE abs(position) >= 100")
def position_alerts(spark, sf_dir):
    return _positions(spark, sf_dir).where(F.abs("position") >= 100)


@query(LOG + ", o AS (SELECT ledger_offset, value AS v FROM log WHERE event_id % 11 <> 0), w AS (SELECT ledger_offset, CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS v FROM log WHERE event_id % 13 <> 0) SELECT ledger_offset, o.v AS old_v, w.v AS new_v FROM o FULL JOIN w USING (ledger_offset) WHERE o.v IS DISTINCT FROM w.v")
def migration_diff(spark, sf_dir):
    df = stream(spark, sf_dir).snapshot().frame()
    old = df.where("event_id % 11 <> 0").select(OFFSET, F.col("value").alias("v"))
    new = df.where("event_id % 13 <> 0").select(OFFSET, F.expr("CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END").alias("v"))
    return keyed.difference(old, new, OFFSET, ["v"])


@query(LOG + ", e AS (SELECT user_id, ledger_offset AS o FROM log WHERE event_type = 'error'), p AS (SELECT user_id, ledger_offset AS o, value AS v FROM log WHERE event_type = 'purchase') SELECT e.user_id, e.o AS at, p.v AS last_purchase FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.o >= p.o")
def as_of_lookup(spark, sf_dir):
    df = stream(spark, sf_dir).snapshot().frame()
    e = df.where("event_type = 'error'").select("user_id", F.col(OFFSET).alias("at"))
    p = df.where("event_type = 'purchase'").select("user_id", F.col(OFFSET).alias("at"), "value")
    return keyed.as_of(e, p, "user_id", "at", "value", "last_purchase")


@query(LOG + "SELECT ledger_offset, user_id FROM log WHERE ledger_offset >= n // 3 AND event_type = 'view'")
def catch_up_join(spark, sf_dir):
    """A third is out of replay's bound, so it comes from the snapshot; there is nothing left to follow."""
    df, _ = catch_up(stream(spark, sf_dir), total(spark, sf_dir) // 3, {"event_type": "view"}, max_replay=10)
    return df.select(OFFSET, "user_id")


@query("SELECT up_to, count(*) AS n_rows FROM (SELECT CASE WHEN value <= 10 THEN 10.0 WHEN value <= 50 THEN 50.0 END::DOUBLE AS up_to FROM events) GROUP BY up_to")
def lag_histogram(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("sent", F.col(TS)).withColumn("stored", F.col(TS) + (F.col("value") * 1e6).cast("long"))
    return keyed.lag_histogram(df, "sent", "stored", [10.0, 50.0]).withColumnRenamed("rows", "n_rows")


# -- SQL over the log


def _sql(name: str, text: str, oracle: str | None = None, **options):
    def run(spark, sf_dir):
        return stream(spark, sf_dir).sql(text, **options)

    run.__name__ = name
    query(LOG + (oracle or text))(run)


_sql("group_agg", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS top FROM log GROUP BY event_type")
_sql("count_all", "SELECT count(*) AS n, min(ledger_offset) AS first, max(ledger_offset) AS last FROM log")
_sql(
    "error_rate_p95",
    "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value) FILTER (WHERE event_type <> 'error'), 6) AS p95 FROM log GROUP BY user_id",
    "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(quantile_cont(value, 0.95) FILTER (WHERE event_type <> 'error'), 6) AS p95 FROM log GROUP BY user_id",
)
_sql("feed_latency", "SELECT event_type, max(ledger_ts - 1704067200000000) AS worst_us FROM log GROUP BY event_type")
_sql(
    "attr_map_group",
    "SELECT from_json(props, 'map<string,bigint>')['k'] AS k, count(*) AS n FROM log WHERE props IS NOT NULL GROUP BY 1",
    "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM log WHERE props IS NOT NULL GROUP BY 1",
)
_sql(
    "unnest_items",
    "SELECT ledger_offset, user_id, pos, t FROM log LATERAL VIEW posexplode(sequence(event_id % 3, event_id % 3 + 2)) x AS pos, t",
    "SELECT ledger_offset, user_id, CAST(p AS INT) AS pos, event_id % 3 + p AS t FROM log, range(3) r(p)",
)
_sql("window_functions", "SELECT ledger_offset, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w AS q, lag(value) OVER w AS before, lead(value) OVER w AS after, first_value(value) OVER w AS first FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ledger_offset)", "SELECT ledger_offset, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS d, CAST(ntile(4) OVER w AS INT) AS q, lag(value) OVER w AS before, lead(value) OVER w AS after, first_value(value) OVER w AS first FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ledger_offset)")
_sql("moving_average", "SELECT ledger_offset, round(avg(value) OVER (PARTITION BY user_id ORDER BY ledger_offset ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS avg5 FROM log")
_sql("set_operations", "SELECT user_id FROM log WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM log WHERE event_type = 'signup' EXCEPT SELECT user_id FROM log WHERE value > 99.5 AND event_type = 'view'")
_sql("distinct_union", "SELECT user_id, event_type FROM log WHERE value > 90 UNION SELECT user_id, event_type FROM log WHERE value < 10")
_sql("rollup_totals", "SELECT event_type, user_id % 10 AS g, count(*) AS n, grouping(event_type) AS a FROM log GROUP BY ROLLUP (event_type, user_id % 10)", "SELECT event_type, user_id % 10 AS g, count(*) AS n, CAST(grouping(event_type) AS TINYINT) AS a FROM log GROUP BY ROLLUP (event_type, user_id % 10)")
_sql("cube_counts", "SELECT event_type, user_id % 4 AS g, count(*) AS n FROM log GROUP BY CUBE (event_type, user_id % 4)")
_sql("top_k", "SELECT ledger_offset, value FROM log ORDER BY value DESC, ledger_offset LIMIT 100")
_sql("page", "SELECT ledger_offset, value FROM log ORDER BY ledger_offset LIMIT 50 OFFSET 100")
_sql("distinct_users", "SELECT event_type, count(DISTINCT user_id) AS users FROM log GROUP BY event_type")
_sql("cross_numbers", "SELECT r.id AS k, count(*) AS n FROM log, range(4) r WHERE log.user_id % 4 = r.id GROUP BY r.id", "SELECT r.id AS k, count(*) AS n FROM log, range(4) r(id) WHERE log.user_id % 4 = r.id GROUP BY r.id")
_sql("correlated_exists", "SELECT DISTINCT user_id FROM log a WHERE EXISTS (SELECT 1 FROM log b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND b.value > 95)")
_sql("sql_filters_narrow", "SELECT count(*) AS n, max(value) AS top FROM log", "SELECT count(*) AS n, max(value) AS top FROM log WHERE event_type = 'view' AND ledger_offset >= 100", filters=[("event_type", "==", "view")], start_offset=100)


# -- exactly-once appends


def _frames(spark, sf_dir, gaps: bool):
    """Each event is a frame of its user; every third one is sent again, and with ``gaps`` some jump ahead."""
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("publisher"), "user_id", F.col("event_id").alias("arrival"), "value")
    ranked = keyed.running(e, "publisher", "arrival", F.lit(1), "rn")
    seq = F.col("rn") - F.floor(F.col("rn") / 3)
    seq = F.when(F.col("rn") % 7 == 0, seq + 5).otherwise(seq) if gaps else seq
    return ranked.withColumn("seq", seq.cast("long")).withColumn("count", F.lit(2 if gaps else 1).cast("long"))


FRAMES = "WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS publisher, event_id AS arrival, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), f AS (SELECT publisher, arrival, value, rn, rn - rn // 3 AS seq FROM e) "


@query(FRAMES + "SELECT publisher, arrival, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY publisher, seq ORDER BY arrival) AS r FROM f) WHERE r = 1")
def dedupe_append(spark, sf_dir):
    frames = _frames(spark, sf_dir, False)
    return dedupe.accepted(frames.withColumn("index", F.lit(0)), dedupe.judge(frames)).select("publisher", "arrival", "seq", "value")


@query(FRAMES + "SELECT publisher, max(seq) AS last_seq FROM f GROUP BY publisher")
def dedupe_marks(spark, sf_dir):
    return dedupe.marks_after(dedupe.judge(_frames(spark, sf_dir, False)))


@query(
    FRAMES
    + """, g AS (SELECT publisher, arrival, rn, CASE WHEN rn % 7 = 0 THEN seq + 5 ELSE seq END AS seq FROM f),
j AS (SELECT publisher, arrival, rn, seq, seq > 1 AS gap, CASE WHEN seq > 1 THEN 0 ELSE seq + 1 END AS last, CASE WHEN seq > 1 THEN 0 ELSE 2 END AS append FROM g WHERE rn = 1
UNION ALL SELECT g.publisher, g.arrival, g.rn, g.seq, g.seq > j.last + 1, CASE WHEN g.seq > j.last + 1 THEN j.last ELSE greatest(j.last, g.seq + 1) END, CASE WHEN g.seq > j.last + 1 THEN 0 ELSE 2 - least(2, j.last - g.seq + 1) END FROM j JOIN g ON g.publisher = j.publisher AND g.rn = j.rn + 1)
SELECT publisher, arrival, seq, gap, CAST(append AS BIGINT) AS append, CAST(last AS BIGINT) AS last FROM j"""
)
def dedupe_gaps(spark, sf_dir):
    return dedupe.judge(_frames(spark, sf_dir, True)).select("publisher", "arrival", "seq", "gap", "append", "last")


@query(FRAMES + "SELECT d.publisher, d.seq, CASE WHEN seq > m - 64 THEN d.seq * 10 END AS \"offset\" FROM (SELECT publisher, seq FROM f WHERE rn % 3 = 0) d JOIN (SELECT publisher, max(seq) AS m FROM f GROUP BY publisher) USING (publisher)")
def dedupe_original_offset(spark, sf_dir):
    frames = _frames(spark, sf_dir, False)
    ranges = frames.groupBy("publisher", "seq").agg(F.first("count").alias("count")).select("publisher", F.col("seq").alias("first_seq"), "count", (F.col("seq") * 10).alias("first_offset"))
    return dedupe.original_offsets(frames.where("rn % 3 = 0").select("publisher", "seq"), ranges, DEDUPE_WINDOW)


# -- outbox and inbox


def _outbox(spark, sf_dir):
    e = events(spark, sf_dir)
    return keyed.running(e, "user_id", OFFSET, F.lit(1), "seq").select(F.col("event_type").alias("stream"), F.col("user_id").cast("string").alias("publisher_id"), F.col("seq"), F.col("props").alias("row"), F.col(TS).alias("enqueued_at"))


OUTBOX = "WITH o AS (SELECT event_type AS stream, CAST(user_id AS VARCHAR) AS publisher_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, props AS row, epoch_us(ts) AS enqueued_at FROM events) "


@query(OUTBOX + "SELECT stream, publisher_id, count(*) AS n_rows, CAST(sum(strlen(row)) AS BIGINT) AS bytes, min(enqueued_at) AS oldest FROM o GROUP BY stream, publisher_id")
def outbox_backlog(spark, sf_dir):
    return outbox.backlog(_outbox(spark, sf_dir)).withColumnRenamed("rows", "n_rows")


@query(OUTBOX + "SELECT stream, publisher_id, CASE WHEN stream = 'click' AND publisher_id = '7' AND seq > 5 THEN seq - 1 ELSE seq END AS seq FROM o WHERE NOT (stream = 'click' AND publisher_id = '7' AND seq = 5)")
def outbox_renumber(spark, sf_dir):
    return outbox.drop_refused(_outbox(spark, sf_dir), "click", "7", 5).select("stream", "publisher_id", "seq")


@query(OUTBOX + "SELECT stream, publisher_id, seq FROM o WHERE NOT seq <= CAST(publisher_id AS BIGINT) % 20")
def outbox_acknowledged(spark, sf_dir):
    o = _outbox(spark, sf_dir)
    marks = o.select("stream", "publisher_id").distinct().withColumn("last_seq", F.col("publisher_id").cast("long") % 20)
    return outbox.acknowledged(o, marks).select("stream", "publisher_id", "seq")


@query("SELECT event_id, 499 + row_number() OVER (ORDER BY event_id) AS seq FROM events WHERE event_type = 'signup'")
def outbox_enqueue(spark, sf_dir):
    return outbox.enqueue(events(spark, sf_dir).where("event_type = 'signup'").select("event_id"), "event_id", 500)


@query("WITH b AS (SELECT user_id, event_id, sum(strlen(props)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) SELECT user_id, event_id FROM b WHERE r = 1 OR (b < 200 AND r <= 15)")
def inbox_window(spark, sf_dir):
    return keyed.budget(events(spark, sf_dir), "user_id", "event_id", F.octet_length("props"), 200, 15).select("user_id", "event_id")


@query("SELECT event_id + 1 AS \"offset\", CAST(user_id AS VARCHAR) AS subscriber_id FROM events WHERE event_id + 1 > (user_id * 37) % 1000")
def inbox_insert(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.lit("s").alias("stream"), F.col("user_id").cast("string").alias("subscriber_id"), F.col(OFFSET).alias("offset"))
    subs = rows.select("stream", "subscriber_id").distinct().withColumn("last_received_offset", F.col("subscriber_id").cast("long") * 37 % 1000)
    return outbox.insertable(rows, subs).select("offset", "subscriber_id")


# -- codecs


@query("SELECT event_id, lower(hex(encode(event_type))) AS h, event_type AS back FROM events")
def hex_roundtrip(spark, sf_dir):
    h = codec.to_text(F.col("event_type").cast("binary"), "base16")
    return events(spark, sf_dir).select("event_id", h.alias("h")).withColumn("back", codec.to_bytes(F.upper("h"), "base16").cast("string"))


@query("SELECT event_id, base64(encode(repeat(props, 12))) AS b, repeat(props, 12) AS back FROM events")
def base64_roundtrip(spark, sf_dir):
    b = codec.to_text(F.repeat("props", F.lit(12)).cast("binary"), "base64")
    return events(spark, sf_dir).select("event_id", b.alias("b")).withColumn("back", codec.to_bytes(F.col("b"), "base64").cast("string"))


@query("SELECT event_id + 1 AS ledger_offset, epoch_us(ts) AS ledger_ts, user_id, event_type, value, props FROM events")
def wire_frames(spark, sf_dir):
    struct = to_struct({"type": "object", "properties": {k: V2["properties"][k] for k in ("user_id", "event_type", "value", "props")}, "required": ["user_id", "event_type", "value", "props"]})
    sent = events(spark, sf_dir).select(codec.frames(struct).alias("frame"))
    return sent.select(*codec.parse_frames(F.col("frame"), struct)).select(OFFSET, TS, "row.*")


# -- relational coverage over the star schema, as plain Spark SQL


def _star(name: str, text: str, oracle: str | None = None, plan=None):
    """``plan``, if there is one, gives the rows of ``text`` by another route."""

    def run(spark, sf_dir):
        if plan is not None:
            return plan(spark, sf_dir)
        own = spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            own.conf.set(key, spark.conf.get(key))
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
            if t in text:
                own.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return own.sql(text)

    run.__name__ = name
    query(oracle or text)(run)


_star("star_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
_star("star_join", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey < 3 GROUP BY n_name")
_star("star_semi", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority")
_star("star_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
_star("star_outer", "SELECT c_mktsegment, count(o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
_star("star_range_join", "SELECT a.p_size, count(*) AS n FROM part a JOIN part b ON b.p_size BETWEEN a.p_size - 1 AND a.p_size + 1 AND a.p_brand = b.p_brand GROUP BY a.p_size", plan=lambda spark, sf_dir: keyed.pairs_in_range(read(spark, sf_dir, "part"), "p_brand", "p_size", 1, "n"))
_star("star_scalar_subquery", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)")


from . import queries_sql, queries_written  # noqa: E402, F401  (they add theirs)
