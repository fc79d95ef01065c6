"""Each test holds a query or source to its whole input."""

import pytest
from pyspark.errors import StreamingQueryException

from ledgerframe import queries
from ledgerframe.errors import RowsRefused, SourceUnreadable
from ledgerframe.limits import OFFSET
from ledgerframe.sources.stream import Stream
from ledgerframe.streaming import live


def test_unnest_covers_every_row(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").collect()
    want = sorted((r.event_id + 1, r.user_id, p, r.event_id % 3 + p) for r in events for p in range(3))
    got = queries.QUERIES["unnest_items"](spark, sf_dir)
    assert sorted(map(tuple, got.select("ledger_offset", "user_id", "pos", "t").collect())) == want


PRICE = {"type": "object", "properties": {"price": {"type": "number"}}, "required": ["price"]}


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_ledger_source_reads_every_form_of_a_path(spark, tmp_path, scheme):
    live.register(spark)
    s = Stream.open(spark, f"{scheme}{tmp_path}/s t", "p", PRICE)
    name = f"forms_{len(scheme)}"
    q = spark.readStream.format("ledger").schema(s.live.stored).option("path", s.live.path).load().select(OFFSET).writeStream.format("memory").queryName(name).start()
    try:
        q.processAllAvailable()  # no commit as yet
        s.send_many([{"price": float(i)} for i in range(5)])
        q.processAllAvailable()
        assert sorted(r[0] for r in spark.table(name).collect()) == [1, 2, 3, 4, 5]
    finally:
        q.stop()


@pytest.mark.parametrize("path", ["/nowhere/p/p-v1", "file:/nowhere/p/p-v1", "nosuch://host/p/p-v1", "hdfs://localhost:1/p/p-v1"])
def test_ledger_source_refuses_what_it_cannot_read(spark, path):
    live.register(spark)
    q = spark.readStream.format("ledger").option("path", path).load().writeStream.format("memory").queryName("refused").start()
    with pytest.raises(StreamingQueryException, match="SourceUnreadable"):
        q.processAllAvailable()
    q.stop()


def test_ledger_source_reads_through_the_scheme(spark, tmp_path, monkeypatch):
    """A store that no local path reaches, and a commit whose files are gone."""
    from pyarrow import fs

    s = Stream.open(spark, f"file://{tmp_path}/streams", "p", PRICE)
    s.send_many([{"price": float(i)} for i in range(5)])
    record = tmp_path / "streams/p/p-v1/_commits/00000000.json"
    record.write_text(record.read_text().replace(f"file://{tmp_path}", "far://host"))
    far = lambda uri: (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), uri.removeprefix("far://host/"))
    monkeypatch.setattr(live, "file_system", far)
    reader = live.CommitReader("far://host/streams/p/p-v1", 0, s.live.stored)
    parts = reader.partitions({"commit": -1}, reader.latestOffset())
    assert sorted(x for p in parts for b in reader.read(p) for x in b.column(OFFSET).to_pylist()) == [1, 2, 3, 4, 5]
    for p in parts:
        (tmp_path / p.value.removeprefix("far://host/")).unlink()
    with pytest.raises(SourceUnreadable):
        reader.partitions({"commit": -1}, {"commit": 0})


@pytest.mark.parametrize("ids", ["id * 2", "id + 1", "id - 1", "nullif(id, 5)", "id - id % 2"])
def test_stream_refuses_ids_it_would_lose(spark, sf_dir, tmp_path, ids):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_id", "id")
    e.selectExpr(f"CAST({ids} AS BIGINT) AS event_id", "user_id", "event_type", "value", "props", "ts").write.parquet(f"{tmp_path}/events.parquet")
    with pytest.raises(RowsRefused):
        queries.QUERIES["count_all"](spark, str(tmp_path))


def test_range_join_makes_no_pairs_of_rows(spark, tmp_path):
    """A brand of 200,000 rows at three sizes: 4e10 pairs, counted; nulls meet nothing."""
    part = spark.range(200_000).selectExpr("if(id < 10, NULL, 'b') AS p_brand", "CAST(if(id % 5 = 4, NULL, 3 * (id % 2) + id % 4) AS INT) AS p_size")
    part.write.parquet(f"{tmp_path}/part.parquet")
    counts = {r.p_size: r["count"] for r in part.where("p_brand IS NOT NULL AND p_size IS NOT NULL").groupBy("p_size").count().collect()}
    want = {a: n * sum(m for b, m in counts.items() if abs(a - b) <= 1) for a, n in counts.items()}
    assert {r.p_size: r.n for r in queries.QUERIES["star_range_join"](spark, str(tmp_path)).collect()} == want


def numbers(spark, path, n):
    s = Stream.open(spark, f"file://{path}/streams", "p", PRICE)
    s.append(spark.range(n).selectExpr("CAST(id AS DOUBLE) AS price"), order_by=["price"])
    return s


def test_a_batch_comes_page_by_page(spark, tmp_path, monkeypatch):
    """The driver never holds more than a page, and the cursor takes all of it as one batch."""
    from ledgerframe.streaming import subscribe

    monkeypatch.setattr(subscribe, "PAGE_ROWS", 70)
    cursor = live.Cursor(spark, f"file://{tmp_path}/cursor", every=0)
    sub = subscribe.Subscription(numbers(spark, tmp_path, 1000), 1, cursor=cursor)
    pages = list(sub.receive_pages(600))
    assert [o for p in pages for o, _, _ in p] == list(range(1, 601)) and max(map(len, pages)) <= 70 and cursor.load() is None
    assert [o for o, _, _ in sub.receive(5)] == list(range(601, 606)) and cursor.load() == 600
    assert [r["price"] for _, _, r in sub.receive(1000, timeout=0)] == [float(i) for i in range(605, 1000)]
    assert sub.receive(5, timeout=0) == [] and cursor.load() == 1000


def test_a_writer_lets_only_some_rows_wait(spark, tmp_path, monkeypatch):
    from ledgerframe.sources.publish import Writer

    s, most = numbers(spark, tmp_path, 1), []
    w = Writer(s, group_rows=10)
    monkeypatch.setattr(s, "send_many", lambda rows: (most.append(len(w._waiting)), list(range(len(rows))))[1])
    with w:
        for _ in range(500):
            w.submit({"price": 1.0})
    assert 0 < max(most) <= 20


def test_a_handle_reads_a_record_once(spark, tmp_path, monkeypatch):
    from ledgerframe.sources.files import Files

    s, reads, read = numbers(spark, tmp_path, 1), [], Files.read
    monkeypatch.setattr(Files, "read", lambda self, path: (reads.append(path), read(self, path))[1])
    other = Stream.open(spark, f"file://{tmp_path}/streams", "p")
    for i in range(4):
        s.send({"price": float(i)})
        other.send({"price": float(i)})
    records = [r for r in reads if "_commits" in r]
    assert len(records) <= 2 * 9 and [o for o, _, _ in s.snapshot().rows()] == list(range(1, 10))
