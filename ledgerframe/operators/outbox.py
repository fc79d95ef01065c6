"""Queries over outbox and inbox tables: sequences, backlog, reconciliation, renumbering, filling and taking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AcknowledgedRowsLost, StoreBehindBroker, StreamMismatch
from ..sources.files import stored

OUTBOX = "stream string, publisher_id string, seq bigint, row string, enqueued_at bigint"
PUBLISHERS = "stream string, publisher_id string, next_seq bigint, stream_id string"
INBOX = "stream string, subscriber_id string, offset bigint, ts bigint, row string, received_at bigint"
SUBSCRIBERS = "stream string, subscriber_id string, last_received_offset bigint, stream_id string"
KEY = ["stream", "publisher_id"]


def enqueue(rows: DataFrame, order: str, next_seq: int) -> DataFrame:
    """``rows`` of one publisher numbered without gaps from ``next_seq`` on, in order.

    They are sorted once and stored with their places, so the partitions that are counted are those that are numbered,
    also of a source that doesn't repeat itself.
    """
    placed = stored(rows.orderBy(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "outbox")
    # One row for each partition.
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(before, "_p").withColumn("seq", F.col("_b") + F.col("_i") + next_seq).drop("_p", "_i", "_b")


def backlog(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy(*KEY).agg(F.count("*").alias("rows"), F.sum(F.octet_length("row")).cast("long").alias("bytes"), F.min("enqueued_at").alias("oldest"))


def pending(outbox: DataFrame, stream: str, publisher: str, limit: int) -> DataFrame:
    return outbox.where((F.col("stream") == stream) & (F.col("publisher_id") == publisher)).orderBy("seq").limit(limit)


@dataclass(frozen=True)
class Standing:
    next_seq: int
    acked: int
    stream_id: str | None = None


def reconcile(standing: Standing, last_seq: int, stream_id: str) -> Standing:
    """What a publisher may drop after the other side says its last sequence number."""
    if standing.stream_id not in (None, stream_id):
        raise StreamMismatch(f"bound to stream {standing.stream_id}, met {stream_id}")
    if last_seq < standing.acked:
        raise AcknowledgedRowsLost(f"{standing.acked} was acknowledged, the stream holds {last_seq}")
    if last_seq >= standing.next_seq:
        raise StoreBehindBroker(f"the stream holds {last_seq}, the store would number {standing.next_seq} next")
    return Standing(standing.next_seq, last_seq, stream_id)


def acknowledged(outbox: DataFrame, marks: DataFrame) -> DataFrame:
    """The outbox without rows up to each publisher's mark (stream, publisher_id, last_seq)."""
    m = marks.select(*[F.col(c).alias(f"_{c}") for c in KEY], "last_seq")
    gone = (F.col("stream") == F.col("_stream")) & (F.col("publisher_id") == F.col("_publisher_id")) & (F.col("seq") <= F.col("last_seq"))
    return outbox.join(m, gone, "left_anti")


def drop_refused(outbox: DataFrame, stream: str, publisher: str, seq: int) -> DataFrame:
    """The outbox without a refused row; those of its publisher above it move down by one."""
    own = (F.col("stream") == stream) & (F.col("publisher_id") == publisher)
    return outbox.where(~(own & (F.col("seq") == seq))).withColumn("seq", F.when(own & (F.col("seq") > seq), F.col("seq") - 1).otherwise(F.col("seq")))


def insertable(rows: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Of received ``rows`` those above their subscriber's position: a position only moves forward."""
    s = subscribers.select(F.col("stream").alias("_s"), F.col("subscriber_id").alias("_u"), "last_received_offset")
    met = rows.join(s, (F.col("stream") == F.col("_s")) & (F.col("subscriber_id") == F.col("_u")), "left")
    return met.where(F.col("offset") > F.coalesce("last_received_offset", F.lit(0))).drop("_s", "_u", "last_received_offset")


def positions(subscribers: DataFrame, inserted: DataFrame) -> DataFrame:
    moved = inserted.groupBy("stream", "subscriber_id").agg(F.max("offset").alias("_o"))
    return subscribers.join(moved, ["stream", "subscriber_id"], "left").withColumn("last_received_offset", F.greatest("last_received_offset", F.coalesce("_o", "last_received_offset"))).drop("_o")


def take(inbox: DataFrame, stream: str, subscriber: str, limit: int) -> DataFrame:
    return inbox.where((F.col("stream") == stream) & (F.col("subscriber_id") == subscriber)).orderBy("offset").limit(limit)


def taken(inbox: DataFrame, stream: str, subscriber: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the ``limit`` rows of lowest offset, the inbox without them). An offset is one row, so what is taken are offsets up to the last."""
    out = stored(take(inbox, stream, subscriber, limit), "taken")
    last = out.agg(F.max("offset")).first()[0]
    gone = (F.col("stream") == stream) & (F.col("subscriber_id") == subscriber) & (F.col("offset") <= (-1 if last is None else last))
    return out, inbox.where(~gone)


class Hysteresis:
    """Pauses at the upper bound and resumes strictly below a share of it."""

    def __init__(self, bound: int, resume_at: float = 0.5):
        self.bound, self.low, self.paused = bound, bound * resume_at, False

    def see(self, size: int) -> bool:
        self.paused = size >= self.low if self.paused else size >= self.bound
        return self.paused
