"""Exactly-once appends by (publisher, sequence).

A frame is (publisher, arrival, seq, count): ``count`` rows from sequence number ``seq`` on. In order of
arrival: a frame that begins beyond the next expected number is a gap and nothing of it is appended;
otherwise its leading duplicates are passed over and the rest is appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RowsRefused

VERDICT = "publisher string, arrival long, seq long, count long, skip long, append long, gap boolean, last long"


def check_publisher(publisher: str) -> None:
    if not 1 <= len(publisher.encode()) <= 128:
        raise RowsRefused("a publisher's id has 1 to 128 bytes")


def judge_one(last: int, seq: int, count: int) -> tuple[int, int, bool, int]:
    """(skip, append, gap, last) of one frame after sequence number ``last``."""
    if seq < 1:
        raise RowsRefused(f"sequence numbers begin at 1, not {seq}")
    if seq > last + 1:
        return 0, 0, True, last
    skip = min(count, last - seq + 1)
    return skip, count - skip, False, max(last, seq + count - 1)


def judge(frames: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """A verdict for each frame. ``marks`` (publisher, last_seq) is where publishers stand.

    The rule is a fold in order of arrival. As long as a publisher leaves no gap, where it stands is the largest number it
    has sent so far, which is a running maximum; only the frames of publishers that leave one are folded, each
    publisher's sorted and streamed through it. No group is held in memory, however many frames a publisher sends.
    """
    own = frames.select(F.col("publisher").cast("string"), F.col("arrival").cast("long"), F.col("seq").cast("long"), F.col("count").cast("long"), F.lit(None).cast("long").alias("mark"))
    if marks is not None:
        # A mark comes before all frames of its publisher.
        own = own.unionByName(marks.select(F.col("publisher").cast("string"), F.lit(None).cast("long").alias("arrival"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("count"), F.col("last_seq").cast("long").alias("mark")))
    turn = Window.partitionBy("publisher").orderBy(F.col("arrival").asc_nulls_first())
    end = F.coalesce("mark", F.col("seq") + F.col("count") - 1)
    own = own.withColumn("before", F.coalesce(F.max(end).over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    odd = F.coalesce((F.col("seq") > F.col("before") + 1) | (F.col("seq") < 1), F.lit(False))
    own = own.withColumn("odd", F.max(odd).over(Window.partitionBy("publisher")))
    skip = F.least(F.col("count"), F.col("before") - F.col("seq") + 1)
    plain = own.where(~F.col("odd") & F.col("mark").isNull()).select(
        "publisher", "arrival", "seq", "count", skip.alias("skip"), (F.col("count") - skip).alias("append"), F.lit(False).alias("gap"), F.greatest("before", F.col("seq") + F.col("count") - 1).alias("last")
    )
    gaps = own.where("odd").select("publisher", "arrival", "seq", "count", "mark")
    return plain.unionByName(folded(gaps))


def folded(own: DataFrame) -> DataFrame:
    """The fold of :func:`judge` over rows (publisher, arrival, seq, count, mark)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, 0
        for batch in batches:
            out = []
            for publisher, arrival, seq, count, mark in zip(*(c.to_pylist() for c in batch.columns)):
                if publisher != now:
                    now, last = publisher, 0
                if mark is not None:
                    last = mark
                    continue
                skip, append, gap, last = judge_one(last, seq, count)
                out.append((publisher, arrival, seq, count, skip, append, gap, last))
            names = [x.split()[0] for x in VERDICT.split(", ")]
            kinds = [pa.string(), *[pa.int64()] * 5, pa.bool_(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    placed = own.repartition("publisher").sortWithinPartitions(F.col("publisher"), F.col("arrival").asc_nulls_first())
    return placed.mapInArrow(fold, VERDICT)


def marks_after(verdicts: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(publisher, last_seq) after the verdicts; ``last`` only grows, so it is a maximum with partial aggregates."""
    own = verdicts.select("publisher", F.col("last").alias("last_seq"))
    if marks is not None:
        own = own.unionByName(marks.select("publisher", "last_seq"))
    return own.groupBy("publisher").agg(F.max("last_seq").alias("last_seq"))


def accepted(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Of ``rows`` (publisher, arrival, index, ...) those that a verdict appends: index is a row's place in its frame."""
    v = verdicts.where("append > 0").select(F.col("publisher").alias("_p"), F.col("arrival").alias("_a"), "skip")
    return rows.join(v, (F.col("publisher") == F.col("_p")) & (F.col("arrival") == F.col("_a"))).where("index >= skip").drop("_p", "_a", "skip")


def original_offsets(duplicates: DataFrame, ranges: DataFrame, window: int, marks: DataFrame | None = None) -> DataFrame:
    """``duplicates`` (publisher, seq) with the offset their row got: from the ``window`` newest ranges
    (publisher, first_seq, count, first_offset) of the publisher; else, at the publisher's mark (publisher, last_seq,
    last_offset), the mark's; else null."""
    newest = _newest(ranges, window)
    met = duplicates.join(newest, "publisher", "left")
    hit = F.filter("r", lambda x: (x["first_seq"] <= F.col("seq")) & (F.col("seq") < x["first_seq"] + x["count"]))
    offset = F.try_element_at(F.transform(hit, lambda x: x["first_offset"] + F.col("seq") - x["first_seq"]), F.lit(1))
    if marks is not None:
        at = marks.select("publisher", F.col("last_seq").alias("_s"), F.col("last_offset").alias("_o"))
        met = met.join(at, "publisher", "left")
        offset = F.coalesce(offset, F.when(F.col("seq") == F.col("_s"), F.col("_o")))
    return met.select(*duplicates.columns, offset.alias("offset"))


def _newest(ranges: DataFrame, window: int) -> DataFrame:
    # WindowGroupLimit keeps at most ``window`` ranges of a publisher in each task before the shuffle.
    rank = F.row_number().over(Window.partitionBy("publisher").orderBy(F.desc("first_seq")))
    return ranges.withColumn("_n", rank).where(F.col("_n") <= window).groupBy("publisher").agg(F.collect_list(F.struct("first_seq", "count", "first_offset")).alias("r"))


STATE = T.StructType([T.StructField("last", T.LongType())])


def judge_stream(frames: DataFrame) -> DataFrame:
    """``judge`` on a stream: each publisher's last number is kept in the state store."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Judge(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", STATE)

        def handleInputRows(self, key, rows, timerValues):
            last = self.last.get()[0] if self.last.exists() else 0
            got = pd.concat(list(rows)).sort_values("arrival")
            out = []
            for r in got.itertuples():
                skip, append, gap, last = judge_one(last, int(r.seq), int(r.count_))
                out.append((key[0], int(r.arrival), int(r.seq), int(r.count_), skip, append, gap, last))
            self.last.update((last,))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in VERDICT.split(", ")])

        def close(self) -> None:
            pass

    own = frames.select(F.col("publisher").cast("string").alias("publisher"), F.col("arrival").cast("long").alias("arrival"), F.col("seq").cast("long").alias("seq"), F.col("count").cast("long").alias("count_"))
    return own.groupBy("publisher").transformWithStateInPandas(Judge(), VERDICT, outputMode="append", timeMode="none")
