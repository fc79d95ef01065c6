"""Event-time windows over rows with a stamp, the same for tables and for streams: tumbling, sliding, sessions, joins within an interval.

On a stream, ``late`` is how far behind the newest stamp a row may be and still count; windows are given out and state is
dropped once the watermark has passed them. On a table it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

TIME = "event_time"


def with_time(df: DataFrame, stamp: str, late: str | None = None) -> DataFrame:
    """``df`` with ``event_time``, from a stamp in microseconds."""
    out = df.withColumn(TIME, F.timestamp_micros(F.col(stamp)))
    return out.withWatermark(TIME, late) if late else out


def grouped(df: DataFrame, width: str, *, slide: str | None = None, keys: list[str] | None = None) -> GroupedData:
    """Windows of one width, begun every ``slide`` (default: end to end), by ``window`` and ``keys``."""
    return df.groupBy(F.window(TIME, width, slide) if slide else F.window(TIME, width), *(keys or []))


def sessions(df: DataFrame, gap: str, *, keys: list[str] | None = None) -> GroupedData:
    """Runs of rows that are less than ``gap`` apart, by ``session_window`` and ``keys``."""
    return df.groupBy(F.session_window(TIME, gap), *(keys or []))


def joined_within(left: DataFrame, right: DataFrame, key: str, within: str, how: str = "inner") -> DataFrame:
    """Rows of ``left`` with rows of ``right`` of the same key that are stamped up to ``within`` later.

    Both sides need a watermark if they are streams; state is then bounded by it and the interval.
    """
    r = right.select([F.col(f"`{c}`").alias(f"right_{c}") for c in right.columns])
    time = F.col(f"right_{TIME}")
    return left.join(r, (F.col(key) == F.col(f"right_{key}")) & (time >= F.col(TIME)) & (time <= F.col(TIME) + F.expr(f"INTERVAL {within}")), how)
