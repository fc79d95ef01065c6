"""A fixed-point view of a stream: the pieces of its logs that it reads, pinned by commit, and a tail.

Which pieces are read is settled on the driver (offset ranges, statistics, stamps); what is read from
them is one declarative plan, which Catalyst pushes into the Parquet scans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SnapshotUnavailable, TailTooLarge
from ..functions import terms as predicates
from ..limits import EARLIEST, LATEST, MAX_TAIL, OFFSET, PAGE_BYTES, PAGE_ROWS, TS
from ..schema import SYSTEM
from ..sources.log import Log, State
from . import manifest
from .metadata import Entry, Metadata


@dataclass(frozen=True)
class Piece:
    """One log as of one commit, within [start, stop)."""

    entry: Entry
    log: Log
    state: State
    start: int
    stop: int
    statistics: dict | None
    until_ts: int | None = None

    def frame(self, start: int | None, stop: int | None) -> DataFrame:
        self.check()
        low = max(self.start, start or 0)
        high = self.stop if stop is None else min(self.stop, stop)
        df = self.log.read(self.state, low, high)
        return df if self.until_ts is None else df.where(F.col(TS) <= self.until_ts)

    def check(self) -> None:
        """A sealed log with fewer rows than its manifest row counted is short, and no answer comes from it."""
        if self.entry.end is not None and self.statistics is not None and self.statistics.get("rows") is not None:
            if self.state.rows < self.statistics["rows"]:
                raise SnapshotUnavailable(f"{self.entry.name} holds {self.state.rows} rows of {self.statistics['rows']}")


class Snapshot:
    def __init__(self, spark: SparkSession, pieces: list[Piece], end_offset: int, live: T.StructType, tail: DataFrame | None = None, floor: int = EARLIEST, only: Column | None = None):
        self.spark, self.pieces, self.end_offset, self.live, self.tail, self._floor, self.only = spark, pieces, end_offset, live, tail, floor, only

    def narrowed(self, only: Column) -> Snapshot:
        """The same snapshot, of which all reads give rows that satisfy ``only``."""
        return Snapshot(self.spark, self.pieces, self.end_offset, self.live, self.tail, self._floor, only if self.only is None else self.only & only)

    @property
    def schema(self) -> T.StructType:
        """All columns of all pieces by name, the live log's even if it has no rows yet; the log's own columns last."""
        fields: dict[str, T.StructField] = {}
        for struct in [*[p.entry.struct for p in self.pieces], self.live]:
            for f in struct:
                fields.setdefault(f.name, f)
        return T.StructType([*[T.StructField(f.name, f.dataType, True, f.metadata) for f in fields.values()], *SYSTEM.fields])

    def relevant(self, filters=None, start_offset: int | None = None, end_offset: int | None = None) -> list[Piece]:
        """The pieces that may hold a matching row: by offsets, then by statistics. ``filters`` alone skips logs."""
        terms = predicates.check_terms(filters)
        out = []
        for p in self.pieces:
            if start_offset is not None and p.stop <= start_offset or end_offset is not None and p.start >= end_offset or p.start >= p.stop:
                continue
            if p.statistics is not None and manifest.can_skip(p.statistics, p.entry.struct, terms):
                continue
            # A column that a log doesn't have is null there, which no comparison matches.
            if any(c not in p.log.stored.names for c, _, _ in terms):
                continue
            out.append(p)
        return out

    def frame(self, filters=None, start_offset: int | None = None, end_offset: int | None = None) -> DataFrame:
        """The union by name of the relevant pieces and the tail, bounds inside each branch, ``filters`` over all."""
        stop = self.end_offset if end_offset is None else min(end_offset, self.end_offset)
        whole = self.schema
        predicates.check_terms(filters, whole)
        frames = [p.frame(start_offset, stop) for p in self.relevant(filters, start_offset, stop)]
        if self.tail is not None:
            tail = self.tail.where(F.col(OFFSET) < stop)
            frames.append(tail if start_offset is None else tail.where(F.col(OFFSET) >= start_offset))
        if not frames:
            return self.spark.createDataFrame([], whole)
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        have = set(df.columns)
        # Columns of logs that aren't read are null, also those of a live log without rows.
        df = df.select(*[F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in whole])
        df = predicates.apply(df, None, filters, whole)
        return df if self.only is None else df.where(self.only)

    def scan(self, *, columns: list[str] | None = None, where: str | None = None, filters=None, start_offset: int | None = None, end_offset: int | None = None, ordered: bool = True) -> DataFrame:
        """Rows in offset order; ``columns`` need not hold the offset. ``ordered=False`` leaves out the sort for what aggregates."""
        df = predicates.apply(self.frame(filters, start_offset, end_offset), where)
        if ordered:
            df = df.orderBy(OFFSET)
        return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df

    def sql(self, query: str, *, filters=None, start_offset: int | None = None, end_offset: int | None = None) -> DataFrame:
        """Spark SQL over a view ``log`` of this snapshot, in a session of its own, so no two readers share the view."""
        own = self.spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            own.conf.set(key, self.spark.conf.get(key))
        logical = self.frame(filters, start_offset, end_offset)._jdf.queryExecution().logical()
        self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, logical).createOrReplaceTempView("log")
        return own.sql(query)

    def rows(self, start: int = EARLIEST, stop: int | None = None, *, page_bytes: int | None = None, page_rows: int | None = None, width: int = 1) -> Iterator[tuple[int, int, dict]]:
        """(offset, stamp, row) in offset order, log by log, then the tail; the driver holds a page at a time."""
        for page, _ in self.pages(start, stop, page_bytes=page_bytes, page_rows=page_rows, width=width):
            yield from page

    def pages(self, start: int = EARLIEST, stop: int | None = None, *, page_bytes: int | None = None, page_rows: int | None = None, width: int = 1) -> Iterator[tuple[list[tuple[int, int, dict]], int]]:
        """Pages of :meth:`rows` that have rows, each with the width that the next one gets.

        A page is a range of offsets. The first is ``width`` offsets wide; each next one is as wide as ``page_bytes`` and
        ``page_rows`` allow, going by the bytes and rows of the one before, and at most eight times as wide. After an empty page
        the next one begins at the next offset that a row has.
        """
        page_bytes, page_rows = page_bytes or PAGE_BYTES, page_rows or PAGE_ROWS
        end = self.end_offset if stop is None else min(stop, self.end_offset)
        names = [c for c in self.schema.names if c not in SYSTEM.names]
        whole = T.StructType([f for f in self.schema if f.name in names])
        for part in [*[Snapshot(self.spark, [p], min(p.stop, end), whole, None, self._floor, self.only) for p in self.pieces], *([Snapshot(self.spark, [], end, whole, self.tail, self._floor, self.only)] if self.tail is not None else [])]:
            at = max([start, *[p.start for p in part.pieces]])
            if part.tail is not None:
                at = max([start, *[p.stop for p in self.pieces]])
            while at < part.end_offset:
                own = part.frame(start_offset=at, end_offset=min(at + width, part.end_offset))
                # An offset has one row, so a page that is no wider than it may have rows is sorted by one task, in one stage.
                small = part.only is None and width <= page_rows
                page, size = local_rows(own.coalesce(1).sortWithinPartitions(OFFSET) if small else own.orderBy(OFFSET), names)
                at = min(at + width, part.end_offset)
                if page:
                    width = max(1, min(8 * width, int(width * min(page_bytes / max(size, 1), page_rows / len(page)))))
                    yield page, width
                elif at < part.end_offset:
                    found = part.frame(start_offset=at).agg(F.min(OFFSET)).first()[0]
                    at, width = (part.end_offset, 1) if found is None else (found, 1)

    def to_arrow(self, **options):
        """What :meth:`scan` gives, as one Arrow table on the driver."""
        return self.scan(**options).toArrow()

    def floor(self) -> int | None:
        """The lowest offset held, from the records where they say; None if nothing is held."""
        for p in self.pieces:
            if p.until_ts is None and p.state.first is not None and p.state.first >= p.start and p.state.first < p.stop:
                return p.state.first
            got = p.frame(None, None).agg(F.min(OFFSET)).first()[0]
            if got is not None:
                return got
        return self.tail.agg(F.min(OFFSET)).first()[0] if self.tail is not None else None

    def count(self) -> int:
        return self.frame().count()


def local_rows(df: DataFrame, names: list[str]) -> tuple[list[tuple[int, int, dict]], int]:
    """(offset, stamp, row) of all rows of ``df``, and about how many bytes they have. Plain columns come as Arrow."""
    if all(isinstance(f.dataType, (T.LongType, T.IntegerType, T.DoubleType, T.StringType, T.BooleanType)) for f in df.schema):
        table = df.toArrow()
        own = {c: table.column(c).to_pylist() for c in (OFFSET, TS, *names)}
        rows = [dict(zip(names, cells)) for cells in zip(*(own[c] for c in names))] if names else [{} for _ in own[OFFSET]]
        return list(zip(own[OFFSET], own[TS], rows)), table.nbytes
    page = df.collect()
    size = sum(len(repr(tuple(r))) for r in page)
    cells = [r.asDict(recursive=True) for r in page]
    return [(c[OFFSET], c[TS], {n: c[n] for n in names}) for c in cells], size


def bound(log: Log, entry: Entry, state: State | None, meta: Metadata, **cells) -> Piece:
    state = state or log.state()
    stats = next((m for m in meta.manifest if m["log"] == entry.name), None)
    return Piece(entry, log, state, max(entry.start, meta.floor), entry.end or state.end, stats, **cells)


def assemble(spark: SparkSession, root: str, meta: Metadata, *, as_of_offset: int | None = None, as_of_ts: int | None = None, tail: DataFrame | None = None, max_tail: int = MAX_TAIL, log_of: Callable[[Entry], Log] | None = None) -> Snapshot:
    """The snapshot of a stream as of a point: the end of what is stored, an offset (not included), or a stamp (included).

    An offset beyond what logs and tail hold, or a stamp that later rows may still get, is refused.
    """
    if as_of_offset is not None and as_of_ts is not None:
        raise ValueError("as of an offset or as of a stamp, not both")
    pieces = []
    log_of = log_of or (lambda entry: Log(spark, f"{root}/{meta.stream}/{entry.name}", entry.struct, list(entry.sort_by)))
    for entry in meta.logs:
        piece = bound(log_of(entry), entry, None, meta, until_ts=as_of_ts)
        if as_of_ts is not None and entry.start_ts is not None and entry.start_ts > as_of_ts:
            continue
        pieces.append(piece)
    end = max((p.stop for p in pieces), default=meta.logs[0].start)
    if tail is not None:
        span = tail.where(F.col(OFFSET) >= end).agg(F.count("*").alias("n"), F.min(OFFSET).alias("low"), F.max(OFFSET).alias("high")).first()
        if span.n > max_tail:
            raise TailTooLarge(f"the tail has {span.n} rows, the bound is {max_tail}")
        if span.n and span.low > end:
            raise SnapshotUnavailable(f"offsets [{end}, {span.low}) are in neither the logs nor the tail")
        tail = tail.where(F.col(OFFSET) >= end) if as_of_ts is None else tail.where((F.col(OFFSET) >= end) & (F.col(TS) <= as_of_ts))
        end = max(end, (span.high or 0) + 1)
    if as_of_offset not in (None, LATEST):
        if as_of_offset > end:
            raise SnapshotUnavailable(f"as of offset {as_of_offset}, but only offsets below {end} are held")
        if as_of_offset < meta.floor:
            raise SnapshotUnavailable(f"as of offset {as_of_offset}, but retention has reached {meta.floor}")
        pieces = [p for p in pieces if p.start < as_of_offset]
        end = as_of_offset
    if as_of_ts is not None:
        newest = max((p.state.last_ts or 0 for p in (bound(Log(spark, f"{root}/{meta.stream}/{meta.live.name}", meta.live.struct), meta.live, None, meta),)), default=0)
        sealed = max((e.end_ts or 0 for e in meta.logs), default=0)
        if as_of_ts > max(newest, sealed) and tail is None:
            raise SnapshotUnavailable(f"as of stamp {as_of_ts}, but the newest row is of {max(newest, sealed)}")
    return Snapshot(spark, pieces, end, meta.live.struct, tail, meta.floor)
