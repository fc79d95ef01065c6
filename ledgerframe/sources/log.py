"""One log: Parquet files under numbered commit records.

A commit lists the files it adds and removes, each with its offsets and statistics, publisher marks and, for
a streaming batch, its id. Record N is created once; whoever comes second has a conflict. A reader pins a
commit number, and so a list of files. A record may also seal the log; nothing is appended after that.
"""

from __future__ import annotations

import contextlib
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CommitConflict, LogSealed, RowsRefused
from ..limits import FIRST_OFFSET, OFFSET, RETENTION_GRACE_US, TS
from ..plans import manifest
from ..schema import SYSTEM
from .files import Files

ROW_BITS = (1 << 33) - 1
#: Records between checkpoints of the state, and how often a commit is tried again after another writer's.
CHECKPOINT_EVERY, ATTEMPTS = 16, 8


def now_us() -> int:
    return time.time_ns() // 1000


@dataclass(frozen=True)
class State:
    """What a log holds as of one commit."""

    version: int = -1
    end: int = FIRST_OFFSET
    files: list[dict] = field(default_factory=list)
    marks: dict[str, dict] = field(default_factory=dict)
    batches: dict[str, list[int]] = field(default_factory=dict)
    last_ts: int | None = None
    sealed: dict | None = None

    def after(self, version: int, record: dict) -> State:
        """The state that a record leads to."""
        gone = set(record.get("remove", []))
        kept = [f for f in self.files if f["path"] not in gone] if gone else self.files
        return State(
            version, max(self.end, record.get("end", self.end)), [*kept, *record.get("add", [])], self.marks | record.get("marks", {}), self.batches | record.get("batches", {}),
            record.get("ts", self.last_ts), record.get("seal", self.sealed),
        )

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> State:
        return State(**json.loads(text))

    @property
    def rows(self) -> int:
        return sum(f["rows"] for f in self.files)

    @property
    def first(self) -> int | None:
        return min((f["first"] for f in self.files if f["rows"]), default=None)

    def statistics(self) -> dict:
        return manifest.merged([f["stats"] for f in self.files])


@dataclass(frozen=True)
class Staged:
    """Rows that wait to be appended: where they are, and how many come before each of their partitions."""

    path: str
    frame: DataFrame
    before: dict[int, int]
    rows: int


#: Plain cells of a column go to Spark as Arrow; any other is left to ``createDataFrame``, and what it refuses.
PLAIN = {T.LongType: (int, pa.int64()), T.IntegerType: (int, pa.int32()), T.DoubleType: (float, pa.float64()), T.StringType: (str, pa.string()), T.BooleanType: (bool, pa.bool_())}


def as_arrow(rows: list[tuple], schema: T.StructType) -> pa.Table | None:
    """``rows`` as one Arrow table with the columns of ``schema``; None if a column or a cell isn't plain."""
    out = []
    for f, column in zip(schema, zip(*rows)):
        own, kind = PLAIN.get(type(f.dataType), (None, None))
        if own is None or not set(map(type, column)) <= {own, type(None)}:
            return None
        try:
            out.append(pa.array(column, kind))
        except (pa.ArrowException, ValueError, TypeError, OverflowError):
            return None
    return pa.Table.from_arrays(out, schema.names)


def violations(df: DataFrame, schema: T.StructType) -> list[tuple[str, Any]]:
    """(what is wrong, condition) of each rule a row can break."""
    out = []
    for f in schema:
        c = F.col(f"`{f.name}`")
        if not f.nullable:
            out.append((f"{f.name} is required", c.isNull()))
        if isinstance(f.dataType, manifest.FLOATING):
            out.append((f"{f.name} isn't finite", F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))))
        if f.metadata.get("width"):
            out.append((f"{f.name} isn't {f.metadata['width']} bytes", F.coalesce(F.octet_length(c) != f.metadata["width"], F.lit(False))))
    return out


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the declared columns and types; a cell that doesn't survive its cast becomes a violation.

    Absent nullable columns become null. Whether a cast kept a cell's value is checked by casting back.
    """
    unknown = [c for c in df.columns if c not in schema.names]
    if unknown:
        raise RowsRefused(f"{', '.join(unknown)} isn't declared")
    cells, bad = [], []
    have = dict(df.dtypes)
    for f in schema:
        if f.name not in have:
            cells.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif df.schema[f.name].dataType == f.dataType or not isinstance(f.dataType, T.AtomicType):
            cells.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if df.schema[f.name].dataType != f.dataType else F.col(f"`{f.name}`"))
        else:
            c = F.col(f"`{f.name}`")
            to = c.try_cast(f.dataType)
            cells.append(to.alias(f.name))
            bad.append(F.when(c.isNotNull() & (to.isNull() | F.coalesce(to.try_cast(df.schema[f.name].dataType) != c, F.lit(True))), F.lit(f"{f.name} doesn't fit {f.dataType.simpleString()}")))
    return df.select(*cells, (F.coalesce(*bad) if bad else F.lit(None)).cast("string").alias("_cast"))


class Log:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, sort_by: list[str] | None = None):
        self.spark, self.path, self.schema, self.sort_by = spark, path, schema, sort_by or []
        self.files = Files(spark)
        self.stored = T.StructType([*schema.fields, *SYSTEM.fields])
        self._seen: State | None = None

    # -- commits

    def _record(self, version: int) -> str:
        return f"{self.path}/_commits/{version:08d}.json"

    def _versions(self, folder: str) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in self.files.names(f"{self.path}/{folder}") if re.fullmatch(r"\d{8,}\.json", x))

    def state(self, version: int | None = None) -> State:
        """What the log holds as of ``version`` (default: now): the newest checkpoint up to it, and the records since.

        A record never changes and its number is one more than the last one's, so a handle reads each only once: later ones are asked for by number.
        """
        if version is None and self._seen is not None:
            out = self._seen
            while self.files.exists(self._record(out.version + 1)):
                out = out.after(out.version + 1, json.loads(self.files.read(self._record(out.version + 1))))
            self._seen = out
            return out
        within = lambda n: version is None or n <= version
        kept = max((n for n in self._versions("_checkpoints") if within(n)), default=None)
        out = State() if kept is None else State.from_json(self.files.read(f"{self.path}/_checkpoints/{kept:08d}.json"))
        for n in self._versions("_commits"):
            if n > out.version and within(n):
                out = out.after(n, json.loads(self.files.read(self._record(n))))
        if version is None:
            self._seen = out
        return out

    def commit(self, base: State, **record) -> State:
        """Writes the record after ``base``; a conflict if another one was written since. Every so many records the state is kept as a checkpoint."""
        n = base.version + 1
        self.files.write_new(self._record(n), json.dumps(record))
        new = base.after(n, record)
        if n % CHECKPOINT_EVERY == CHECKPOINT_EVERY - 1:
            with contextlib.suppress(CommitConflict):
                self.files.write_new(f"{self.path}/_checkpoints/{n:08d}.json", new.to_json())
        return new

    def seal(self, kind: str, **cells) -> State:
        """Ends the log for whoever holds a handle to it: an append that has read an older state meets a conflict, a newer one is refused."""
        for _ in range(ATTEMPTS):
            base = self.state()
            if base.sealed is not None:
                if base.sealed["kind"] != kind:
                    raise LogSealed(f"{self.path} is sealed already: {base.sealed['kind']}")
                return base
            with contextlib.suppress(CommitConflict):
                return self.commit(base, seal={"kind": kind, **cells}, end=base.end)
        raise CommitConflict(f"{self.path}: other writers were faster {ATTEMPTS} times")

    def unseal(self) -> State:
        base = self.state()
        return base if base.sealed is None else self.commit(base, seal=None, end=base.end)

    # -- writing

    def append(self, df: DataFrame, *, order_by: list[str] | None = None, ts: int | None = None, batch: str | None = None, start: int | None = None, decide: Callable[[State, int, int], tuple[int, dict]] | None = None) -> tuple[int, int] | None:
        """Appends all rows in one commit, with consecutive offsets and one stamp, and returns [first, end).

        ``order_by`` sets the order of the offsets; without it rows keep the order of ``df``'s partitions.
        Rows are staged first, so offsets come from rows that no longer change. ``batch`` makes the append
        happen once, however often it is tried. One bad row refuses them all. ``decide(state, rows, first)`` says, of the
        state that is committed upon, how many leading rows are passed over and which publisher marks are set; if
        another writer commits meanwhile, it is asked again.
        """
        base = self.state()
        if batch is not None and batch in base.batches:
            return tuple(base.batches[batch])
        if base.sealed is not None:
            raise LogSealed(f"{self.path} is sealed: {base.sealed['kind']}")
        staged = self._stage(df, order_by)
        try:
            for _ in range(ATTEMPTS):
                base = self.state()
                if batch is not None and batch in base.batches:
                    return tuple(base.batches[batch])
                if base.sealed is not None:
                    raise LogSealed(f"{self.path} is sealed: {base.sealed['kind']}")
                first = max(base.end, start or 0)
                skip, marks = decide(base, staged.rows, first) if decide else (0, {})
                n = staged.rows - skip
                if not n:
                    return None
                stamp = now_us() if ts is None else ts
                folder, added = self._add(self._placed(staged, first, stamp, skip))
                if sum(f["rows"] for f in added) != n:
                    raise RowsRefused("staged rows were lost on the way")
                try:
                    self.commit(base, add=added, end=first + n, ts=stamp, marks=marks, batches={batch: [first, first + n]} if batch is not None else {})
                    return first, first + n
                except CommitConflict:
                    self.files.delete(folder)
            raise CommitConflict(f"{self.path}: other writers were faster {ATTEMPTS} times")
        finally:
            self.files.delete(staged.path)

    def append_rows(self, rows: list[tuple], *, ts: int | None = None, start: int | None = None, decide: Callable[[State, int, int], tuple[int, dict]] | None = None) -> tuple[int, int] | None:
        """Appends a few rows that the driver holds, in their order, in one commit and one Spark job; ``decide`` as for :meth:`append`.

        Their offsets are counted here, so nothing is staged; statistics and violations are observed as the rows are written.
        """
        if not rows:
            return None
        loose = T.StructType([T.StructField("_i", T.LongType()), *[T.StructField(f.name, f.dataType, True) for f in self.schema]])
        try:
            numbered = [(i, *r) for i, r in enumerate(rows)]
            table = as_arrow(numbered, loose)
            df = self.spark.createDataFrame(numbered if table is None else table, loose).coalesce(1)
        except Exception as e:
            raise RowsRefused(str(e)) from e
        wrong = [F.when(c, F.lit(what)) for what, c in violations(df, self.schema)]
        bad = F.struct("_i", F.coalesce(*wrong).alias("what")) if wrong else F.lit(None)
        for _ in range(ATTEMPTS):
            base = self.state()
            if base.sealed is not None:
                raise LogSealed(f"{self.path} is sealed: {base.sealed['kind']}")
            first, stamp = max(base.end, start or 0), now_us() if ts is None else ts
            skip, marks = decide(base, len(rows), first) if decide else (0, {})
            n = len(rows) - skip
            if not n:
                return None
            full = df.where(F.col("_i") >= skip).withColumn(OFFSET, F.col("_i") - skip + first).withColumn(TS, F.lit(stamp).cast("long"))
            watch = Observation()
            first_bad = F.min(F.when(F.coalesce(*wrong).isNotNull(), bad)) if wrong else F.max(F.lit(None).cast("string"))
            seen = full.observe(watch, *manifest.cells(self.schema), first_bad.alias("bad"))
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            seen.select(*self.stored.names).write.parquet(folder)
            got = watch.get
            if got["bad"] is not None:
                self.files.delete(folder)
                raise RowsRefused(f"row {got['bad']['_i']}: {got['bad']['what']}", got["bad"]["_i"])
            stats = manifest.named(got, self.schema)
            files = self.files.parquet(folder)
            if stats["rows"] != n or len(files) != 1:
                raise RowsRefused("rows were lost on the way")
            try:
                self.commit(base, add=[{"path": f"{folder}/{files[0].rsplit('/', 1)[1]}", "rows": stats["rows"], "first": stats["first"], "last": stats["last"], "stats": stats}], end=first + n, ts=stamp, marks=marks)
                return first, first + n
            except CommitConflict:
                self.files.delete(folder)
        raise CommitConflict(f"{self.path}: other writers were faster {ATTEMPTS} times")

    def append_stamped(self, df: DataFrame) -> tuple[int, int] | None:
        """Appends rows that carry their offsets and stamps already, as a table that is loaded from elsewhere; offsets stay."""
        base = self.state()
        if base.sealed is not None:
            raise LogSealed(f"{self.path} is sealed: {base.sealed['kind']}")
        folder, added = self._add(df.select(*self.stored.names))
        if not added:
            return None
        first, last = min(f["first"] for f in added), max(f["last"] for f in added)
        if first < base.end:
            self.files.delete(folder)
            raise CommitConflict(f"offset {first} is below the log's end {base.end}")
        self.commit(base, add=added, end=last + 1)
        return first, last + 1

    def _stage(self, df: DataFrame, order_by: list[str] | None) -> Staged:
        """The rows of ``df``, cast, checked and numbered within their partitions, as files that no longer change."""
        if any(c in df.columns for c in SYSTEM.names):
            raise RowsRefused("rows don't carry the log's own columns")
        rows = cast_to(df, self.schema)
        if order_by:
            rows = rows.orderBy(*order_by)
        broken = reduce(lambda a, b: F.coalesce(a, b), [F.col("_cast"), *[F.when(c, F.lit(what)) for what, c in violations(rows, self.schema)]])
        stage = f"{self.path}/_stage/{uuid.uuid4().hex}"
        placed = rows.withColumn("_bad", broken).drop("_cast").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)))
        placed.write.option("compression", "lz4").parquet(stage)
        staged = self.spark.read.schema(placed.schema).parquet(stage)
        # One row for each partition, however many rows there are.
        parts = sorted(staged.groupBy("_part").agg(F.count("*").alias("n"), F.min(F.when(F.col("_bad").isNotNull(), F.struct("_row", "_bad"))).alias("bad")).collect(), key=lambda r: r._part)
        before, total = {}, 0
        for r in parts:
            if r.bad is not None:
                self.files.delete(stage)
                raise RowsRefused(f"row {total + r.bad._row}: {r.bad._bad}", total + r.bad._row)
            before[r._part] = total
            total += r.n
        return Staged(stage, staged, before, total)

    def _placed(self, staged: Staged, first: int, stamp: int, skip: int) -> DataFrame:
        """The staged rows but the first ``skip``, with offsets from ``first`` on."""
        shift = self.spark.createDataFrame(list(staged.before.items()), "_part int, _before long")
        rows = staged.frame.join(F.broadcast(shift), "_part").withColumn("_n", F.col("_before") + F.col("_row"))
        if skip:
            rows = rows.where(F.col("_n") >= skip)
        full = rows.withColumn(OFFSET, F.col("_n") - skip + first).withColumn(TS, F.lit(stamp).cast("long")).select(*self.stored.names)
        return full.sortWithinPartitions(*self.sort_by) if self.sort_by else full

    def _add(self, df: DataFrame) -> tuple[str, list[dict]]:
        """Writes the rows; the folder, and an entry for each file that has any."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        found = manifest.file_statistics(self.spark.read.schema(self.stored).parquet(folder), self.schema)
        return folder, [{"path": f"{folder}/{name}", "rows": x["rows"], "first": x["first"], "last": x["last"], "stats": x} for name, x in sorted(found.items(), key=lambda e: e[1]["first"])]

    def compact(self) -> State:
        """All files as one run in offset order (or in ``sort_by`` order within files); offsets and rows stay the same."""
        base = self.state()
        if len(base.files) < 2:
            return base
        rows = self.read(base).repartitionByRange(OFFSET).sortWithinPartitions(*(self.sort_by or [OFFSET]))
        _, added = self._add(rows)
        if sum(f["rows"] for f in added) != base.rows:
            raise CommitConflict(f"compaction read {sum(f['rows'] for f in added)} rows of {base.rows}")
        return self.commit(base, add=added, remove=[f["path"] for f in base.files], end=base.end)

    def truncate(self, floor: int) -> State:
        """Drops whole files below ``floor`` and rewrites those that straddle it."""
        base = self.state()
        gone = [f["path"] for f in base.files if f["rows"] and f["last"] < floor]
        parted = [f["path"] for f in base.files if f["rows"] and f["first"] < floor <= f["last"]]
        added = []
        if parted:
            rows = self.spark.read.schema(self.stored).parquet(*parted).where(F.col(OFFSET) >= floor)
            _, added = self._add(rows.sortWithinPartitions(*self.sort_by) if self.sort_by else rows)
        return self.commit(base, add=added, remove=[*gone, *parted], end=base.end) if gone or parted else base

    def clean(self, grace_us: int = RETENTION_GRACE_US, now: int | None = None) -> list[str]:
        """Deletes the folders that no record names any more, or none ever did, once they are older than ``grace_us``: what compaction,
        truncation and writers that died have left. Readers have that long to finish. Returns what went."""
        named = {f["path"].rpartition("/")[0] for f in self.state().files}
        now = now_us() if now is None else now
        gone = []
        for part in ("data", "_stage"):
            for name in self.files.names(f"{self.path}/{part}"):
                folder = f"{self.path}/{part}/{name}"
                if folder not in named and now - self.files.modified_us(folder) >= grace_us:
                    self.files.delete(folder)
                    gone.append(folder)
        return gone

    # -- reading

    def read(self, state: State | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
        """The rows with offsets in [start, stop) as of ``state``; files outside the range aren't opened."""
        state = state or self.state()
        paths = [f["path"] for f in state.files if f["rows"] and (start is None or f["last"] >= start) and (stop is None or f["first"] < stop)]
        if not paths:
            return self.spark.createDataFrame([], self.stored)
        df = self.spark.read.schema(self.stored).parquet(*paths)
        if start is not None:
            df = df.where(F.col(OFFSET) >= start)
        return df.where(F.col(OFFSET) < stop) if stop is not None else df

    def rows_from(self, offset: int, state: State | None = None) -> int:
        """Rows from ``offset`` on: counted from the records, but for a file that the offset parts."""
        state = state or self.state()
        whole = sum(f["rows"] for f in state.files if f["rows"] and f["first"] >= offset)
        parted = [f["path"] for f in state.files if f["rows"] and f["first"] < offset <= f["last"]]
        return whole + (self.spark.read.schema(self.stored).parquet(*parted).where(F.col(OFFSET) >= offset).count() if parted else 0)

    def next_offset(self, start: int, stop: int | None = None, state: State | None = None) -> int | None:
        """The smallest offset in [start, stop) that a row has: steps over a fence."""
        return self.read(state, start, stop).agg(F.min(OFFSET)).first()[0]

    def extent(self, state: State | None = None) -> tuple[int | None, int, int]:
        """(first offset, end, rows) from the records alone."""
        state = state or self.state()
        return state.first, state.end, state.rows
