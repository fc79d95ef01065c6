"""A stream's metadata: its logs in order, under immutable versions that a hint names."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..errors import CommitConflict, StreamMismatch, StreamNotFound
from ..limits import FIRST_OFFSET, KEEP_VERSIONS
from ..schema import from_struct, to_struct
from ..sources.files import Files


@dataclass(frozen=True)
class Entry:
    """One log of a stream; ``end`` and ``end_ts`` are null while it is live."""

    name: str
    schema: dict
    start: int = FIRST_OFFSET
    end: int | None = None
    start_ts: int | None = None
    end_ts: int | None = None
    sort_by: tuple[str, ...] = ()

    @property
    def struct(self) -> T.StructType:
        return to_struct(self.schema)


@dataclass(frozen=True)
class Metadata:
    stream: str
    stream_id: str
    logs: tuple[Entry, ...]
    manifest: tuple[dict, ...] = ()
    retention_us: int | None = None
    floor: int = FIRST_OFFSET
    pending: dict | None = None
    retired: bool = False
    version: int = 0
    extra: dict = field(default_factory=dict)

    @property
    def live(self) -> Entry:
        return self.logs[-1]

    def next_name(self) -> str:
        return f"{self.stream}-v{len(self.logs) + 1 + self.extra.get('dropped', 0)}"

    def with_live(self, **cells) -> Metadata:
        return replace(self, logs=(*self.logs[:-1], replace(self.live, **cells)))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Metadata:
        cells = json.loads(text)
        logs = tuple(Entry(**{**e, "sort_by": tuple(e["sort_by"])}) for e in cells.pop("logs"))
        return Metadata(**{**cells, "logs": logs, "manifest": tuple(cells["manifest"])})


class Versions:
    """Immutable ``NNNNN.metadata.json`` files, of which the newest counts.

    A file takes its name whole and never over another one, so the file itself is the claim: of two writers one wins,
    and a writer that dies leaves the next version or nothing. ``version-hint.text`` names the current one for
    people and other tools; nothing here depends on it.
    """

    def __init__(self, spark: SparkSession, root: str, stream: str):
        self.files, self.folder, self.stream = Files(spark), f"{root}/{stream}.metadata", stream

    def _names(self) -> list[str]:
        return [x for x in self.files.names(self.folder) if re.fullmatch(r"\d{5,}\.metadata\.json", x)]

    def exists(self) -> bool:
        return bool(self._names())

    def load(self, stream_id: str | None = None) -> Metadata:
        names = self._names()
        if not names:
            raise StreamNotFound(f"no stream {self.stream!r}")
        out = Metadata.from_json(self.files.read(f"{self.folder}/{max(names, key=lambda x: int(x.split('.')[0]))}"))
        if stream_id is not None and out.stream_id != stream_id:
            raise StreamMismatch(f"{self.stream} is stream {out.stream_id}, not {stream_id}")
        return out

    def commit(self, new: Metadata, expected: int | None) -> Metadata:
        """Writes ``new`` as the version after ``expected``; a conflict if there is one already."""
        have = self.load().version if self.exists() else None
        if have != expected:
            raise CommitConflict(f"{self.stream} is at version {have}, not {expected}")
        new = replace(new, version=(expected or 0) + 1)
        name = f"{new.version:05d}.metadata.json"
        self.files.write_new(f"{self.folder}/{name}", new.to_json())
        self.files.replace(f"{self.folder}/version-hint.text", name)
        for old in sorted(self._names(), key=lambda x: int(x.split(".")[0]))[:-KEEP_VERSIONS]:
            self.files.delete(f"{self.folder}/{old}")
        return new


def created(stream: str, struct: T.StructType, sort_by: list[str] | None = None) -> Metadata:
    return Metadata(stream, uuid.uuid4().hex, (Entry(f"{stream}-v1", from_struct(struct), sort_by=tuple(sort_by or ())),))
