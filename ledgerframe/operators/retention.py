"""Ageing out: a floor, published first, then files deleted after a grace period.

The floor is the smallest offset whose stamp is newer than the cutoff, so a clock that stepped back never
drops a row that is still wanted.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..limits import OFFSET, RETENTION_GRACE_US, TS
from ..plans.metadata import Metadata


def floor_of(df: DataFrame, cutoff_us: int) -> int | None:
    """The smallest offset newer than the cutoff; None if no row is."""
    return df.where(F.col(TS) > cutoff_us).agg(F.min(OFFSET)).first()[0]


def floor(meta: Metadata, log_of, cutoff_us: int) -> int:
    """Over all logs in order; sealed logs that end before the cutoff aren't opened.

    If no row is newer, the floor is the end of the live log as it was before the rows were looked at.
    """
    live = log_of(meta.live)
    pinned = live.state()
    for entry in meta.logs:
        if entry.end is not None and entry.end_ts is not None and entry.end_ts <= cutoff_us:
            continue
        log = live if entry is meta.live else log_of(entry)
        got = floor_of(log.read(pinned if entry is meta.live else None, max(entry.start, meta.floor)), cutoff_us)
        if got is not None:
            return max(got, meta.floor)
    return max(pinned.end, meta.floor)


def begin(meta: Metadata, new_floor: int, now_us: int) -> Metadata:
    """Metadata that hides what is below the floor: wholly older sealed logs go, a straddled log's count is forgotten."""
    if new_floor <= meta.floor:
        return meta
    dropped = [e for e in meta.logs if e.end is not None and e.end <= new_floor]
    kept = tuple(e for e in meta.logs if e not in dropped)
    rows = tuple({**m, "rows": None} if any(e.name == m["log"] and e.start < new_floor for e in kept) else m for m in meta.manifest if m["log"] not in {e.name for e in dropped})
    pending = {"floor": new_floor, "since": now_us, "drop": [e.name for e in dropped] + (meta.pending or {}).get("drop", [])}
    extra = {**meta.extra, "dropped": meta.extra.get("dropped", 0) + len(dropped)}
    return replace(meta, logs=kept, manifest=rows, floor=new_floor, pending=pending, extra=extra)


def finish(meta: Metadata, log_of, delete, now_us: int, grace_us: int = RETENTION_GRACE_US) -> Metadata | None:
    """Deletes what ``begin`` hid, once readers that opened before it had the grace period; None if it is too early."""
    if not meta.pending or now_us - meta.pending["since"] < grace_us:
        return None
    for name in meta.pending["drop"]:
        delete(name)
    rows = []
    for entry in meta.logs:
        log = log_of(entry)
        state = log.truncate(meta.pending["floor"])
        own = next((m for m in meta.manifest if m["log"] == entry.name), None)
        if own is not None:
            rows.append({**own, "rows": state.rows} if own["rows"] is None else own)
    return replace(meta, manifest=tuple(rows), pending=None)
