"""Byte-level BPE encoding and decoding with a two-tier lookup.

The pattern splits a text into pre-tokens. A minimal perfect hash (hash and displace: one slot for each
vocabulary entry, none empty) resolves those that are vocabulary entries as a whole. The others are merged
by a heap of (rank, place) over a linked list of their byte parts, which takes n log n steps for a
pre-token of n bytes. Within a worker process, each distinct pre-token is resolved once, with a bound on what is kept.

Defined results: a null text is encoded as an empty one, which has no ids; decoding gives back the text's UTF-8 bytes;
repeated rows are each encoded, null ids and ids of any type come back as they are, an empty table gives an empty one, a text of any length is
encoded whole, and columns other than the id and the text aren't touched. The vocabulary file's path is a parameter; the driver
reads it and sends it to the executors.
"""

from __future__ import annotations

import base64
import uuid
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f.read().splitlines())}


class PerfectHash:
    """A minimal perfect hash over the vocabulary: ``rank(tokens)`` gives each token's rank, or -1."""

    def __init__(self, ranks: dict[bytes, int], load: int = 3):
        n = self.n = len(ranks)
        self.m = n // load + 1
        keys = list(ranks)
        h = self._hash(keys)
        bucket = self._bucket(h)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.m + 1))
        self.shift = np.zeros(self.m, np.int64)
        slot_of, used = np.full(n, -1, np.int64), np.zeros(n, bool)
        sizes = np.diff(edges)
        singles = []
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = order[edges[b] : edges[b + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:
                singles.append((b, int(own[0])))
                continue
            base = 0
            while True:
                tries = self._slot(h[own], np.arange(base, base + 64)[:, None])
                good = ~used[tries].any(axis=1)
                ranked = np.sort(tries, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if good.any():
                    d = int(np.argmax(good))
                    self.shift[b] = base + d
                    slot_of[own] = tries[d]
                    used[tries[d]] = True
                    break
                base += 64
                if base > 1 << 22:
                    raise ValueError("two vocabulary entries have one hash")
        # A bucket of one entry takes any free slot; a negative shift names it.
        for (b, k), slot in zip(singles, np.flatnonzero(~used).tolist()):
            self.shift[b] = -1 - slot
            slot_of[k] = slot
        self.keys = [b""] * n
        self.ranks = np.empty(n, np.int64)
        for k, slot in enumerate(slot_of.tolist()):
            self.keys[slot] = keys[k]
            self.ranks[slot] = ranks[keys[k]]

    @staticmethod
    def _hash(tokens):
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, tokens)), "<u8").reshape(-1, 2)

    def _bucket(self, h):
        return (h[:, 0] % np.uint64(self.m)).astype(np.int64)

    def _slot(self, h, shift):
        x = h[:, 1] + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(self.n)).astype(np.int64)

    def rank(self, tokens: list[bytes]) -> list[int]:
        if not tokens or not self.n:
            return [-1] * len(tokens)
        h = self._hash(tokens)
        d = self.shift[self._bucket(h)]
        slot = np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0)))
        keys = self.keys
        return [r if keys[s] == t else -1 for t, s, r in zip(tokens, slot.tolist(), self.ranks[slot].tolist())]


class Merges:
    """Merges of neighbouring parts by rank, with parts as ranks and pairs of them as one integer."""

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        self.byte = [get(bytes([i])) for i in range(256)]
        self.pair = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None:
                    self.pair[a << 32 | b] = rank

    def merge(self, token: bytes) -> list[int]:
        """The ranks of the parts of ``token`` after all merges, lowest rank first, leftmost first."""
        pair = self.pair.get
        part = [self.byte[x] for x in token]
        n = len(part)
        # Of each part: the rank of its pair with the next one, if any; what else the heap says of it is stale.
        now = [pair(a << 32 | b) for a, b in zip(part, part[1:])]
        heap = [r << 32 | i for i, r in enumerate(now) if r is not None]
        if not heap:
            return part
        heapify(heap)
        now.append(None)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            item = heappop(heap)
            i = item & 0xFFFFFFFF
            rank = item >> 32
            if now[i] != rank:
                continue
            j = after[i]
            part[i] = rank
            part[j] = now[j] = now[i] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pair(rank << 32 | part[k])) is not None:
                    now[i] = r
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                now[h] = r = pair(part[h] << 32 | rank)
                if r is not None:
                    heappush(heap, r << 32 | h)
        return [x for x in part if x is not None]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash):
        self.merge, self.table, self.memo = Merges(ranks).merge, table, {}
        self.split = regex.compile(pattern).findall

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; so are those that are kept for a pre-token."""
        memo, out = self.memo, []
        for text in texts:
            if len(memo) > MEMO:
                memo.clear()
            pieces = self.split(text) if text else []
            new = [x for x in set(pieces) if x not in memo]
            if new:
                raw = [x.encode() for x in new]
                for piece, token, r in zip(new, raw, self.table.rank(raw)):
                    ids = (r,) if r >= 0 else self.merge(token)
                    memo[piece] = pack(f"<{len(ids)}I", *ids)
            out.append(b"".join(map(memo.__getitem__, pieces)))
        return out


_kept: dict[str, tuple] = {}


def kept(key: str, make) -> tuple:
    """What this process has made for that key; only the last one is kept."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.token = {r: t for t, r in ranks.items()}.__getitem__

    def decode(self, ids: list[bytes | None]) -> list[bytes]:
        return [b"".join(map(self.token, np.frombuffer(x or b"", "<u4").tolist())) for x in ids]


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens and ids (little-endian unsigned 32-bit integers).

    With ``decoded``, also the bytes that the ids stand for, decoded from them in the same process.
    """
    ranks = read_ranks(path)
    # As large as the vocabulary file. A worker process reads it and builds its tables once, whatever tasks it runs.
    sent = docs.sparkSession.sparkContext.broadcast((ranks, PerfectHash(ranks)))
    kind, key = docs.schema[id_col].dataType.simpleString(), uuid.uuid4().hex

    def run(batches):
        encoder, decoder = kept(key, lambda: (Encoder(sent.value[0], pattern, sent.value[1]), Decoder(sent.value[0])))
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = encoder.encode(part.column(1).to_pylist())
                cells = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    cells.append(pa.array(decoder.decode(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(cells, ["doc_id", "n_tokens", "ids", "decoded"][: len(cells)])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the bytes that its ids stand for, in column ``decoded``."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    fields = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        decoder = Decoder(sent.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoder.decode(part.column("ids").to_pylist()), pa.binary())], [*fields, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(fields).schema)
    return encoded.select(fields).mapInArrow(run, schema + ", decoded binary")


def report(docs: DataFrame, path: str, pattern: str, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, and digests of its ids and of the bytes that they decode to."""
    return encode(docs, path, pattern, decoded=True, **options).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
