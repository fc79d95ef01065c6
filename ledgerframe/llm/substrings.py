"""Substring dedup: Rabin-Karp hashes of every window of a fixed number of words.

Words are runs of bytes other than white space (space and U+0009 to U+000D), unchanged. A window is
removed from a document if its word sequence also starts in a document with a smaller id; removed
windows merge into maximal intervals of words.

Documents are packed into blocks of some hundred thousand words. A block holds each distinct window
hash once, with the smallest document that has it, and sends one packed run of hashes to each of a number of
hash buckets that goes by the size of the input; so a window that a third of all documents have is one entry for each block. A
bucket answers each run with one bit for each entry: whether a smaller document in another block has it.
The block's compressed texts travel beside the hashes and meet the answers in a second shuffle.

Two windows count as equal if their 64-bit hashes are equal: at n windows, about n * n / 2**65 of them
are taken for equal wrongly (below one for a billion windows).

Defined results: null and empty texts, and texts of fewer words than a window, lose nothing; rows with
the same id never remove one another's words; a null id counts as the largest there can be (2**63 - 1); a text of any
length stays whole, in one block; other columns aren't touched; an empty table gives an empty one. Ids are integers.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 50
BLOCK_WORDS = 1 << 19
#: Hashes go to 2**n buckets by their upper bits, n within these bounds: as many as make a bucket of some 4 MB of input. Entries
#: keep the lower 56 bits.
BUCKET_BITS, BUCKET_BYTES = (9, 14), 4 << 20
CHUNK = 1 << 18
#: An odd multiplier and its inverse, modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
NO_ID = (1 << 63) - 1
SCHEMA = "target int, block long, bucket int, payload binary, ids binary"


class WordHash(dict):
    """XXH64 of words, with a bound on what is remembered."""

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


class Powers:
    """BASE**i and BASE**-i modulo 2**64 for i below a growing bound."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n):
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            step = np.full(n, BASE, np.uint64)
            back = np.full(n, INVERSE, np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return self


def window_hashes(words: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """The polynomial hash of each window of ``width`` consecutive word hashes, finally mixed."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    p = powers.to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * p.up[:n], out=sums[1:])
    h = (sums[width:] - sums[:-width]) * p.down[: n - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(32)
    return h


def narrow(a: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest width that holds them; the first byte is the width."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(a.max(initial=0)) < 1 << (8 * w))
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def widen(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


class Block:
    """The windows of a run of documents sorted by id: each distinct hash at its first place."""

    def __init__(self, ids: np.ndarray, words: list[list[bytes]], width: int, bits: int, word_hash: WordHash, powers: Powers):
        self.ids, self.bits = ids, bits
        self.counts = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(self.counts) - self.counts
        flat = np.empty(int(self.counts.sum()), np.uint64)
        for s, w in zip(starts, words):
            flat[s : s + len(w)] = np.fromiter(map(word_hash.__getitem__, w), np.uint64, len(w))
        hashes = window_hashes(flat, width, powers)
        doc = np.repeat(np.arange(len(ids)), np.maximum(self.counts - width + 1, 0))
        #: Of each window, the place of its first word in the block.
        self.at = np.arange(len(doc)) + np.repeat(starts - (np.cumsum(np.maximum(self.counts - width + 1, 0)) - np.maximum(self.counts - width + 1, 0)), np.maximum(self.counts - width + 1, 0))
        self.doc, self.starts = doc, starts
        hashes = hashes[self.at]
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        group = np.cumsum(new) - 1
        self.group = np.empty(len(ranked), np.int64)
        self.group[order] = group
        first = order[new]  # in order of hashes
        self.hashes, self.first_doc = ranked[new], doc[first]
        # Entries within a bucket go by document, so that documents are runs.
        self.bucket = (self.hashes >> np.uint64(64 - bits)).astype(np.int64)
        self.sent = np.lexsort((self.first_doc, self.bucket))
        self.edges = np.searchsorted(self.bucket[self.sent], np.arange((1 << bits) + 1))

    def runs(self):
        """(bucket, packed hashes, packed documents) of each bucket that has entries."""
        for b in np.unique(self.bucket).tolist():
            own = self.sent[self.edges[b] : self.edges[b + 1]]
            if len(own):
                low = self.hashes[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
                docs, counts = np.unique(self.first_doc[own], return_counts=True)
                ids = self.ids[docs]
                # Ids ascend; differences of extreme ids would not fit, so those stay as they are.
                steps = np.diff(ids) if int(ids[-1]) - int(ids[0]) < 1 << 62 else None
                head = b"\0" + ids.astype("<i8").tobytes() if steps is None else b"\1" + ids[:1].astype("<i8").tobytes() + narrow(steps)
                c = narrow(counts)
                yield b, np.ascontiguousarray(low).tobytes(), len(c).to_bytes(4, "little") + c + head

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each word of the block, whether it goes."""
        elsewhere = np.zeros(len(self.hashes), bool)
        for b, bits in answers.items():
            own = self.sent[self.edges[b] : self.edges[b + 1]]
            elsewhere[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        gone = elsewhere[self.group] | (self.ids[self.first_doc[self.group]] < self.ids[self.doc])
        return gone


def unpack_ids(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    counts, head = widen(b[4 : 4 + n]), b[4 + n :]
    if head[0]:
        base = int(np.frombuffer(head[1:9], "<i8")[0])
        ids = base + np.concatenate([[0], np.cumsum(widen(head[9:]))]).astype(np.int64)
    else:
        ids = np.frombuffer(head, "<i8", offset=1)
    return np.repeat(ids, counts)


def bucket_bits(docs: DataFrame) -> int:
    """From the size of the input as the plan has it; the result is the same for any number of buckets."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max((size // BUCKET_BYTES).bit_length(), BUCKET_BITS[0]), BUCKET_BITS[1])


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, block_words: int = BLOCK_WORDS, bits: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, the removed intervals of words and the text that is kept.

    ``removed`` holds [first, past) of words, ascending, apart from one another; ``kept`` joins the words
    that stay by one space.
    """
    names = ["target", "block", "bucket", "payload", "ids"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    bits = bits or bucket_bits(docs)
    if not 8 <= bits <= 24:
        raise ValueError("entries keep 56 bits of a hash, so buckets take 8 at least")

    def rows(cells):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), types)], names)

    def pack(batches):
        word_hash, powers, press = WordHash(), Powers(), zstandard.ZstdCompressor(3)
        base, blocks = TaskContext.get().partitionId() << 32, 0
        ids, none, texts, words, total = [], [], [], [], 0

        def flush():
            key = base + blocks
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            own = [texts[i] for i in order]
            block = Block(np.array(ids, np.int64)[order], [words[i] for i in order], width, bits, word_hash, powers)
            unnamed = [none[i] for i in order]
            out, size, begun, part = [], 0, 0, 0
            for i, t in enumerate(own):
                size += len(t or b"") + 16
                if size >= CHUNK or i + 1 == len(own):
                    lengths = np.array([2 * (len(x) + 1 if x is not None else 0) + u for x, u in zip(own[begun : i + 1], unnamed[begun : i + 1])], "<u8")
                    blob = len(lengths).to_bytes(8, "little") + block.ids[begun : i + 1].astype("<i8").tobytes() + lengths.tobytes() + b"".join(x or b"" for x in own[begun : i + 1])
                    out.append(((1 << bits) + int((key * 31 + part) % 4093), key, -1 - part, press.compress(blob), None))
                    size, begun, part = 0, i + 1, part + 1
            yield rows(out)
            out = []
            for b, low, own_ids in block.runs():
                out.append((b, key, b, low, own_ids))
                if len(out) >= 256:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids.append(NO_ID if doc is None else doc)
                none.append(doc is None)
                texts.append(text)
                words.append((text or b"").split())
                total += len(words[-1]) + 1
                if total >= block_words:
                    yield from flush()
                    blocks += 1
                    ids, none, texts, words, total = [], [], [], [], 0
        if ids:
            yield from flush()

    def count(group):
        """One bucket: for each run, a bit for each entry that a smaller document of another block has."""
        if group.column("bucket")[0].as_py() < 0:
            return group.select(names)
        # One run for each block; hashes are distinct within it.
        lows = [np.frombuffer(x, np.uint8).reshape(-1, 7) for x in group.column("payload").to_pylist()]
        sizes = [len(x) for x in lows]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        np.concatenate(lows, out=wide[:, :7])
        hashes = wide.view("<u8").ravel()
        ids = np.concatenate([unpack_ids(x) for x in group.column("ids").to_pylist()])
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
        more = np.empty(len(ids), bool)
        more[order] = least[np.cumsum(new) - 1] < ids[order]
        out, done = [], 0
        for block, bucket, n in zip(group.column("block").to_pylist(), group.column("bucket").to_pylist(), sizes):
            own = more[done : done + n]
            done += n
            if own.any():
                out.append((0, block, bucket, np.packbits(own).tobytes(), None))
        return pa.Table.from_batches([rows(out)]) if out else group.slice(0, 0).select(names)

    def apply(group):
        """One block: its documents with what goes."""
        ids, none, texts, answers = [], [], [], {}
        unpress = zstandard.ZstdDecompressor()
        cells = sorted(zip(group.column("bucket").to_pylist(), group.column("payload").to_pylist()), key=lambda x: -x[0])
        for bucket, payload in cells:
            if bucket >= 0:
                answers[bucket] = payload
                continue
            blob = unpress.decompress(payload)
            n = int.from_bytes(blob[:8], "little")
            ids.append(np.frombuffer(blob, "<i8", n, 8))
            at = 8 + 16 * n
            for length in np.frombuffer(blob, "<u8", n, 8 + 8 * n).tolist():
                none.append(bool(length & 1))
                length >>= 1
                texts.append(blob[at : at + length - 1] if length else None)
                at += max(length - 1, 0)
        ids = np.concatenate(ids)
        words = [(t or b"").split() for t in texts]
        block = Block(ids, words, width, bits, WordHash(), Powers())
        gone = block.removed(answers)
        step = np.zeros(int(block.counts.sum()) + 1, np.int64)
        np.add.at(step, block.at[gone], 1)
        np.add.at(step, block.at[gone] + width, -1)
        bad = np.cumsum(step) > 0
        out = []
        for doc, unnamed, start, own in zip(ids.tolist(), none, block.starts.tolist(), words):
            off = bad[start : start + len(own)]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], off.view(np.int8), [0]])))
            spans = [{"first": int(a), "past": int(b)} for a, b in edges.reshape(-1, 2)]
            kept = b" ".join([w for w, x in zip(own, off.tolist()) if not x] if spans else own)
            out.append((None if unnamed else doc, len(own), spans, kept))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())])), pa.binary()]
        arrays = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
        return pa.Table.from_arrays([*arrays[:3], arrays[3].cast(pa.string())], ["doc_id", "n_words", "removed", "kept"])

    packed = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(pack, SCHEMA)
    answered = packed.groupBy("target").applyInArrow(count, SCHEMA)
    return answered.groupBy("block").applyInArrow(apply, "doc_id long, n_words long, removed array<struct<first:long,past:long>>, kept string")


def report(docs: DataFrame, **options) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s.past - s["first"])
    return find(docs, **options).select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM x) WHERE m < doc_id),
g AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM f) GROUP BY doc_id),
u AS (SELECT doc_id, i, w[i] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT u.doc_id, string_agg(t, ' ' ORDER BY i) AS s FROM u LEFT JOIN (SELECT doc_id, unnest(p) AS i, 1 AS gone FROM g) USING (doc_id, i) WHERE gone IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g.p), 0) AS BIGINT) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
