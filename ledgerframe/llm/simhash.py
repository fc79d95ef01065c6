"""SimHash near-dedup by anchor points of a covering code.

A text (A-Z in lower case) has words, runs of bytes other than white space, and shingles of four
consecutive words, repeats included (the whole sequence if it has fewer words). A bit of the 64-bit
fingerprint is 1 if it is set in over half the shingles' XXH64 values (seed 42); no words: zero.
Fingerprints link if they differ in at most ``THRESHOLD`` bits; a document's component is what links reach.

Only distinct fingerprints are compared, so groups of copies cost one entry. The 64 bits are cut into
three parts of 22, 21 and 21 bits. Two fingerprints that differ in at most four bits differ in at most
one bit in some part. In each part the anchors are the words of the product of the Hamming codes of
length 15 and 7, a covering code of 22 bits with radius 2: each fingerprint has a home anchor within 2,
and it is copied to all anchors within 2 + 1. So, of a linked pair, the second is among the copies at the
home of the first. Homes are compared with copies at each anchor; an anchor with very many fingerprints
deals its homes to several tasks. Each task passes on a spanning forest of its links, and alternating
large-star and small-star steps join the forests.

Defined results: null and empty texts have fingerprint zero and link like others; repeated rows are each
reported; a null id never names a component that has another.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, stored

SHINGLE, SEED, THRESHOLD = 4, 42, 4
PARTS = ((0, 22), (22, 21), (43, 21))
RADIUS, WITHIN = 2, 3
#: Comparisons that one task makes at one anchor; anchors beyond it are dealt to several tasks.
CELL = 500_000_000
STEP = 1 << 21
#: Links in one file of a checkpoint.
ROWS_PER_FILE = 200_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, width: int = SHINGLE) -> bytes:
    """Eight bytes, most significant first."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return bytes(8)
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_digest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    digest = xxhash.xxh64_digest
    h = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())])
    n, total = len(starts), np.zeros(64, np.int64)
    raw = np.frombuffer(h, np.uint8).reshape(n, 8)
    for i in range(0, n, 4096):
        total += np.unpackbits(raw[i : i + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n).tobytes()


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        raw = b"".join(map(fingerprint, texts.cast(pa.binary()).to_pylist()))
        return pa.array(np.frombuffer(raw, ">i8").astype(np.int64))

    return simhash(text)


def _cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the differences of weight at most WITHIN to all near code words, how many, and which is the smallest."""
    syndrome = [1 + i for i in range(15)] + [(1 + i) << 4 for i in range(7)]
    lists: list[list[tuple[int, int]]] = [[] for _ in range(128)]
    for weight in range(WITHIN + 1):
        for bits in combinations(range(22), weight):
            s = 0
            for b in bits:
                s ^= syndrome[b]
            lists[s].append((weight, sum(1 << b for b in bits)))
    most = max(map(len, lists))
    table = np.zeros((128, most), np.int64)
    for s, own in enumerate(lists):
        table[s, : len(own)] = [e for _, e in sorted(own)]  # the first is a coset leader, of weight RADIUS at most
    return table, np.array([len(x) for x in lists]), np.array(syndrome)


COSETS, NEAR, SYNDROME = _cosets()


def syndromes(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x), np.int64)
    for b in range(22):
        s ^= ((x >> b) & 1) * SYNDROME[b]
    return s


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, whether it is its home) of all copies."""
    index, anchor, home = [], [], []
    bits = fps.view(np.uint64)
    for p, (low, width) in enumerate(PARTS):
        part = ((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        s = syndromes(part)
        n = NEAR[s]
        i = np.repeat(np.arange(len(fps)), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        index.append(i)
        anchor.append(((part[i] ^ COSETS[s[i], j]) << 2) | p)
        home.append(j == 0)
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def hooked(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels after links a-b join; a label is the smallest index of its component."""
    while len(a):
        la, lb = labels[a], labels[b]
        low = np.minimum(la, lb)
        before = labels.copy()
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels = further
        if (labels == before).all():
            return labels
    return labels


def links(distinct: DataFrame, fp: str = "fp", threshold: int = THRESHOLD) -> DataFrame:
    """A spanning forest of the links among distinct fingerprints: rows (a, b), with no loop."""
    spark = distinct.sparkSession
    only = distinct.select(F.col(fp).cast("long").alias("fp"))
    if threshold > THRESHOLD:
        raise ValueError("the parts and the code cover at most four differing bits")

    def copies(batches):
        for batch in batches:
            fps = np.array(batch.column(0))
            for k in range(0, len(fps), 8192):
                own = fps[k : k + 8192]
                i, a, h = anchors(own)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(own[i]), pa.array(h)], ["anchor", "fp", "home"])

    copied = only.mapInArrow(copies, "anchor long, fp long, home boolean")
    # There are 3 * 2**15 anchors at most, whatever the input: these counts have a fixed bound.
    sizes = copied.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("h")).where(F.col("n") * F.col("h") > CELL).collect()
    dealt = spark.sparkContext.broadcast({r.anchor: -(-r.n * r.h // CELL) for r in sizes})

    def deal(batches):
        for batch in batches:
            a, f, h = (np.array(c) for c in batch.columns)
            salt = np.zeros(len(a), np.int64)
            more = [(a, salt, f, h)]
            for anchor in set(a.tolist()) & dealt.value.keys():
                own = np.flatnonzero(a == anchor)
                n = dealt.value[anchor]
                homes = ((f[own].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
                h = h.copy()
                h[own] &= homes == 0
                more[0] = (a, salt, f, h)
                for s in range(1, n):
                    more.append((a[own], np.full(len(own), s), f[own], np.array(batch.column(2))[own] & (homes == s)))
            for cells in more:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["anchor", "salt", "fp", "home"])

    def joined(f, h):
        """Component labels of the fingerprints at one anchor."""
        homes, labels = np.flatnonzero(h), np.arange(len(f))
        step = max(1, STEP // max(len(f), 1))
        for k in range(0, len(homes), step):
            own = homes[k : k + step]
            i, j = np.nonzero(np.bitwise_count(f[own][:, None] ^ f[None, :]) <= threshold)
            keep = own[i] != j
            labels = hooked(labels, own[i][keep], j[keep])
        return labels

    def compare(batches):
        def small(a, f, h, edges):
            """Many small groups at once: all pairs of a home and a copy, some million at a time."""
            sizes = np.diff(edges)
            group = np.repeat(np.arange(len(sizes)), sizes)
            homes = np.flatnonzero(h)
            width = sizes[group[homes]]
            done = np.cumsum(width)
            out = []
            begin = 0
            while begin < len(homes):
                end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + STEP, "right")))
                own, w = homes[begin:end], width[begin:end]
                i = np.repeat(own, w)
                j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(edges[group[own]], w)
                close = np.bitwise_count(f[i] ^ f[j]) <= threshold
                close &= i != j
                out.append(np.stack([i[close], j[close]]))
                begin = end
            return np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)

        def done(a, s, f, h):
            f = f.view(np.uint64)
            edges = np.concatenate([[0], np.flatnonzero((np.diff(a) != 0) | (np.diff(s) != 0)) + 1, [len(a)]])
            sizes = np.diff(edges)
            big = sizes > 2000
            for g in np.flatnonzero(big):
                lo, hi = edges[g], edges[g + 1]
                labels = joined(f[lo:hi], h[lo:hi])
                moved = np.flatnonzero(labels != np.arange(hi - lo))
                yield f[lo:hi][moved], f[lo:hi][labels[moved]]
            rest = np.repeat(~big, sizes)
            if rest.any():
                keep = np.flatnonzero(rest)
                i, j = small(a[keep], f[keep], h[keep], np.concatenate([[0], np.cumsum(sizes[~big])]))
                labels = hooked(np.arange(len(keep)), i, j)
                moved = np.flatnonzero(labels != np.arange(len(keep)))
                yield f[keep][moved], f[keep][labels[moved]]

        def out(cells):
            for x, y in done(*cells):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        held: list = []  # what came of the last group so far, joined once it is whole
        for batch in batches:
            cells = [np.array(c) for c in batch.columns]
            if not len(cells[0]):
                continue
            a, s = cells[0], cells[1]
            new = np.flatnonzero((np.diff(a) != 0) | (np.diff(s) != 0)) + 1
            if held and (held[-1][0][-1], held[-1][1][-1]) != (a[0], s[0]):
                yield from out([np.concatenate(x) for x in zip(*held)])
                held = []
            if len(new):
                held.append([c[: new[-1]] for c in cells])
                yield from out([np.concatenate(x) for x in zip(*held)])
                held = [[c[new[-1] :] for c in cells]]
            else:
                held.append(cells)
        if held:
            yield from out([np.concatenate(x) for x in zip(*held)])

    placed = copied.mapInArrow(deal, "anchor long, salt long, fp long, home boolean") if sizes else copied.select("anchor", F.lit(0).cast("long").alias("salt"), "fp", "home")
    met = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "anchor", "salt").sortWithinPartitions("anchor", "salt")
    return met.mapInArrow(compare, "a long, b long").distinct()


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than its rows need."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node that links reach. Alternating large and small stars."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state == before or not state.n:
            break
        before = state
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Grouped by one column more, so the join has an exchange on both sides, and that of a node with very many links can be split.
        least = both.groupBy("u", F.xxhash64("u").alias("h")).agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        # Stars have no more links than there were.
        now = cut(few_files(small, state.n))
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def rooted(distinct: DataFrame) -> DataFrame:
    """``distinct`` (fp, ...) with ``root``, the smallest fingerprint of its component."""
    roots = components(links(distinct))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def classes(prints: DataFrame) -> DataFrame:
    """Of rows (doc_id, fp): a row (fp, root, component_id) for each distinct fingerprint."""
    own = rooted(cut(packed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), prints)))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.select("fp", "root").join(least, "root")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, component_id, root (the component's smallest fingerprint)."""
    prints = stored(packed(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")), docs), "prints")
    return prints.join(classes(prints), "fp").select("doc_id", "fp", "component_id", "root")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, its fingerprint as 16 hex digits and component_id."""
    return find(docs, **options).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_each(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest id (null last); of rows with one id, that with the
    smallest fingerprint, then the smallest hash of its cells; of equal rows one.

    Rows are numbered and fingerprinted once, as they are stored; copies of a fingerprint are reduced to the row that
    would stay before anything is joined, and only numbers of rows decide.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    # The row travels as one cell, so its columns may have any names.
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(*names).alias("h"), fingerprint_column(F.col("text")).alias("fp"))
    rows = stored(packed(rows.withColumn("number", F.monotonically_increasing_id()), docs), "marked")
    best = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "fp", "h", "number")).alias("best")
    first = rooted(cut(packed(rows.groupBy("fp").agg(best), docs)))
    kept = first.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.number").alias("number"))
    return rows.select("row", "number").join(kept, "number", "left_semi").select("row.*")
