"""Benchmark decontamination by a distributed positional inverted index.

Training documents are cut into blocks of some hundred thousand tokens. Each block is one row of the
index: for every term of the test vocabulary, the ascending positions at which it occurs in the block
(a term that no test item has can take part in no intersection, so its postings aren't stored). The
index is document-partitioned, so a search needs no shuffle: each block intersects the lists of a
window, shifted by each term's offset in the window, from the rarest term on.

Defined results: null and empty texts have no words and no hits; an item without words is never found; an item
without an id is found, but not named or counted; items with the same words are all reported; repeated rows are
each reported; documents of any length stay in one block; columns of the input other than the id and the text
aren't touched.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, packed, sha_hex, stored

WINDOW = 10
BLOCK_WORDS = 1 << 19
#: Bytes of test text that are searched for at once; more are searched for in several passes.
QUERY_BYTES = 32 << 20


def item_windows(items: list[tuple[str | None, bytes | None]], width: int) -> dict[tuple[bytes, ...], list[str]]:
    """Each distinct window of the items with the ids of the items that have it; an item without an id adds its windows, but no name."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = alnum_words(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            own = found.setdefault(tuple(words[i : i + width]), set())
            if item is not None:
                own.add(item)
    return {k: sorted(v) for k, v in found.items()}


def index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The index of ``docs``: a row for each block, with its documents and, by term number, its postings."""
    kind = docs.schema[id_col].dataType.simpleString()
    number = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})
    schema = f"block long, doc_ids array<{kind}>, starts array<long>, terms binary, counts binary, postings binary"

    def build(batches):
        get = number.value.get
        base, blocks = TaskContext.get().partitionId() << 32, 0
        ids, starts, parts, total = [], [0], [], 0

        def row(id_type):
            at = np.concatenate(parts) if parts else np.empty(0, np.int32)
            where = np.flatnonzero(at >= 0)
            order = np.argsort(at[where], kind="stable")
            terms, counts = np.unique(at[where], return_counts=True)
            cells = [base + blocks, ids, starts, terms.astype("<i4").tobytes(), counts.astype("<u4").tobytes(), where[order].astype("<u4").tobytes()]
            kinds = [pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], ["block", "doc_ids", "starts", "terms", "counts", "postings"])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = alnum_words(text)
                parts.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
                ids.append(doc)
                total += len(words)
                starts.append(total)
                if total >= block_words:
                    yield row(id_type)
                    blocks += 1
                    ids, starts, parts, total = [], [0], [], 0
        if ids:
            yield row(id_type)

    return docs.select(id_col, text_col).mapInArrow(build, schema)


def search(indexed: DataFrame, vocabulary: list[bytes], windows: dict[tuple[bytes, ...], list[str]], slop: int = 0) -> DataFrame:
    """A row for each document of the index: its number of words, the word spans that windows cover, the items found.

    With ``slop`` 0 a window is found where its words stand consecutively. Otherwise also where, from
    some occurrence of its rarest word in the document, every other word stands within ``slop`` places of
    its place in the window: such items are in ``near_items``, and ``spans`` holds exact matches only.
    """
    spark = indexed.sparkSession
    number = {w: i for i, w in enumerate(vocabulary)}
    by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
    for words, items in windows.items():
        by_length.setdefault(len(words), ([], []))
        by_length[len(words)][0].append([number[w] for w in words])
        by_length[len(words)][1].append(items)
    queries = spark.sparkContext.broadcast([(k, np.array(rows, np.int32), items) for k, (rows, items) in by_length.items()])
    n_terms = len(vocabulary)
    kind = dict(indexed.dtypes)["doc_ids"][6:-1]
    schema = f"block long, ordinal int, doc_id {kind}, n_words long, spans array<struct<first:int,past:int>>, items array<string>, near_items array<string>"
    arrow = {"spans": pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))}

    def within(shifted, lists, width):
        """Of ascending places ``shifted``, those with an entry of ``lists`` at most ``width`` away."""
        at = np.searchsorted(lists, shifted - width)
        return (at < len(lists)) & (lists[np.minimum(at, len(lists) - 1)] <= shifted + width)

    def probe(cells):
        """Of one block: (start, length, items) of exact matches and (anchor, items) of near ones."""
        terms, counts = np.frombuffer(cells["terms"], "<i4"), np.frombuffer(cells["counts"], "<u4").astype(np.int64)
        places = np.frombuffer(cells["postings"], "<u4").astype(np.int64)
        lengths, first = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        lengths[terms], first[terms] = counts, np.cumsum(counts) - counts
        starts = np.array(cells["starts"], np.int64)
        exact, near = [], []
        for k, rows, items in queries.value:
            held = lengths[rows]
            for w in np.flatnonzero(held.min(axis=1) > 0):
                row, order = rows[w], np.argsort(held[w], kind="stable")
                rarest = order[0]
                lists = [places[first[t] : first[t] + lengths[t]] for t in row]
                begin = lists[rarest] - rarest
                for i in order[1:]:
                    if not len(begin):
                        break
                    begin = begin[within(begin + i, lists[i], 0)]
                if len(begin):
                    doc = np.searchsorted(starts, begin, "right") - 1
                    begin = begin[(begin >= 0) & (begin + k <= starts[np.minimum(doc + 1, len(starts) - 1)])]
                    exact += [(int(b), k, items[w]) for b in begin]
                if slop:
                    anchor = lists[rarest]
                    doc = np.searchsorted(starts, anchor, "right") - 1
                    low, high = starts[doc], starts[doc + 1] - 1
                    ok = np.ones(len(anchor), bool)
                    for i in order[1:]:
                        want = anchor + (i - rarest)
                        lo, hi = np.maximum(want - slop, low), np.minimum(want + slop, high)
                        at = np.searchsorted(lists[i], lo)
                        ok &= (at < len(lists[i])) & (lists[i][np.minimum(at, len(lists[i]) - 1)] <= hi)
                    near += [(int(a), items[w]) for a in anchor[ok]]
        return starts, exact, near

    def run(batches):
        for batch in batches:
            id_type = batch.schema.field("doc_ids").type.value_type
            for cells in batch.to_pylist():
                starts, exact, near = probe(cells)
                n = len(cells["doc_ids"])
                spans, items, nears = [[] for _ in range(n)], [set() for _ in range(n)], [set() for _ in range(n)]
                for b, k, found in sorted(exact, key=lambda x: x[:2]):
                    d = int(np.searchsorted(starts, b, "right")) - 1
                    lo = b - int(starts[d])
                    if spans[d] and lo <= spans[d][-1]["past"]:
                        spans[d][-1]["past"] = max(spans[d][-1]["past"], lo + k)
                    else:
                        spans[d].append({"first": lo, "past": lo + k})
                    items[d].update(found)
                for a, found in near:
                    nears[int(np.searchsorted(starts, a, "right")) - 1].update(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([cells["block"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(cells["doc_ids"], id_type), pa.array(np.diff(starts)),
                        pa.array(spans, arrow["spans"]), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array([sorted(x) for x in nears], pa.list_(pa.string())),
                    ],
                    ["block", "ordinal", "doc_id", "n_words", "spans", "items", "near_items"],
                )

    return indexed.mapInArrow(run, schema)


def find(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", width=WINDOW, slop=0, block_words=BLOCK_WORDS, query_bytes=QUERY_BYTES) -> DataFrame:
    """What :func:`search` returns, for all of ``docs`` and all of ``items``.

    Test items are gathered in passes of at most about ``query_bytes`` of text, whose sum is taken first; the index
    is built and stored once for each pass, with the terms of that pass. If there are several, rows are
    numbered and stored before, and what passes find is put together by those numbers.
    """
    rows = items.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    passes = -(-int(size) // query_bytes) or 1
    if passes > 1:
        numbered = F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"))
        docs, id_col, text_col = stored(docs.select(numbered.alias("key"), F.col(text_col).alias("text")), "numbered"), "key", "text"
    found = None
    for p in range(passes):
        own = rows if passes == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == p)
        windows = item_windows([(r.i, r.t.encode() if r.t else None) for r in own.collect()], width)
        vocabulary = sorted({w for k in windows for w in k})
        indexed = stored(packed(index(docs, vocabulary, id_col, text_col, block_words), docs), "postings")
        one = search(indexed, vocabulary, windows, slop).drop("block", "ordinal")
        found = one if found is None else found.unionByName(one)
    if passes == 1:
        return found
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    both = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), together("items"), together("near_items"))
    return both.select(F.col("doc_id.id").alias("doc_id"), "n_words", "spans", "items", "near_items")


def covered(spans):
    """Words that spans, ascending by their first word, cover; spans may overlap."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("past"))

    def add(acc, s):
        return F.struct((acc.n + F.greatest(F.lit(0), s.past - F.greatest(s["first"], acc.past))).alias("n"), F.greatest(acc.past, s.past).alias("past"))

    return F.aggregate(spans, zero, add, lambda acc: acc.n).cast("long")


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The digest of :func:`find`: one row for each document."""
    return find(docs, items, **options).select(
        "doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        sha_hex(F.array_join("items", ",").cast("binary")).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose texts no window of ``items`` occurs in."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    hit = find(docs.withColumn("doc_key", F.struct("doc_id", key.alias("k"))), items, id_col="doc_key", **options)
    bad = hit.where(F.size("spans") > 0).select(F.col("doc_id.doc_id").alias("bad_id"), F.col("doc_id.k").alias("bad_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (key == bad["bad_key"]), "left_anti")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
m AS (SELECT r, i, dw.k, item_id FROM dw JOIN bw USING (k, s)),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
