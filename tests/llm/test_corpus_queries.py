"""The registered queries against their DuckDB SQL, and the pipeline against plain Python."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerframe.llm import bpe, licenses, queries, simhash, toxicity
from ledgerframe.llm.common import alnum_words

TABLES = "documents benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cells(rows, order):
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    out = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    want = cells(out.fetchall(), [names.index(c) for c in sorted(names)])
    got = cells([tuple(r) for r in df.collect()], [df.columns.index(c) for c in sorted(names)])
    assert got == want


def test_ten_operators_are_registered():
    own = entry.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in own) == 1 for n in range(1, 11)) and "pipeline" in own


# -- the pipeline by plain Python


def within(a, b, k):
    """Whether at most ``k`` edits part two strings."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[n:], b[n:]
    if not a or not b:
        return max(len(a), len(b)) <= k
    return k > 0 and (within(a[1:], b[1:], k - 1) or within(a[1:], b, k - 1) or within(a, b[1:], k - 1))


def place(doc_id):
    return (doc_id is None, doc_id or 0)


def without_repeated_lines(rows):
    first = {}
    for r in rows:
        for p, s in enumerate(r["text"].split("\n") if r["text"] is not None else []):
            first[s] = min(first.get(s, (*place(r["doc_id"]), p)), (*place(r["doc_id"]), p))
    by_length, gone = {}, set()
    for s in first:
        by_length.setdefault(len(s), []).append(s)
    for s, at in first.items():
        for n in range(len(s) - 2, len(s) + 3):
            edits = min(2, max(len(s), n) // 5)
            if abs(n - len(s)) <= edits and any(first[o] < at and o != s and within(o, s, edits) for o in by_length.get(n, [])):
                gone.add(s)
    out = []
    for r in rows:
        text = r["text"]
        if text:
            stay = [s for p, s in enumerate(text.split("\n")) if first[s] == (*place(r["doc_id"]), p) and s not in gone]
            if not stay:
                continue
            text = "\n".join(stay)
        out.append({**r, "text": text, "n_chars": r["n_chars"] if text is None else len(text)})
    return out


def one_of_each_group(rows):
    prints = [int.from_bytes(simhash.fingerprint(None if r["text"] is None else r["text"].encode()), "big") for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    kept = {}
    for i, r in enumerate(rows):
        key = (*place(r["doc_id"]), prints[i] - (1 << 64) if prints[i] >> 63 else prints[i])
        if find(i) not in kept or key < kept[find(i)][0]:
            kept[find(i)] = (key, r)
    return [r for _, r in kept.values()]


def without_leaks(rows, items):
    windows = {}
    for text in items:
        w = alnum_words(None if text is None else text.encode())
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(len(w[i : i + 10]), set()).add(tuple(w[i : i + 10]))
    out = []
    for r in rows:
        w = alnum_words(None if r["text"] is None else r["text"].encode())
        if not any(tuple(w[i : i + n]) in own for n, own in windows.items() for i in range(len(w) - n + 1)):
            out.append(r)
    return out


def encoded(rows):
    import public_tokenizers as P
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(queries.VOCABULARY)), special_tokens={})
    out = []
    for r in rows:
        ids = enc.encode_ordinary(r["text"] or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out.append((r["doc_id"], len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha((r["text"] or "").encode())))
    return sorted(out, key=repr)


def by_hand(spark, docs, sf_dir):
    rows = [r.asDict() for r in docs.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = model.scores([r["text"] for r in rows])
    rows = [r for r, s in zip(rows, scores) if s < 0.5]
    rows = without_repeated_lines(rows)
    rows = one_of_each_group(rows)
    return encoded(without_leaks(rows, [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=repr)
    assert got == by_hand(spark, docs, sf_dir) and 0 < len(got) < 200


def test_pipeline_on_hard_and_empty_rows(spark, sf_dir, hard, empty):
    """Nulls, empty and long texts, ties, repeats and clashing names through all stages; each keeps the columns."""
    import corpus_pipeline
    from ledgerframe.llm.common import stored

    for docs in (hard, empty):
        want = by_hand(spark, docs, sf_dir) if docs is hard else []
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stored(stage(spark, now, sf_dir), name)
            assert now.columns == docs.columns, name
        got = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()), key=repr)
        assert got == want


def test_license_base_columns_in_sql(spark, sf_dir, duck):
    """What the base phrases alone decide."""
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    got = cells([tuple(r) for r in queries.op9_licenses(spark, sf_dir).select(names).collect()], range(6))
    assert got == cells(duck.execute(licenses.BASE_SQL).fetchall(), range(6))
