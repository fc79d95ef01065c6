"""Each operator against brute force, on rows with nulls, empties, long texts, repeats and clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerframe.llm import bpe, chat, decontaminate, licenses, lines, merkle, quality, simhash, substrings, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def ordered(got):
    return sorted(map(tuple, got), key=repr)


def source(hard):
    return [(r.doc_id, r.text) for r in hard.collect()]


# -- 1


def brute_leaks(docs, items, width=10):
    windows = set()
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        windows |= {(None if item is None else str(item), tuple(w[i : i + width])) for i in range(max(1, len(w) - width + 1))} if w else set()
    out = []
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for item, k in windows:
            for i in range(len(w) - len(k) + 1):
                if tuple(w[i : i + len(k)]) == k:
                    hit |= set(range(i, i + len(k)))
                    found |= {item} - {None}
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return ordered(out)


ITEMS = "item_id long, text string"


def items_of(spark, hard):
    texts = [t for _, t in source(hard) if t and len(t) < 2000]
    passage = max(texts, key=lambda t: len(t) if "\n" not in t else 0)
    own = [(10, passage[:200]), (9, passage[40:260]), (8, "one"), (7, None), (6, ""), (5, passage[:200]), (4, "words that no text has at all"), (None, "naïve 12"), (None, passage[:200]), (None, passage[100:300])]
    return own, spark.createDataFrame(own, ITEMS)


def test_decontaminate(spark, hard):
    own, items = items_of(spark, hard)
    small = [(d, t) for d, t in source(hard) if len(t or "") < 5000]
    docs = hard.where("text IS NULL OR length(text) < 5000")
    want = brute_leaks(small, own)
    assert any(r[5] for r in want) and any(r[5] and not r[3] for r in want)
    for options in ({}, {"block_words": 7}, {"query_bytes": 300}):
        assert rows(decontaminate.report(docs, items, **options)) == want
    nameless = [(None, passage) for _, passage in own[:2]]
    assert rows(decontaminate.report(docs, spark.createDataFrame(nameless, ITEMS))) == brute_leaks(small, nameless)
    assert decontaminate.report(hard, items).count() == hard.count()


def test_decontaminate_clean_keeps_rows_and_columns(spark, hard):
    own, items = items_of(spark, hard)
    bad = {(r[0]) for r in brute_leaks([(d, t) for d, t in source(hard) if len(t or "") < 5000], own) if r[5]}
    got = decontaminate.clean(hard, items)
    assert got.columns == hard.columns
    left = {r.doc_id for r in got.collect()}
    assert not left & (bad - {None}) and left >= {d for d, t in source(hard) if d not in bad and len(t or "") < 5000}


def test_decontaminate_proximity(spark):
    docs = spark.createDataFrame([(1, "zz alpha beta gamma delta zz"), (2, "alpha x beta gamma delta"), (3, "delta gamma beta alpha far away"), (4, "alpha beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], ITEMS)
    got = {r.doc_id: (len(r["items"]), len(r.near_items)) for r in decontaminate.find(docs, items, slop=1).collect()}
    assert got == {1: (1, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0)}


def test_decontaminate_empty_tables(spark, hard, empty):
    _, items = items_of(spark, hard)
    assert decontaminate.report(empty, items).count() == 0
    assert decontaminate.report(hard, items.limit(0)).where("contaminated").count() == 0


# -- 2


def test_quality_learns_ordered_grades(spark):
    rng = np.random.default_rng(0)
    cells, marks = [], []
    for i in range(600):
        g = int(rng.integers(0, 4))
        bad = rng.random(40) < (3 - g) / 4
        cells.append((i, " ".join(("BAD!!" if b else "fine") for b in bad)))
        marks.append((i, g, 0))
    docs, labels = spark.createDataFrame(cells, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    held = [(m[1], got[m[0]]) for m in marks if got[m[0]].held_out]
    assert np.corrcoef([a for a, _ in held], [r.expected_grade for _, r in held])[0, 1] > 0.8
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 3 for _, r in held)


def brute_grades(model, text, bits=16):
    """(expected grade, tail probability) of a text, feature by feature."""
    raw = (text or "").encode()
    words, slots = raw.split(), Counter()
    for w in words:
        core = w.strip(b".,;:!?*#$%&|()[]{}\"'-_/")
        sign = w[w.find(core) + len(core) :][-3:] if core else w[:3]
        case = b"U" if len(core) > 1 and core.isupper() else b"T" if core[:1].isupper() else b"d" if core.isdigit() else b"l"
        slots["w", xxhash.xxh64_intdigest(b"w" + core.lower(), 1) % (1 << bits)] += 1
        slots["s", xxhash.xxh64_intdigest(b"s" + case + sign, 1) % (1 << bits)] += 1
    n, z = len(words), 0.0
    for (kind, slot), count in slots.items():
        z += float(model.weights[slot]) * ((count / n) ** 0.5 * 0.5 if kind == "w" else 3 * count / n)
    if n:
        split = raw.split(b"\n")
        extra = (len(set(words)) / n**0.75, 1 - len(set(split)) / len(split), n / (n + 100))
        z += sum(2 * x * float(model.weights[(1 << bits) + i]) for i, x in enumerate(extra))
    above = [1 / (1 + np.exp(-(z - t))) for t in model.thresholds]
    return model.grades[0] + sum(p * (b - a) for p, a, b in zip(above, model.grades, model.grades[1:])), above[-1] if above else 0.0


def test_quality_scores(spark, hard):
    """Every score from the weights, by plain Python; three grades, one document with two ratings, ties, extra columns."""
    labels = spark.createDataFrame([(i, i % 3, 0) for i in range(30)] + [(3, None, None), (4, 2, 0), (999, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(hard, labels)
    got = hard.select("doc_id", "text", quality.score_columns(model, F.col("text")).alias("s")).collect()
    for r in got:
        assert np.allclose((r.s.expected, r.s.tail), brute_grades(model, r.text), atol=1e-4), r.doc_id
    report = {(r.doc_id, round(r.expected_grade, 6), round(r.tail_probability, 6)) for r in quality.report(hard, labels).collect()}
    assert report == {(r.doc_id, round(r.s.expected, 6), round(r.s.tail, 6)) for r in got}
    assert list(model.grades) == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()


def test_quality_fit_lowers_the_loss():
    """The likelihood that the fit climbs is that of the cumulative model: weights of nothing do worse than fitted ones, and no small step does better by much."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(300):
        y = int(rng.integers(0, 3))
        slots = np.unique(rng.integers(0, 8, 4) + 8 * int(rng.random() < (y + 0.5) / 3)).astype(np.int32)
        rows.append((slots, np.ones(len(slots), np.float32), float(y)))
    model = quality.fit_rows(rows)

    def loss(weights, thresholds):
        out = 0.0
        for slots, values, y in rows:
            p = np.concatenate([[1], 1 / (1 + np.exp(-(weights[slots] @ values - thresholds))), [0]])
            out -= np.log(max(p[int(y)] - p[int(y) + 1], 1e-9))
        return out / len(rows)

    fitted = loss(model.weights, model.thresholds)
    assert fitted < 0.8 * loss(0 * model.weights, model.thresholds)
    for k in range(16):
        for step in (-0.3, 0.3):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved, model.thresholds) > fitted - 0.02


def test_quality_edges(spark, hard, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(3, None, None), (999, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.report(hard, labels).count() == hard.count()
    assert quality.report(empty, labels).count() == 0
    none = quality.report(hard, labels.limit(0)).collect()
    assert {(r.expected_grade, r.tail_probability) for r in none} == {(0.0, 0.0)}


# -- 3


def brute_substrings(docs, width):
    seen = {}
    for doc, text in docs:
        w = SPACE.findall(text or "")
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            d = float("inf") if doc is None else doc
            seen[k] = min(seen.get(k, d), d)
    out = []
    for doc, text in docs:
        w = SPACE.findall(text or "")
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] < (float("inf") if doc is None else doc):
                gone |= set(range(i, i + width))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return ordered(out)


@pytest.mark.parametrize("width,block", [(50, 1 << 19), (50, 100), (3, 500), (1, 40)])
def test_substrings(hard, width, block):
    want = brute_substrings(source(hard), width)
    assert sum(r[2] for r in want) > 0
    assert rows(substrings.report(hard, width=width, block_words=block)) == want


def test_substrings_intervals_are_maximal(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x a b c d y a b c z")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.removed] for r in substrings.find(docs, width=3).collect()}
    assert got == {1: [], 2: [(1, 5), (6, 9)]}


def test_substrings_extreme_ids_and_empty(spark, empty):
    docs = spark.createDataFrame([(-(1 << 63), "a b c"), ((1 << 63) - 1, "a b c"), (5, "a b c"), (None, "a b"), (None, None)], "doc_id long, text string")
    for bits in (None, 8, 12):
        got = substrings.report(docs, width=2) if bits is None else substrings.report(docs, width=2, bits=bits)
        assert sorted(((r.doc_id, r.n_removed) for r in got.collect()), key=repr) == sorted([(-(1 << 63), 0), ((1 << 63) - 1, 3), (5, 3), (None, 2), (None, 0)], key=repr)
    assert substrings.report(empty).count() == 0


# -- 4


def test_bpe(spark, hard, empty):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = []
    for doc, text in source(hard):
        ids = enc.encode_ordinary(text or "")
        want.append((doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text or "")))
    assert rows(bpe.report(hard, path, P.PATTERN)) == ordered(want)
    apart = bpe.decode(bpe.encode(hard, path, P.PATTERN), path)
    assert rows(apart.select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256))) == ordered(want)
    named = hard.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", F.lit(1).alias("ids"))
    assert rows(bpe.report(named, path, P.PATTERN)) == ordered((None if d is None else f"d{d}", *x) for d, *x in want)
    assert bpe.report(empty, path, P.PATTERN).count() == 0


def test_bpe_merges_and_perfect_hash():
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    table = bpe.PerfectHash(ranks)
    assert table.rank(list(ranks)) == list(ranks.values()) and sorted(table.keys) == sorted(ranks)
    assert table.rank([b"\xff\xfe nothing", b""]) == [-1, -1]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merges = bpe.Merges(ranks)
    for token in ("a" * 300, "abab" * 1000, "schifffahrtsgesellschaft", "日本語テキスト", "x"):
        assert merges.merge(token.encode()) == enc.encode_ordinary(token)


# -- 5


def brute_chat(turns):
    convs = {}
    for c, t, r, x in set(turns):
        convs.setdefault(c, []).append(((t is None, t or 0), (r is not None, r or ""), (x is not None, x or ""), r, x))
    seqs = {c: tuple((k[3], k[4]) for k in sorted(v)) for c, v in convs.items()}
    out = []
    for s in set(seqs.values()):
        if not any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            same = [c for c, o in seqs.items() if o == s]
            out.append((min((c for c in same if c is not None), default=None), len(s), len(same), "".join(f"<|im_start|>{r or 'user'}\n{x or ''}<|im_end|>\n" for r, x in s)))
    return ordered(out)


def test_chat(spark):
    turns = []
    for c, n in ((1, 2), (2, 4), (3, 4), (4, 3), (5, 1)):
        turns += [(c, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(n)]
    turns += [(6, 0, "user", "other"), (7, 0, "user", None), (8, 0, None, "t0"), (9, 5, "user", "t0"), (9, 6, "assistant", "t1"), (9, 6, "assistant", "t1"), (None, 0, "user", "lost"), (11, 0, "user", ""), (12, 0, "user", "x" * 200_000), (13, None, "user", "last"), (13, 1, "user", "first")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, place string")
    assert rows(chat.report(df)) == brute_chat(turns)
    assert chat.report(df.limit(0)).count() == 0


# -- 6


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(docs, threshold):
    first = {}
    for doc, text in docs:
        for p, s in enumerate(text.split("\n") if text is not None else []):
            place = (doc is None, doc or 0, p)
            first[s] = min(first.get(s, place), place)

    def close(a, b):
        edits = min(threshold, max(len(a), len(b)) // 5)
        return abs(len(a) - len(b)) <= edits and distance(a, b) <= edits

    near = {s for s, at in first.items() if any(o != s and at2 < at and close(o, s) for o, at2 in first.items())}
    out = []
    for doc, text in docs:
        own = text.split("\n") if text is not None else []
        stay = [s for p, s in enumerate(own) if first[s] == (doc is None, doc or 0, p) and s not in near or text == ""]
        out.append((doc, len(own), len(own) - len(stay), sha("\n".join(stay))))
    return ordered(out)


def lines_table(spark):
    base = "the quick brown fox jumps over the lazy dog number"
    texts = [base + " 1\nunique words here and no others\nshort", base + " 2\nshort\nx", base + " 34", "the quikc brown fox jumps over the lazy dog number 1", base.replace("fox", "ox") + " 1", "é" * 30 + "\n" + "é" * 32, "", "", None, "unique words here and no othersxyz", "a" * 5000 + "\n" + "a" * 4999]
    # One and two edits on both sides of 4, 5, 9, 10, 21 and 24 characters.
    texts += ["abcd", "abcde", "abcdeé", "abc", "xbcde", "qwertyuio", "qwertyuiop", "qwXrtyuiop", "qwertyuYoZ", "mnbvcxzas", "mnbvcxzXY", "the cat sat on a mat.", "the cat sat on a mad.", "the cat sat on the mat..", "the cat sat on the mat!!"]
    return spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)] + [(2, texts[2], "e"), (None, base + " 9", "e"), (None, "ab", "e"), ((1 << 63) - 1, "largest id\nab", "e")], "doc_id long, text string, k string")


@pytest.mark.parametrize("threshold,groups", [(1, (16, 1000)), (3, (1, 1000)), (2, (1, 3))])
def test_lines(spark, monkeypatch, threshold, groups):
    monkeypatch.setattr(lines, "GROUP", groups[0])
    monkeypatch.setattr(lines, "LARGE_GROUP", groups[1])
    df = lines_table(spark)
    want = brute_lines(source(df), threshold)
    assert rows(lines.report(df, threshold=threshold)) == want


@pytest.mark.parametrize("groups", [(5, 1000), (5, 30)])
def test_lines_of_one_form(spark, monkeypatch, groups):
    """Many lines that share most segments."""
    monkeypatch.setattr(lines, "GROUP", groups[0])
    monkeypatch.setattr(lines, "LARGE_GROUP", groups[1])
    rng = np.random.default_rng(5)
    texts = ["\n".join(f"invoice number {rng.integers(0, 5000):06d} was paid in full" if rng.random() < 0.8 else f"{rng.integers(0, 10**6):06d}" for _ in range(4)) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert rows(lines.report(df)) == brute_lines(source(df), 2)


def test_lines_pass_on_no_chance_pair(spark):
    """Lines that share a segment and little else don't leave the first join; near ones do."""
    texts = ["abcdefgh" + x * 4 for x in ("ee", "tt", "ao", "ni")] + ["the quick brown fox jumps", "the quick brown fax jumps"]
    docs = lines.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    got = lines.found(docs, 2)
    assert {(r.k, r.ek) for r in got.where(got.kind == lines.PAIR).collect()} == {(5, 4)}


def test_lines_hard(hard, empty):
    small = hard.where("text IS NULL OR length(text) < 5000")
    assert rows(lines.report(small, threshold=2)) == brute_lines(source(small), 2)
    assert lines.report(hard).count() == hard.count() and lines.report(empty).count() == 0


def test_lines_clean(spark):
    got = {(r.doc_id, r.text, r.k) for r in lines.clean(lines_table(spark)).collect()}
    assert (8, None, "e") in got and (6, "", "e") in got and (1, "x", "e") in got
    assert not {2, 3} & {d for d, *_ in got}


def test_letter_counts_bound_the_distance(spark):
    texts = ["", "i" * 15, "i" * 8, "s" * 9 + "i" * 15, lines.LETTERS * 15, lines.LETTERS * 16, "a bé c" * 40, "zzz"]
    pairs = [(x, y) for x in texts for y in [*texts, x[1:], x + "ii", x.replace("i", "e", 1)]]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.count_difference(lines.letter_counts(F.col("a")), lines.letter_counts(F.col("b"))).alias("d"))
    assert all(r.d <= 2 * distance(r.a, r.b) for r in df.collect())
    assert df.where("a = 'zzz' AND b = 'iiiiiiii'").first().d == 8


def test_banded_distance(spark):
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(200):
        a = list(rng.choice(list("abé"), rng.integers(3, 30)))
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            i = int(rng.integers(0, len(b) + 1))
            b[i : i + int(rng.integers(0, 2))] = list(rng.choice(list("abé"), rng.integers(0, 2)))
        if len(b) > 3:
            pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for t in (1, 2, 3):
        for r in df.select("a", "b", lines.banded_distance(F.col("a"), F.col("b"), t).alias("d")).collect():
            want = distance(r.a, r.b)
            assert (r.d == want) if want <= t else (r.d > t)


# -- 7


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(x, seed=42):
    return xxhash.xxh64_intdigest(x if isinstance(x, bytes) else x.encode(), seed)


def chained(hashes):
    h = 42
    for x in hashes:
        h = hashed(x.to_bytes(8, "little"), h)
    return h


def brute_tree(text):
    """(fingerprint, sections of (digest, paragraphs of (digest, leaves)))."""
    low = lambda h: f"{h & 0xFFFFFFFF:08x}"
    whole, tops = [], []
    for s in text.split("\n\n"):
        own = []
        for p in s.split("\n"):
            leaves = [hashed(m.group(0)) for m in re.finditer(merkle.LEAF, p, re.ASCII)]
            own.append((chained(leaves), [low(x) for x in leaves]))
        top = chained(h for h, _ in own)
        tops.append(f"{top:X}")
        whole.append((low(top), [(low(h), ls) for h, ls in own]))
    root = sha(".".join(tops))[:32]
    return root + "/" + ";".join(d + ":" + ",".join(".".join([h, *ls]) if ls else h + "." for h, ls in ps) for d, ps in whole), whole


def brute_likeness(a, b):
    from itertools import zip_longest

    size = lambda t: sum(len(ls) for _, ps in t for _, ls in ps)
    if size(a) + size(b) == 0:
        return 1.0
    flat = lambda t: {(i, j, k): x for i, (_, ps) in enumerate(t) for j, (_, ls) in enumerate(ps) for k, x in enumerate(ls)}
    fa, fb = flat(a), flat(b)
    held = 2 * sum(fb.get(k) == x for k, x in fa.items()) / (len(fa) + len(fb))
    da, db = {d for d, _ in a}, {d for d, _ in b}
    same = sum(sum(len(ls) for _, ls in ps) for d, ps in {d: ps for d, ps in a if d in db}.items())
    pa, pb = [p for d, ps in a if d not in db for p in ps], [p for d, ps in b if d not in da for p in ps]
    ka, kb = {d for d, _ in pa}, {d for d, _ in pb}
    same += sum(len(ls) for d, ls in {d: ls for d, ls in pa if d in kb}.items())
    la, lb = {x for d, ls in pa if d not in kb for x in ls}, {x for d, ls in pb if d not in ka for x in ls}
    same += len(la & lb)
    every = 2 * (same - len(la & lb)) + len(la) + len(lb)
    return max(held, 2 * same / every if every else 0.0)


def brute_changed(a, b):
    from itertools import zip_longest

    out = []
    for i, (x, y) in enumerate(zip_longest(a, b, fillvalue=(None, []))):
        if x[0] != y[0]:
            out += [(i, j) for j, (p, q) in enumerate(zip_longest(x[1], y[1], fillvalue=(None, []))) if p[0] != q[0]]
    return out


def brute_merkle(docs):
    docs = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, signed(hashed(r[1])), signed(hashed(r[1], hashed("text")))))
    out = []
    for i, (doc, text) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + nxt[:q]
        (f, a), (g, b), (_, c) = brute_tree(text), brute_tree(edited), brute_tree(nxt)
        out.append((doc, len(text), sha(edited), f, g, brute_likeness(a, b), brute_likeness(a, c), len(brute_changed(a, b))))
    return ordered(out)


def test_merkle(hard, empty):
    """All columns, on null, empty, long and repeated rows."""
    got = merkle.report(hard)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_changed"]
    got = rows(got)
    assert got == brute_merkle(source(hard))
    assert all(r[5] >= 0.5 for r in got if r[1] >= 100)
    assert len({r[3] for r in got}) == len({t or "" for _, t in source(hard)})
    assert merkle.report(empty).count() == 0


@pytest.mark.parametrize("ids", [int, str])
def test_merkle_many_ranges(spark, ids):
    docs = [(ids(i * i), f"text {i} of\n\nmany " * (i % 5)) for i in range(120)] + [(ids(49), "again"), (ids(49), "again"), (ids(49), "again"), (ids(49), "other")]
    df = spark.createDataFrame([(*d, "x") for d in docs], f"doc_id {'long' if ids is int else 'string'}, text string, box string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        assert rows(merkle.report(df)) == brute_merkle(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_merkle_locates_edits(spark):
    a = "s0 p0\ns0 p1\n\ns1 p0\ns1 p1\ns1 p2"
    b = "s0 p0\ns0 p1\n\ns1 p0\ns1 pX\ns1 p2\ns1 p3"
    c = a + "\n\nnew\nsection"
    df = spark.createDataFrame([(1, a, b), (2, a, a), (3, a, c), (4, c, a)], "i int, a string, b string")
    trees = [merkle.digests(merkle.tree(F.col(x))) for x in "ab"]
    got = {r.i: [tuple(x) for x in r.d] for r in df.select("i", merkle.changed(*trees).alias("d")).collect()}
    assert got == {1: [(1, 1), (1, 3)], 2: [], 3: [(2, 0), (2, 1)], 4: [(2, 0), (2, 1)]}


def test_merkle_insertions_and_repeats(spark):
    rng = np.random.default_rng(7)
    text = " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(300))
    same = "the same paragraph again and again\n" * 50
    df = spark.createDataFrame([(1, text, "x" + text), (2, same, same + "and one more"), (3, text, text), (4, text, "unlike"), (5, "", ""), (6, "", "a")], "i int, a string, b string")
    trees = [merkle.digests(merkle.tree(F.col(x))) for x in "ab"]
    got = {r.i: r.s for r in df.select("i", merkle.likeness(*trees).alias("s")).collect()}
    assert got[1] > 0.9 and got[2] > 0.9 and got[3] == got[5] == 1.0 and got[4] == got[6] == 0.0


def test_merkle_leaves_survive_lengths_and_insertions(spark):
    rng = random.Random(5)
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéш") for _ in range(rng.randint(a, b)))
    words, tiny, solid = " ".join(word(1, 9) for _ in range(900))[:5000], " ".join(word(1, 3) for _ in range(1700))[:5000], word(5000, 5000)
    pairs = [(t, "x" + t, 0.9) for t in (words, tiny, solid)] + [(words[:63], words[:65], 0.6), (words[:80], words[:60], 0.5)]
    for t in (words, tiny, solid, "a" * 100, "ab", ""):
        assert "".join(m[0] for m in re.finditer(merkle.LEAF, t)) == t
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i long, a string, b string")
    trees = [merkle.digests(merkle.tree(F.col(x))) for x in "ab"]
    got = {r.i: r.s for r in df.select("i", merkle.likeness(*trees).alias("s")).collect()}
    assert all(got[i] >= least for i, (_, _, least) in enumerate(pairs)), got
    # A text of 80 characters before an empty one keeps 60.
    near = {r.doc_id: r.near_edited for r in merkle.report(spark.createDataFrame([(1, words[:80]), (2, "")], "doc_id long, text string")).collect()}
    assert near[1] >= 0.5


# -- 8


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    vocab, bad = [f"word{i}x" for i in range(300)], ["grumpus", "snollyg", "wretcho"]
    cells, marks = [], []
    for i in range(500):
        toxic = int(rng.random() < 0.2)
        w = list(rng.choice(vocab, 60))
        if toxic:
            w[5] = rng.choice(bad)
        elif i % 50 == 0:
            w[5:7] = ["grumpus", "flower"]
        cells.append((i, " ".join(w)))
        marks.append((i, 1, toxic))
    docs, labels = spark.createDataFrame(cells, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(bad) <= set(model.lexicon)
    assert any(p == "grumpus flower" for p in model.exceptions)
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    assert np.mean([got[i].predicted == t for i, _, t in marks if got[i].held_out]) > 0.97
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    # Look-alikes and digits fold to the word.
    odd = spark.createDataFrame([(1, "so grуmpus then"), (2, "a SN0LLYG thing"), (3, "wr3tch0!!"), (4, "plain talk")], "doc_id long, text string")
    scores = {r.doc_id: r.s for r in odd.select("doc_id", toxicity.score_column(model, F.col("text")).alias("s")).collect()}
    assert toxicity.words("SN0LLYG wr3tch0!!") == ["snollyg", "wretcho"]
    assert min(scores[2], scores[3]) > 0.5 > scores[4]


def test_toxicity_scores(spark, hard):
    """Lexicon, exceptions and every score by plain Python: counts over labelled rows, each hit looked for by itself."""
    import math
    import zlib

    rng = np.random.default_rng(6)
    bad = ["grumpus", "snollyg"]
    cells = []
    for i in range(400):
        w = [f"word{int(x)}" for x in rng.integers(0, 80, 30)]
        if i % 5 == 0:
            w[3] = bad[i // 5 % 2]
        elif i % 47 == 0:
            w[4:6] = ["grumpus", "flower"]
        cells.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame([c[:2] for c in cells], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in cells] + [(0, 0), (10**6, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    train = [(toxicity.words(t), y) for i, t, y in cells if zlib.crc32(str(i).encode()) % 5]
    n = [sum(y == k for _, y in train) for k in (0, 1)]

    def standing_out(terms):
        seen = [Counter(), Counter()]
        for w, y in train:
            seen[y].update(set(terms(w)))
        return {k: (seen[0][k], seen[1][k], math.log((seen[1][k] + 0.5) / (n[1] + 1)) - math.log((seen[0][k] + 0.5) / (n[0] + 1))) for k in seen[0].keys() | seen[1].keys()}

    share = n[1] / sum(n)
    lexicon = {k: o for k, (c, x, o) in standing_out(lambda w: w).items() if x >= 3 and o > 2.5 and (x - (c + x) * share) / math.sqrt((c + x) * share * (1 - share)) > 5}
    exceptions = {k for k, (c, x, o) in standing_out(lambda w: [f"{a} {b}" for a, b in zip(w, w[1:]) if a in lexicon or b in lexicon]).items() if c >= 3 and o < 0}
    assert model.lexicon.keys() == lexicon.keys() and all(abs(model.lexicon[k] - v) < 1e-9 for k, v in lexicon.items()) and set(model.exceptions) == exceptions and exceptions

    def score(text):
        w = toxicity.words(text)
        safe = {p for i in range(len(w) - 1) if f"{w[i]} {w[i + 1]}" in exceptions for p in (i, i + 1)}
        hits = [lexicon[x] for i, x in enumerate(w) if x in lexicon and i not in safe]
        x = np.log1p([sum(hits), sum(hits) / max(len(w), 1) ** 0.5, len(hits)])
        return 1 / (1 + math.exp(-min(30, max(-30, float(x @ model.weights[:-1] + model.weights[-1])))))

    more = hard.select("doc_id", "text").unionByName(docs).unionByName(spark.createDataFrame([(1, "grumpus flower grumpus"), (2, "flower grumpus garden snollyg " * 500)], "doc_id long, text string"))
    for r in more.select("text", toxicity.score_column(model, F.col("text")).alias("s")).collect():
        assert abs(r.s - score(r.text)) < 1e-6


def test_toxicity_hits_outside_exceptions():
    rng = np.random.default_rng(8)
    for _ in range(300):
        spans = lambda n, most: [(int(a), int(a) + int(rng.integers(1, most))) for a in rng.integers(0, 30, n)]
        hits, safe = spans(8, 5), spans(int(rng.integers(0, 6)), 9)
        assert sorted(toxicity.outside(hits, safe)) == sorted(h for h in hits if not any(s[0] <= h[0] and h[1] <= s[1] for s in safe))
    many = [(i, i + 1) for i in range(200_000)]
    assert toxicity.outside(many, [(i, i + 2) for i in range(0, 200_000, 2)]) == []


def test_toxicity_edges(spark, hard, empty):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(30)] + [(3, None, None), (999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.report(hard, labels).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert toxicity.report(empty, labels).count() == 0
    assert {r.score for r in toxicity.report(hard, labels.limit(0)).collect()} == {0.0}
    assert toxicity.clean(hard, labels.limit(0)).columns == hard.columns


# -- 9


def test_licenses(spark, hard, empty):
    base = {tuple(k.split()): v for k, v in licenses.BASE.items()}
    extra = [(100, "All rights reserved. all RIGHTS reserved"), (101, "cc by cc by, CC-BY!"), (102, "all rights not reserved"), (103, "general public"), (104, "public license general public license")]
    docs = hard.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = []
    for doc, text in source(docs):
        w = ALNUM.findall((text or "").translate(LOWER))
        at = [(i, v) for k, v in base.items() for i in range(len(w)) if tuple(w[i : i + len(k)]) == k]
        want.append((doc, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({v for _, v in at}))))
    got = licenses.report(docs)
    assert rows(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == ordered(want)
    assert got.where("NOT (score BETWEEN 0 AND 1)").count() == 0 and licenses.report(empty).count() == 0


def brute_spans(text):
    """Spans (template, label, exact, first, past, share) of a text, by the rules of the module."""
    w = ALNUM.findall((text or "").translate(LOWER))
    names = [(p.split(), x, True) for p, x in licenses.BASE.items()] + [(p.split(), x, False) for p, x in licenses.TEMPLATES.items()]
    out = []
    for k, (phrase, label, exact) in enumerate(names):
        votes = {}
        for p in range(len(w) - 1):
            for q in range(len(phrase) - 1):
                if w[p : p + 2] == phrase[q : q + 2]:
                    votes.setdefault(p - q, []).append((p, q))
        clusters, last = [], None
        for d in sorted(votes):
            if exact or last is None or d - last > licenses.GAP:
                clusters.append([])
            clusters[-1] += [(d, *v) for v in votes[d]]
            last = d
        for c in clusters:
            places = {q for _, _, q in c}
            first, past, share = min(p for _, p, _ in c), max(p for _, p, _ in c) + 2, len(places) / (len(phrase) - 1)
            if exact:
                if share == 1:
                    out.append((k, label, True, min(d for d, _, _ in c), past, share))
            else:
                words = places | {q + 1 for q in places}
                own = {i for i, x in enumerate(phrase) if x in re.split("[-.]", label)}
                enough = share >= licenses.COVER or len(words) / len(phrase) >= licenses.COVER and own and own <= words
                if enough and past - first <= len(phrase) + 2 * licenses.GAP:
                    out.append((k, label, False, first, past, share))
    beaten = lambda s, t: not t[2] and t[0] != s[0] and t[3] < s[4] and s[3] < t[4] and t[5] > s[5]
    return len(w), sorted(s for s in out if s[2] or not any(beaten(s, t) for t in out))


def test_licenses_all_columns(spark, hard):
    """Every span, label and score against plain Python, on texts with whole, cut, repeated, overlapping and altered license lines."""
    rng = random.Random(4)
    phrases, texts = [*licenses.BASE, *licenses.TEMPLATES], []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(phrases).split()
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = rng.choice([[], ["other"], ["the", "license"]])
                w = w or ["x"]
            parts += w + rng.choice([[], ["some"], "words of no license at all".split()])
        texts.append(" ".join(parts))
    texts.append(" ".join(phrases) * 40)
    docs = hard.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")).withColumn("label", F.lit("x"))
    got = sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans]) for r in licenses.scan(docs).collect()), key=repr)
    want = sorted(((d, *brute_spans(t)) for d, t in source(docs)), key=repr)
    near = lambda spans: [(*s[:5], round(s[5], 9)) for s in spans]
    assert [(a, b, near(c)) for a, b, c in got] == [(a, b, near(c)) for a, b, c in want]
    columns = []
    for d, n, spans in want:
        own, label = [s[3] for s in spans if s[2]], lambda xs: ",".join(sorted({s[1] for s in xs}))
        columns.append((d, n, len(own), min(own, default=None), max(own, default=None), label([s for s in spans if s[2]]), label(spans), round(max((s[5] for s in spans), default=0.0), 9)))
    report = licenses.report(docs).withColumn("score", F.round("score", 9))
    assert rows(report) == ordered(columns)


def test_licenses_diagonals_merge(spark):
    text = "intro words " + "permission is hereby granted totally free of charge to any person obtaining a copy of this software" + " and more"
    got = licenses.report(spark.createDataFrame([(1, text), (2, "permission is hereby denied")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in got} == {1: "mit", 2: ""}


def test_licenses_bear_a_replaced_and_a_left_out_word(spark):
    texts = {
        "Licensed under the Apache License 2.0": "apache-2.0", "Licensed under the Apache Licence, version 2.0": "apache-2.0", "released under this MIT license": "mit",
        "Licensed under the Eclipse License, version 2.0": "", "released under the ISC license": "", "Licensed under CC BY NC 4.0": "cc-by,cc-by-nc-4.0", "Licensed under CC BY 4.0": "cc-by,cc-by-4.0",
    }
    docs = spark.createDataFrame([(i, f"some words before. {t}. And some after") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.report(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


# -- 10


def test_simhash_fingerprints(hard):
    for doc, text in source(hard)[:40]:
        w = SPACE.findall((text or "").translate(LOWER))
        s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        votes, n = Counter(), len(s)
        for x in s:
            h = xxhash.xxh64_intdigest(x.encode(), 42)
            votes.update(b for b in range(64) if h >> b & 1)
        want = sum(1 << b for b in range(64) if 2 * votes[b] > n)
        assert int.from_bytes(simhash.fingerprint(text.encode() if text is not None else None), "big") == want


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_code_covers():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 22, 2000)
    s = simhash.syndromes(x)
    assert all(bin(int(simhash.COSETS[k, 0])).count("1") <= simhash.RADIUS for k in range(128))
    # Anchors are code words: their syndrome is zero.
    assert (simhash.syndromes(x ^ simhash.COSETS[s, 0]) == 0).all()


@pytest.mark.parametrize("cell", [None, 50])
def test_simhash_components(spark, monkeypatch, cell):
    rng = np.random.default_rng(4)
    if cell:
        monkeypatch.setattr(simhash, "CELL", cell)
    prints = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 60)]
    for _ in range(400):
        p = prints[int(rng.integers(0, len(prints)))]
        for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
            p ^= -(1 << 63) if b == 63 else 1 << int(b)
        prints.append(p)
    df = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(df).collect()}
    roots = brute_components([p & (1 << 64) - 1 for p in prints])
    least = {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    assert all(got[p] == least[roots[i]] for i, p in enumerate(prints))


def test_simhash_report(spark, hard):
    """All columns against fingerprints and links computed one by one, with near copies and ids that tie."""
    rng = random.Random(9)
    base = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(400))
    near = [base[:-k] if k else base for k in range(0, 30, 3)] + [base.replace(" ", "  ").upper()]
    docs = hard.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(near)] + [(500, near[3])], "doc_id long, text string"))
    own = source(docs)
    prints = [int.from_bytes(simhash.fingerprint(t.encode() if t is not None else None), "big") for _, t in own]
    roots = brute_components(prints)
    least = {}
    for (d, _), r in zip(own, roots):
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    assert rows(simhash.report(docs)) == ordered((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(own, prints, roots))
    kept = {}
    for (d, t), p, r in zip(own, prints, roots):
        key = (d is None, d or 0, p - (1 << 64) if p >> 63 else p)
        if r not in kept or key < kept[r][0]:
            kept[r] = (key, d)
    assert sorted((r.doc_id for r in simhash.one_each(docs).collect()), key=repr) == sorted((d for _, d in kept.values()), key=repr)


def test_simhash_rows(hard, empty):
    got = simhash.report(hard).collect()
    assert len(got) == hard.count() and simhash.report(empty).count() == 0
    kept = simhash.one_each(hard)
    assert kept.columns == hard.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in got if r.component_id is not None})


def test_no_python_on_native_paths(spark, hard):
    turns = hard.select(F.col("doc_id").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), "text")
    for df in (lines.report(hard), merkle.report(hard), licenses.report(hard), chat.report(turns)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_python_operators_on_line_dedup(spark, hard):
    """What line dedup returns is an input for the operators that run Python, without being written first."""
    import public_tokenizers as P

    clean = lines.clean(hard)
    n = clean.count()
    assert bpe.report(clean, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == n
    assert simhash.report(clean).count() == n and simhash.one_each(clean).columns == hard.columns
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    assert toxicity.report(clean, labels).count() == n and quality.report(clean, labels).count() == n
    assert decontaminate.report(clean, spark.createDataFrame([(1, "All rights reserved.")], ITEMS)).count() == n and substrings.report(clean).count() == n
