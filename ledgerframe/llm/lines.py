"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A text's lines are what newlines separate. Two lines are near if at most ``THRESHOLD`` edits (characters
inserted, deleted or replaced) part them, and at most one for each ``PER_EDIT`` characters of the longer: so
they are alike to four fifths at least, whatever their length. A line goes if an equal or a near one stands
earlier: in a document with a smaller id, or further up. So of equal lines the first stays, unless it is
itself near an earlier line.

Equal lines are brought together by hash first, so a line that a third of all documents have is one entry.
Each first line is cut into threshold + 1 even segments; if two lines are within the threshold, some segment
of the shorter occurs in the longer, at one of a few places that segment number and lengths determine. Index
rows (length, segment number, segment) meet probe rows of those substrings in one equi-join. Both carry counts of
frequent letters, so only pairs whose counts allow it (an edit changes two of them by one at most) leave the join; chance
pairs, whose number grows faster than the corpus, don't. What leaves it is verified by a banded bit-parallel edit distance.

Of a segment that over ``GROUP`` index rows share, the join passes on the probe rows only. They meet in a second
join, by letter counts too. A segment that over ``LARGE_GROUP`` index rows share isn't joined there either:
its lines, with that segment taken out, are cut again, and meet by the segment and a segment of the rest; and so
on, until groups are smaller or the rest has no segments left.

Defined results: a null text has no lines and stays null; an empty text is one empty line, which stays
whatever else does; rows with the same id are the same document, so they don't remove one another's lines
at the same place, and if their texts differ, what is near at a place of one goes there in all; a null id counts as larger
than any other; texts and lines of any length are compared whole; columns of any name come back as they are. Ids are integers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, packed, stored, tidy

THRESHOLD = 2
#: Characters of the longer line for each edit.
PER_EDIT = 5
#: Index rows of one segment that are paired with all its probe rows, and those whose letter counts are.
GROUP, LARGE_GROUP = 16, 1000
#: Places of lines that are sent to all documents: some megabytes. More are met by a shuffle.
FEW = 200_000
#: Added to the places of lines in documents without an id, which come after those of the largest id.
NO_ID = 1 << 32
LARGEST = (1 << 63) - 1
#: Counted letters, four bits of each count in one integer.
LETTERS = "etaonisrhdlucmg "


def segments(length: Column, threshold: int) -> list[tuple[Column, Column]]:
    """(first place from 1, length) of each of threshold + 1 even segments; the last ones are longer by one."""
    parts = threshold + 1
    base = F.floor(length / parts).cast("int")
    longer = length - base * parts
    out = []
    for i in range(parts):
        extra = F.greatest(F.lit(0), longer - (parts - i))
        out.append((base * i + extra + 1, base + F.when(longer >= parts - i, 1).otherwise(0)))
    return out


def combos(threshold: int) -> list[tuple[int, int, int]]:
    """(less, i, shift): where segment i of a line that is shorter by ``less`` can stand, against its own place. First those of the line itself."""
    out = [(0, i, 0) for i in range(threshold + 1)]
    for less in range(threshold + 1):
        for i in range(threshold + 1):
            for shift in range(max(-i, less - (threshold - i)), min(i, less + (threshold - i)) + 1):
                if (less, i, shift) not in out:
                    out.append((less, i, shift))
    return out


def pieces(length: Column, threshold: int) -> list[tuple[Column, Column, Column, Column]]:
    """(length of the other line, segment number, first place, length) in a line of ``length`` for each of the combos."""
    out = []
    for less, i, shift in combos(threshold):
        other = length - less
        at, n = segments(other, threshold)[i]
        out.append((other, F.lit(i), at + shift, n))
    return out


def keys(wide: Column, length: Column, threshold: int) -> list[Column]:
    """The key of each of the combos, of a line of four bytes a character; null where the other line would be too short to be near."""
    out = []
    for (less, _, _), (other, i, at, n) in zip(combos(threshold), pieces(length, threshold)):
        # A substring that the line's end cuts short equals no segment.
        fits = (other >= PER_EDIT - 1) & (length >= PER_EDIT * less)
        out.append(F.when(fits, F.xxhash64(other, i, F.substr(wide, at * 4 - 3, n * 4))))
    return out


def letter_counts(line: Column) -> Column:
    """Counts of ``LETTERS``, each modulo 16; in a loop, since a method of all steps in line is too long to be compiled."""
    count = lambda x: (F.octet_length(line) - F.octet_length(F.replace(line, x, F.lit("")))).bitwiseAND(15).cast("long")
    return F.aggregate(F.array(*[F.lit(x) for x in LETTERS]), F.lit(0).cast("long"), lambda out, x: F.shiftleft(out, 4).bitwiseOR(count(x)))


def count_difference(a: Column, b: Column) -> Column:
    """The sum of the differences of all counts, each modulo 16: at most twice the edit distance.

    Every other count at once, a byte for each: the remainder by 255 is the sum of the bytes.
    """
    each = lambda n: F.lit(n * 0x0101010101010101).cast("long")

    def folded(x, y):
        d = (x.bitwiseAND(each(15)).bitwiseOR(each(16)) - y.bitwiseAND(each(15))).bitwiseAND(each(15))
        above = F.shiftright(d + each(7), 4).bitwiseAND(each(1))  # 1 where 16 - d is less than d
        return d.bitwiseXOR(F.shiftleft(above, 4) - above) + above

    high = lambda x: F.shiftrightunsigned(x, 4)
    return (folded(a, b) + folded(high(a), high(b))) % 255


def banded_distance(pattern: Column, text: Column, threshold: int) -> Column:
    """The edit distance of two strings if it is at most ``threshold``, else some larger number.

    Myers' bit vectors over the band of 2 * threshold + 1 diagonals: bit b of column j is row
    j - threshold + b, so the vectors move down by one row with each column. The score follows the lowest
    diagonal to the last row, then that row to the last column. Strings have at least threshold characters.
    """
    band = (1 << (2 * threshold + 1)) - 1
    word = lambda c: F.lit(c).cast("long")
    inverse = lambda c: F.bitwise_not(c).bitwiseAND(word(band))

    def of(p, t):
        m, n = F.size(p), F.size(t)

        def column(acc, j):
            char = F.element_at(t, j)
            match = word(0)
            for b in range(2 * threshold + 1):
                i = j - threshold + b
                here = F.when((i >= 1) & (i <= m), F.try_element_at(p, F.greatest(i, F.lit(1)))) == char
                match = match + F.when(F.coalesce(here, F.lit(False)), word(1 << b)).otherwise(word(0))
            down_add, down_sub = acc["vp"], acc["vn"]

            def step(x):
                d0 = ((x.bitwiseAND(down_add) + down_add).bitwiseXOR(down_add)).bitwiseOR(x).bitwiseOR(down_sub).bitwiseAND(word(band))

                def rest(d):
                    right_add = down_sub.bitwiseOR(inverse(d.bitwiseOR(down_add)))
                    right_sub = d.bitwiseAND(down_add)
                    low = F.shiftright(d, 1)
                    last = j - (m - threshold)  # columns since the lowest diagonal reached the last row
                    bit = F.greatest(F.lit(0), 2 * threshold - last)
                    at = lambda v: v.bitwiseAND(word(1 << (2 * threshold))) != 0
                    row = lambda v: F.when(F.element_at(F.array(*[v.bitwiseAND(word(1 << b)) != 0 for b in range(2 * threshold + 1)]), bit + 1), 1).otherwise(0)
                    score = F.when(last <= 0, acc["d"] + F.when(at(d), 0).otherwise(1)).otherwise(acc["d"] + row(right_add) - row(right_sub))
                    return F.struct(right_sub.bitwiseOR(inverse(low.bitwiseOR(right_add))).alias("vp"), low.bitwiseAND(right_add).alias("vn"), score.alias("d"))

                return let(d0, rest)

            return let(match, step)

        start = F.struct(word(band & ~((1 << threshold) - 1)).alias("vp"), word(0).alias("vn"), F.lit(threshold).alias("d"))
        return F.when(F.abs(m - n) <= threshold, F.aggregate(F.sequence(F.lit(1), n), start, column, lambda acc: acc["d"])).otherwise(threshold + 1)

    return let(F.split(pattern, ""), lambda p: let(F.split(text, ""), lambda t: of(p, t)))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, z, box): the id (of none: the largest), whether there is none, and the row.

    The row travels in an array, whose cells the optimizer doesn't prune, so all joins below read one exchange of
    the documents by id; and its columns may have any names.
    """
    ident = F.col(f"`{id_col}`").cast("long")
    row = F.struct(F.col(f"`{text_col}`").alias("text"), ident.alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"))
    return docs.select(F.coalesce(ident, F.lit(LARGEST)).alias("k"), ident.isNull().alias("z"), F.array(row).alias("box"))


def text_of(box: str = "box") -> Column:
    return F.element_at(F.col(box), 1)["text"]


def trimmed(a: Column, b: Column, threshold: int) -> Column:
    """struct<a, b>: two lines without most of what they begin and end with alike, but ``threshold`` characters at least; their distance stays."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(15))])

    def grown(most, piece):
        """The largest sum of some steps in turn, up to ``most``, for which pieces of both lines are equal."""
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(n + step > most, n).when(piece(a, n, step) == piece(b, n, step), n + step).otherwise(n))

    def of(least):
        def with_prefix(p):
            suffix = grown(least - p, lambda x, n, step: F.substr(x, F.char_length(x) - n - step + 1, step))
            return let(suffix, lambda s: F.struct(*[F.substr(x, p + 1, F.char_length(x) - p - s).alias(name) for x, name in ((a, "a"), (b, "b"))]))

        return let(grown(least, lambda x, n, step: F.substr(x, n + 1, step)), with_prefix)

    return let(F.least(F.char_length(a), F.char_length(b)) - threshold, of)


def occurrences(docs: DataFrame) -> DataFrame:
    """(place, line) of every line; places are decimals in the order of (k, z, position)."""
    own = docs.select("k", "z", F.posexplode(F.split(text_of(), "\n")).alias("pos", "line"))
    position = F.col("pos").cast("long") + F.when(F.col("z"), F.lit(NO_ID)).otherwise(F.lit(0))
    return own.select((F.col("k").cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)") + position.cast("decimal(10,0)")).alias("place"), "line")


def split_place(df: DataFrame) -> DataFrame:
    """``place`` as two integers, k and q (the position, beyond ``NO_ID`` in documents without an id)."""
    k = F.floor(F.col("place") / F.lit(10**10).cast("decimal(11,0)")).cast("long")
    q = (F.col("place") - k.cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)")).cast("long")
    return df.withColumn("k", k).withColumn("q", q).drop("place")


def first_lines(docs: DataFrame, threshold: int) -> DataFrame:
    """(box): for each distinct line, where it first stands (k, q), its letter counts and its keys (k0, k1, ...).

    All of it is of fixed width, so one hash aggregate with map-side partials finds it, and no text is shuffled. It is
    boxed so that those who read different cells share one exchange. Four bytes a character make places
    of characters places of bytes, so no segment is searched for from the line's start.
    """
    lines = occurrences(docs).withColumn("wide", F.encode(F.make_valid_utf8("line"), "UTF-32"))
    own = [c.alias(f"k{j}") for j, c in enumerate(keys(F.col("wide"), F.shiftright(F.octet_length("wide"), 2), threshold))]
    lines = lines.select("place", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b"), letter_counts(F.col("line")).alias("counts"), *own)
    rows = split_place(lines.groupBy("a", "b").agg(F.min("place").alias("place"), F.max("counts").alias("counts"), *[F.max(f"k{j}").alias(f"k{j}") for j in range(len(own))]))
    return rows.select(F.array(F.struct(*[c for c in rows.columns if c not in ("a", "b")])).alias("box"))


def cell(name: str) -> Column:
    return F.element_at("box", 1)[name]


def entries(firsts: DataFrame, n_keys: int) -> DataFrame:
    """(key, j, k, q, counts): a row for each key."""
    own = F.array(*[F.struct(cell(f"k{j}").alias("key"), F.lit(j).cast("byte").alias("j")) for j in range(n_keys)])
    return firsts.select(F.inline(own), cell("k").alias("k"), cell("q").alias("q"), cell("counts").alias("counts")).where("key IS NOT NULL")


def later(threshold: int) -> Column:
    """Whether a pair of a probe and an index row is to be looked at: pairs of one length meet from both sides, of which one will do."""
    shorter = F.col("j").isin([j for j, (less, _, _) in enumerate(combos(threshold)) if less])
    return shorter | (F.col("k") > F.col("ik")) | ((F.col("k") == F.col("ik")) & (F.col("q") > F.col("iq")))


def similar(threshold: int) -> Column:
    """Whether a pair of a probe and an index row is a candidate: two lines whose letter counts allow ``threshold`` edits."""
    apart = (F.col("k") != F.col("ik")) | (F.col("q") != F.col("iq"))
    return apart & later(threshold) & (count_difference(F.col("counts"), F.col("icounts")) <= 2 * threshold)


def ordered() -> list[Column]:
    """(k, q, ek, eq): the later and the earlier line of a pair (k, q), (ik, iq)."""
    after = (F.col("k") > F.col("ik")) | ((F.col("k") == F.col("ik")) & (F.col("q") > F.col("iq")))
    pick = lambda x, y, name: F.when(after, F.col(x)).otherwise(F.col(y)).alias(name)
    return [pick("k", "ik", "k"), pick("q", "iq", "q"), pick("ik", "k", "ek"), pick("iq", "q", "eq")]


FIRST, PAIR, LARGE = 0, 1, 2


def found(docs: DataFrame, threshold: int) -> DataFrame:
    """Stored rows (kind, key, j, k, q, ek, eq, counts): first lines, candidate pairs, and probe rows of segments that many index rows share."""
    firsts = first_lines(docs, threshold)
    index = entries(firsts, threshold + 1).select("key", F.col("k").alias("ik"), F.col("q").alias("iq"), F.col("counts").alias("icounts"))
    # Of a large group one row is left, for its probe rows to meet.
    group = Window.partitionBy("key").orderBy("ik", "iq")
    whole = F.count("*").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    index = index.withColumn("m", whole).withColumn("r", F.row_number().over(group)).where((F.col("m") <= GROUP) | (F.col("r") == 1))
    large = F.col("m") > GROUP
    both = entries(firsts, len(combos(threshold))).join(index, "key").where(large | similar(threshold))
    none = lambda *names: [F.lit(None).cast("byte" if c == "j" else "long").alias(c) for c in names]
    rows = firsts.select(F.lit(FIRST).alias("kind"), *none("key", "j"), cell("k").alias("k"), cell("q").alias("q"), *none("ek", "eq", "counts"))
    k, q, ek, eq = ordered()
    pairs = both.select(
        F.when(large, LARGE).otherwise(PAIR).alias("kind"), F.when(large, F.col("key")).alias("key"), F.when(large, F.col("j")).alias("j"),
        F.when(large, F.col("k")).otherwise(k).alias("k"), F.when(large, F.col("q")).otherwise(q).alias("q"), F.when(~large, ek).alias("ek"), F.when(~large, eq).alias("eq"),
        F.when(large, F.col("counts")).alias("counts"),
    )
    return stored(rows.unionByName(pairs), "lines")


def at_places(docs: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """(k, q, line) of the lines at ``places`` (k, q), of which there are ``n`` at most: if few, they are sent to the documents."""
    wanted = places.groupBy("k", (F.col("q") >= NO_ID).alias("z")).agg(F.collect_set("q").alias("at"))
    both = docs.join(F.broadcast(wanted) if n <= FEW else wanted.hint("shuffle_hash"), ["k", "z"])
    place = lambda q: (q.bitwiseAND(F.lit(NO_ID - 1)) + 1).cast("int")
    lines = let(F.split(text_of(), "\n"), lambda own: F.transform("at", lambda q: F.struct(q.alias("q"), F.try_element_at(own, place(q)).alias("line"))))
    return both.select("k", F.inline(lines)).where("line IS NOT NULL")


def met(index: DataFrame, probe: DataFrame, threshold: int) -> DataFrame:
    """(k, q, ek, eq): pairs of an index and a probe row (key, k, q, counts) that share a key and have similar counts."""
    own = index.select("key", F.col("k").alias("ik"), F.col("q").alias("iq"), F.col("counts").alias("icounts"))
    return probe.join(own, "key").where(similar(threshold)).select(*ordered())


def large_groups(index: DataFrame) -> DataFrame:
    return index.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > LARGE_GROUP).select("key")


def among_many(docs: DataFrame, table: DataFrame, threshold: int) -> list[DataFrame]:
    """Candidate pairs (k, q, ek, eq) among lines that share a segment with many others."""
    # An index row is a probe row at its own place.
    rows = table.where(F.col("kind") == LARGE).select("key", "j", "k", "q", "counts", (F.col("j") <= threshold).alias("own"))
    if rows.isEmpty():
        return []
    large = stored(large_groups(rows.where("own")), "lines-large")
    small = rows.join(large, "key", "left_anti")
    out = [met(small.where("own"), small, threshold)]
    if large.isEmpty():
        return out
    # Only lines of the largest groups are cut again, so only their texts are read.
    rows = rows.join(large, "key", "left_semi")
    places = rows.select("k", "q").distinct()
    rows = stored(rows.join(at_places(docs, places, places.count()), ["k", "q"]).withColumnRenamed("line", "rest"), "lines-rows")
    while True:
        large = stored(large_groups(rows.where("own")), "lines-large")
        small = rows.join(large, "key", "left_anti")
        out.append(met(small.where("own"), small, threshold))
        if large.isEmpty():
            return out
        # The piece that the key stands for is taken out; what has no segments left meets as it is, the rest is cut again.
        many = rows.join(large, "key", "left_semi").withColumn("n", F.char_length("rest"))
        cuts = pieces(F.col("n"), threshold)
        without = [F.when(F.col("j") == j, F.concat(F.substr("rest", F.lit(1), at - 1), F.substr("rest", at + n))) for j, (_, _, at, n) in enumerate(cuts)]
        many = many.withColumn("rest", F.coalesce(*without)).withColumn("n", F.char_length("rest"))
        less = lambda j: F.element_at(F.array(*[F.lit(x) for x, _, _ in combos(threshold)]), F.col(j) + 1)
        ended = F.col("n") - less("j") <= threshold
        out.append(met(many.where(F.col("own") & ended), many.where(ended), threshold))
        again = [F.when(other > threshold, F.struct(F.xxhash64("key", other, i, F.substr("rest", at, n)).alias("key"), F.lit(j).cast("byte").alias("j"))) for j, (other, i, at, n) in enumerate(cuts)]
        new = many.where(~ended).select(F.col("j").alias("before"), F.explode(F.array(*again)).alias("x"), "k", "q", "own", "counts", "rest").where("x IS NOT NULL")
        # What is longer than its index rows by some characters stays so.
        new = new.select("before", "x.key", "x.j", "k", "q", (F.col("own") & (F.col("x.j") <= threshold)).alias("own"), "counts", "rest").where(less("before") == less("j"))
        rows = stored(new.drop("before"), "lines-rows")


def near_lines(docs: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """(k, q) of lines to which an earlier one, of the candidate pairs, is near."""
    places = pairs.select("k", "q").unionByName(pairs.select(F.col("ek").alias("k"), F.col("eq").alias("q")))
    texts = at_places(docs, places, 2 * pairs.count()).withColumn("counts", letter_counts(F.col("line")))
    early = texts.select(F.col("k").alias("ek"), F.col("q").alias("eq"), F.col("line").alias("eline"), F.col("counts").alias("ecounts"))
    both = pairs.join(texts, ["k", "q"]).join(early, ["ek", "eq"]).where(count_difference(F.col("counts"), F.col("ecounts")) <= 2 * threshold)
    longer = F.greatest(F.char_length("line"), F.char_length("eline"))
    apart = let(trimmed(F.col("line"), F.col("eline"), threshold), lambda c: banded_distance(c["a"], c["b"], threshold))
    near = let(apart, lambda d: (d <= threshold) & (d * PER_EDIT <= longer))
    return both.where(near).select("k", "q").distinct()


def kept_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` (k, z, box) with ``n_lines`` and ``kept``, the lines of the text that stay, in order."""
    if not 1 <= threshold < PER_EDIT - 1:
        raise ValueError(f"a threshold is 1 to {PER_EDIT - 2}: near lines have more characters than that")
    table = found(docs, threshold)
    tidy(docs.sparkSession)  # its shuffles are larger than the input
    pairs = table.where(F.col("kind") == PAIR).select("k", "q", "ek", "eq")
    pairs = stored(packed(reduce(DataFrame.unionByName, [pairs, *among_many(docs, table, threshold)]).distinct(), docs), "lines-pairs")
    firsts = table.where(F.col("kind") == FIRST).select("k", "q")
    stay = firsts.join(near_lines(docs, pairs, threshold), ["k", "q"], "left_anti").groupBy("k", (F.col("q") >= NO_ID).alias("z")).agg(F.sort_array(F.collect_list("q")).alias("stay"))
    joined = docs.join(stay.hint("shuffle_hash"), ["k", "z"], "left").withColumn("text", text_of())
    place = lambda q: (q.bitwiseAND(F.lit(NO_ID - 1)) + 1).cast("int")
    lines = let(F.split("text", "\n"), lambda own: F.struct(F.size(own).alias("n"), F.filter(F.transform(F.coalesce("stay", F.array().cast("array<bigint>")), lambda q: F.try_element_at(own, place(q))), lambda x: x.isNotNull()).alias("kept")))
    out = joined.withColumn("own", F.when(F.col("text").isNotNull(), lines))
    return out.select("box", "text", F.coalesce("own.n", F.lit(0)).alias("n_lines"), F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.coalesce("own.kept", F.array().cast("array<string>"))).alias("kept"))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_removed, kept_sha256 (of the lines that stay, joined by newlines)."""
    out = kept_lines(keyed(docs.select(id_col, text_col), id_col, text_col), **options)
    return out.select(
        F.element_at("box", 1)["id"].alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"),
        (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


def clean(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the lines that stay as ``text``, and ``n_chars`` to match; documents that lose all their lines go."""
    out = kept_lines(keyed(docs, "doc_id", "text"), **options).where((F.size("kept") > 0) | F.col("text").isNull())
    new = {"text": F.when(F.col("text").isNotNull(), F.array_join("kept", "\n"))}
    rest = lambda c: F.element_at("box", 1)["rest"][c]
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text").isNull(), rest("n_chars")).otherwise(F.char_length(new["text"])).cast(dict(docs.dtypes)["n_chars"])
    # Generated columns aren't merged into what reads them, so a Python function over the text isn't handed the lambdas above.
    return out.select(F.inline(F.array(F.struct(*[(new[c] if c in new else rest(c)).alias(c) for c in docs.columns]))))


#: All pairs of first lines of similar length. DuckDB's distance counts bytes, of which a character has four at most, so it
#: only bounds; what is left of a pair when equal ends are taken off is then compared by characters: with one or two
#: edits, the first and the last of what is left take part in one each.
SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS s FROM d),
f AS (SELECT s, r[1] AS doc_id, r[2] AS p FROM (SELECT s, min([doc_id, p]) AS r FROM x GROUP BY s)),
q AS (SELECT s, doc_id, p, length(s) AS n FROM f),
c AS (SELECT a.s AS s, b.s AS t, a.n AS n, b.n AS m, least(2, greatest(a.n, b.n) // 5) AS e FROM q a JOIN q b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND [a.doc_id, a.p] > [b.doc_id, b.p]
 WHERE levenshtein(a.s, b.s) <= 4 * least(2, greatest(a.n, b.n) // 5)),
h AS (SELECT *, len(list_filter(range(1, least(n, m) + 1), lambda i: substr(s, 1, i) = substr(t, 1, i))) AS pre FROM c WHERE e > 0),
g AS (SELECT *, len(list_filter(range(1, least(n, m) - pre + 1), lambda i: substr(s, n - i + 1, i) = substr(t, m - i + 1, i))) AS suf FROM h),
u AS (SELECT s, e, substr(s, pre + 1, n - pre - suf) AS a, substr(t, pre + 1, m - pre - suf) AS b, n - pre - suf AS n, m - pre - suf AS m FROM g),
z AS (SELECT s, e, CASE WHEN greatest(n, m) <= 1 THEN 1 WHEN greatest(n, m) = 2 THEN 2
 WHEN n >= 2 AND m >= 2 AND substr(a, 2, n - 2) = substr(b, 2, m - 2) THEN 2
 WHEN n >= 2 AND (substr(a, 2, n - 2) = b OR (m >= 1 AND (substr(a, 2, n - 2) = substr(b, 2) OR substr(a, 2, n - 2) = substr(b, 1, m - 1)))) THEN 2
 WHEN m >= 2 AND (substr(b, 2, m - 2) = a OR (n >= 1 AND (substr(b, 2, m - 2) = substr(a, 2) OR substr(b, 2, m - 2) = substr(a, 1, n - 1)))) THEN 2
 WHEN n >= 1 AND m >= 1 AND (substr(a, 2) = substr(b, 1, m - 1) OR substr(a, 1, n - 1) = substr(b, 2)) THEN 2 ELSE 3 END AS w FROM u),
v AS (SELECT DISTINCT s FROM z WHERE w <= e),
k AS (SELECT doc_id, count(*) AS n, string_agg(s, chr(10) ORDER BY p) AS t FROM f WHERE s NOT IN (SELECT s FROM v) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CASE WHEN l = [''] THEN 0 ELSE CAST(len(l) - coalesce(k.n, 0) AS BIGINT) END AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
