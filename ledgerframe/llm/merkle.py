"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves, in DataFrame operations only.

Blank lines part sections, newlines part paragraphs, and a paragraph's leaves are its matches of ``LEAF``,
one rule for texts of any length: a leaf ends where what it holds says so, so leaves behind an insertion are
those they were. A paragraph's digest covers its leaves' hashes, a section's its paragraphs', and the root
(SHA-256, 128 bits kept) its sections'; below the root, a fingerprint has 32 bits of each digest. So equal roots
mean equal texts, and to locate an edit one goes down the differing branches only. A fingerprint is
``root/section:paragraph.leaf.leaf,paragraph...;section...`` in hex.

The likeness of two fingerprints is the larger of two shares of leaves, and is 1 for equal ones. For the first,
the trees are held side by side: a branch whose digest is the same at the same place counts with all its leaves, a
differing one is entered. For the second, places don't matter, and repeats of a branch count once: sections that
the other tree has anywhere count, the others are entered; so with their paragraphs; and with the leaves
of what paragraphs are left. Each share is twice the number of leaves found over the sum of both numbers. The
first survives repeats, the second insertions. ``changed`` has the places of differing paragraphs, found by the same descent.

Defined results: a null text is taken as an empty one, which has a root and one empty paragraph without leaves;
in the order of documents a null id comes last, and rows with one id go by a hash of their texts, so of repeated
rows each but the last has its own text for the next; extra columns aren't touched; ids are of any type that has an order;
a text of any length is one tree, held by one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored

#: A leaf ends after a word of five characters or more and its space; if none ends in time, before a character that comes
#: again four places on (short words, scripts without spaces); and at 32 characters at the latest.
LEAF = r"[^\n]{6,24}?(?<=\S{5}\s)|[^\n]{6,32}?(?=(\S)[^\n]{3}\1)|[^\n]{1,32}"
#: Bits of a digest that a fingerprint has.
BITS = 0xFFFFFFFF


def tree(text: Column) -> Column:
    """array<struct<hash, paragraphs array<struct<hash, leaves array<long>>>>>: sections of paragraphs of leaf hashes."""

    def paragraph(p):
        leaves = F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.xxhash64(x))
        return let(leaves, lambda own: F.struct(F.xxhash64(own).alias("hash"), own.alias("leaves")))

    def section(s):
        return let(F.transform(F.split(s, "\n"), paragraph), lambda own: F.struct(F.xxhash64(F.transform(own, lambda p: p["hash"])).alias("hash"), own.alias("paragraphs")))

    return F.transform(F.split(text, "\n\n"), section)


def root(sections: Column) -> Column:
    return F.substr(F.sha2(F.array_join(F.transform(sections, lambda s: F.hex(s["hash"])), ".").cast("binary"), 256), F.lit(1), F.lit(32))


def short(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(BITS)))), 8, "0")


def fingerprint(sections: Column) -> Column:
    def paragraph(p):
        return F.concat_ws(".", short(p["hash"]), F.array_join(F.transform(p["leaves"], short), "."))

    def section(s):
        return F.concat(short(s["hash"]), F.lit(":"), F.array_join(F.transform(s["paragraphs"], paragraph), ","))

    return F.concat(root(sections), F.lit("/"), F.array_join(F.transform(sections, section), ";"))


def digests(sections: Column) -> Column:
    """A tree as its fingerprint has it, with the number of leaves below each branch: array<struct<d, n, ps array<struct<d, n, ls array<long>>>>>."""
    kept = lambda h: h.bitwiseAND(F.lit(BITS))

    def paragraph(p):
        return F.struct(kept(p["hash"]).alias("d"), F.size(p["leaves"]).alias("n"), F.transform(p["leaves"], kept).alias("ls"))

    def section(s):
        own = F.transform(s["paragraphs"], paragraph)
        return F.struct(kept(s["hash"]).alias("d"), F.aggregate(s["paragraphs"], F.lit(0), lambda n, p: n + F.size(p["leaves"])).alias("n"), own.alias("ps"))

    return F.transform(sections, section)


def total(branches: Column) -> Column:
    return F.aggregate(branches, F.lit(0), lambda n, b: n + b["n"])


def side_by_side(a: Column, b: Column) -> Column:
    """The number of leaves with equal digests at equal places of two trees; equal branches aren't entered."""
    none = F.lit(0)

    def leaves(x, y):
        return F.size(F.filter(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), lambda e: e))

    def branch(x, y, below):
        return F.when(x["d"] == y["d"], x["n"]).otherwise(F.when(x.isNotNull() & y.isNotNull(), below(x, y)).otherwise(none))

    def added(xs):
        return F.aggregate(xs, F.lit(0), lambda n, m: n + F.coalesce(m, none))

    paragraph = lambda x, y: branch(x, y, lambda p, q: leaves(p["ls"], q["ls"]))
    section = lambda x, y: branch(x, y, lambda p, q: added(F.zip_with(p["ps"], q["ps"], paragraph)))
    return added(F.zip_with(a, b, section))


def anywhere(a: Column, b: Column) -> Column:
    """struct<same, all>: leaves of distinct branches that both trees have, and twice those with the distinct leaves of what is left of both."""

    def parted(x, y, below):
        """Of the branches of one level of both trees: leaves of those in common, and what stands below the others."""
        digest = lambda xs: F.transform(xs, lambda e: e["d"])

        def odd(own, other, common):
            # Whichever list is shorter says what is entered.
            pick = lambda only: F.when(F.size(only) == 0, F.slice(own, 1, 0)).when(F.size(common) <= F.size(only), F.filter(own, lambda e: ~F.array_contains(common, e["d"]))).otherwise(F.filter(own, lambda e: F.array_contains(only, e["d"])))
            return let(F.array_except(digest(own), digest(other)), pick)

        def of(common):
            once = F.array_distinct(F.transform(F.filter(x, lambda e: F.array_contains(common, e["d"])), lambda e: e["d"] * F.lit(1 << 31) + e["n"]))
            same = F.when(F.size(common) == 0, F.lit(0)).otherwise(F.aggregate(once, F.lit(0), lambda n, e: n + (e % (1 << 31)).cast("int")))
            lower = lambda own, other: F.flatten(F.transform(odd(own, other, common), lambda e: e[below]))
            return F.struct(same.alias("same"), lower(x, y).alias("x"), lower(y, x).alias("y"))

        return let(F.array_intersect(digest(x), digest(y)), of)

    def of_leaves(same, x, y):
        return F.struct((same + F.size(F.array_intersect(x, y))).alias("same"), (2 * same + F.size(F.array_distinct(x)) + F.size(F.array_distinct(y))).alias("all"))

    return let(parted(a, b, "ps"), lambda s: let(parted(s["x"], s["y"], "ls"), lambda p: of_leaves(s["same"] + p["same"], p["x"], p["y"])))


def likeness(a: Column, b: Column) -> Column:
    """Of two trees of digests."""
    share = lambda free: F.when(free["all"] > 0, 2.0 * free["same"] / free["all"]).otherwise(F.lit(0.0))
    return let(total(a) + total(b), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(2.0 * side_by_side(a, b) / n, let(anywhere(a, b), share))))


def changed(a: Column, b: Column) -> Column:
    """Places (section, paragraph), from 0, at which two trees of digests differ; sections with equal digests aren't entered."""
    place = "array<struct<section:int,paragraph:int>>"
    differ = lambda x, y: ~F.coalesce(x["d"].eqNullSafe(y["d"]), F.lit(False))

    def paragraphs(x, y, i):
        pairs = F.zip_with(F.coalesce(x["ps"], F.slice(y["ps"], 1, 0)), F.coalesce(y["ps"], F.slice(x["ps"], 1, 0)), differ)
        found = F.transform(pairs, lambda e, j: F.when(e, F.struct(i.alias("section"), j.alias("paragraph"))))
        return F.filter(found, lambda e: e.isNotNull()).cast(place)

    def section(e, i):
        return F.when(differ(e["x"], e["y"]), paragraphs(e["x"], e["y"], i)).otherwise(F.array().cast(place))

    return F.flatten(F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), section))


KEY = ["z", "id", "h", "g"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(z, id, h, g, text): whether the id is null, the id (in a struct, where nulls are equal), and two hashes of the text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.select(F.col("i").isNull().alias("z"), F.struct(F.col("i").alias("id")).alias("id"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit("text"), "text").alias("g"), "text")


def following(keys: DataFrame) -> DataFrame:
    """Distinct ``keys`` (z, id, h, g), each with the next one in order as ``next``; after the last comes the first.

    They are sorted by ranges, whose numbers are stored, so that whoever reads them again reads the same ones. Only the
    first key of each range crosses to the range before; there are as many ranges as shuffle partitions.
    """
    ranges = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(keys.repartitionByRange(ranges, *KEY).withColumn("part", F.spark_partition_id()), "ids")
    key = F.struct(*KEY)
    own = placed.withColumn("next", F.lead(key).over(Window.partitionBy("part").orderBy(*KEY)))
    heads = placed.groupBy("part").agg(F.min(key).alias("head")).withColumn("one", F.lit(1))
    turn = Window.partitionBy("one").orderBy("part")
    around = heads.select("part", F.coalesce(F.lead("head").over(turn), F.first("head").over(turn)).alias("head"))
    return own.join(around, "part").select(*KEY, F.coalesce("next", "head").alias("next"))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, next): each document's text and that of the next by id; after the last comes the first.

    Only ids and hashes are sorted. Repeated rows are counted first; then texts are shuffled by id and hash, once
    for both sides of a pair, and once more to meet the one before.
    """
    rows = keyed(docs, id_col, text_col)
    # The box keeps both readers of the texts to one exchange.
    texts = rows.groupBy(*KEY).agg(F.max("text").alias("text"), F.count("*").alias("copies")).select(*KEY, F.array(F.struct("text", "copies")).alias("box"))
    pairs = following(rows.select(*KEY).distinct())
    after = texts.select(*[F.col(c).alias(f"n{c}") for c in KEY], F.element_at("box", 1)["text"].alias("next_text"))
    met = pairs.select(*KEY, *[F.col(f"next.{c}").alias(f"n{c}") for c in KEY]).join(after, [f"n{c}" for c in KEY]).select(*KEY, "next_text")
    both = texts.join(met, KEY).select(F.col("id.id").alias("doc_id"), F.element_at("box", 1)["text"].alias("text"), F.element_at("box", 1)["copies"].alias("copies"), "next_text")
    # Of repeated rows each but the last is followed by itself.
    last = F.struct(F.col("next_text").alias("next"), F.lit(1).cast("long").alias("times"))
    turns = F.when(F.col("copies") > 1, F.array(F.struct(F.col("text").alias("next"), (F.col("copies") - 1).alias("times")), last)).otherwise(F.array(last))
    return both.select("doc_id", "text", F.inline(turns))


def compare(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: what :func:`report` returns, and ``changed``, where the edited text's tree differs."""
    rows = with_next(docs, id_col, text_col)
    n = F.char_length("text")
    edit = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - edit), F.substr("next", F.lit(1), edit))

    def both(cells):
        a, b, c = (cells[f"t{i}"] for i in range(3))
        return let(F.struct(*[digests(x).alias(f"d{i}") for i, x in enumerate((a, b, c))]), lambda own: F.struct(
            fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"), likeness(own["d0"], own["d1"]).alias("near_edited"),
            likeness(own["d0"], own["d2"]).alias("near_next"), changed(own["d0"], own["d1"]).alias("changed"),
        ))

    texts = let(F.struct(F.col("text").alias("s0"), edited.alias("s1"), F.col("next").alias("s2")), lambda s: F.struct(
        F.sha2(s["s1"].cast("binary"), 256).alias("edited_sha256"), let(F.struct(*[tree(s[f"s{i}"]).alias(f"t{i}") for i in range(3)]), both).alias("r"),
    ))
    out = rows.select("doc_id", n.cast("long").alias("n_chars"), "times", texts.alias("x"))
    out = out.select("doc_id", "n_chars", "times", "x.edited_sha256", "x.r.*")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("copy", "times")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: its fingerprint, that of its edited text, likenesses to the edited and the next text, and how many paragraphs the edit changes."""
    return compare(docs, **options).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.size("changed").cast("long").alias("n_changed"))
