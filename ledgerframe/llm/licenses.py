"""License scans by diagonal voting, in DataFrame operations only.

A text (A-Z in lower case) has words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Hashes of all its rolling
two-word runs are joined with the places of those runs in templates. A match at word p of the text and
word q of a template votes for the diagonal p - q; votes are counted by text, template and diagonal,
diagonals that neighbour each other (words put in or left out) merge, and a span counts if the template
places it hits, where the words themselves are the same, cover enough of the template and it isn't much longer than the template. Enough is a share of
its two-word runs, or the same share of the words in them if those that name the license (words of its label)
are all there: one word replaced or left out kills two runs, which a short template can't spare.

The three base phrases are templates that must be hit in full on one diagonal: that is a place where
their words stand consecutively. The method adds labels of longer license sentences.

A span gives way to one of another template that overlaps it and has a larger share. Defined results: null and empty texts
have no words and no labels; repeated rows are each reported; texts of any length are scanned whole, and spans
are compared with those near them only; ties stay both; other columns aren't touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, lower_ascii

WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Phrases that must be found word for word, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: License sentences that the method looks for, with their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Neighbouring diagonals this far apart merge.
GAP = 2
COVER = 0.75


def word_list(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def template_rows(spark, base: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """(template, label, exact, length, names, place, gram, words) of every two-word run of every template; a fixed small table.

    ``names`` are the places of words that the label is made of.
    """
    cells = [(i, label, exact, phrase) for i, (phrase, label, exact) in enumerate([(p, x, True) for p, x in base.items()] + [(p, x, False) for p, x in templates.items()])]
    rows = spark.createDataFrame(cells, "template int, label string, exact boolean, phrase string").withColumn("w", F.split("phrase", " "))
    if any(len(p.split()) < 2 for p in [*base, *templates]):
        raise ValueError("a phrase needs two words")
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct((i - 1).alias("place"), F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1)).alias("gram"), F.slice("w", i, F.lit(2)).alias("words")))
    own = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains(F.split("label", "[-.]"), F.element_at("w", i + 1)))
    return rows.select("template", "label", "exact", F.size("w").alias("length"), own.alias("names"), F.inline(runs))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, cover: float = COVER, gap: int = GAP) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words and its verified spans (template, label, exact, first, past, share)."""
    spark = docs.sparkSession
    table = template_rows(spark, base, templates)
    # A row of its own (place -1) keeps each text through the join.
    sentinel = spark.createDataFrame([(-1, None, False, 0, [], 0, 0, [])], "template int, label string, exact boolean, length int, names array<int>, place int, gram long, words array<string>")

    def grams(w):
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.struct((i - 1).alias("at"), F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1)).alias("gram"), F.element_at(w, i).alias("a"), F.element_at(w, i + 1).alias("b")))
        kind = "array<struct<at:int,gram:bigint,a:string,b:string>>"
        own = F.array(F.struct((-1 - F.size(w)).alias("at"), F.lit(0).cast("long").alias("gram"), F.lit("").alias("a"), F.lit("").alias("b"))).cast(kind)
        return F.concat(own, F.when(F.size(w) > 1, runs.cast(kind)).otherwise(F.array().cast(kind)))

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = numbered.select("row", "doc_id", F.inline(let(word_list(F.col("text")), grams)))
    # The sentinel's gram is 0; a run that hashes to 0 by chance has a place from 0 and is kept apart.
    known = F.broadcast(table.unionByName(sentinel))  # the templates above: fixed, some hundred rows
    same = F.when(F.col("template") < 0, F.col("at") < 0).otherwise((F.col("at") >= 0) & (F.col("words")[0] == F.col("a")) & (F.col("words")[1] == F.col("b")))
    voted = rows.join(known, "gram").where(same).drop("a", "b", "words")
    diagonals = voted.groupBy("row", "doc_id", "template", "label", "exact", "length", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"), F.first("names").alias("names")
    )
    # Diagonals of one text and template are as many as its matches: no more than its words times the template's.
    turn = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(turn) > gap) | F.lag("diagonal").over(turn).isNull()
    merged = diagonals.withColumn("cluster", F.sum(F.when(apart, 1).otherwise(0)).over(turn))
    spans = merged.groupBy("row", "doc_id", "template", "label", "exact", "length", "cluster").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"), (F.max("last") + 2).alias("past"), F.min("diagonal").alias("diagonal"), F.first("names").alias("names")
    ).withColumn("hit", F.size("places")).withColumn("words", F.array_union("places", F.transform("places", lambda p: p + 1)))
    share = F.col("hit") / (F.col("length") - 1)
    worded = (F.size("words") / F.col("length") >= cover) & (F.size("names") > 0) & (F.size(F.array_except("names", "words")) == 0)
    good = F.when(F.col("exact"), F.col("hit") == F.col("length") - 1).otherwise(((share >= cover) | worded) & (F.col("past") - F.col("first") <= F.col("length") + 2 * gap))
    found = F.struct("template", "label", "exact", F.when(F.col("exact"), F.col("diagonal")).otherwise(F.col("first")).cast("long").alias("first"), F.col("past").cast("long").alias("past"), share.alias("share"))
    # Spans that overlap begin within a template's length of one another.
    reach = max(len(x.split()) for x in [*base, *templates]) + 2 * gap
    near = Window.partitionBy("row").orderBy("first").rangeBetween(-reach, reach)
    good = spans.select("row", "doc_id", "template", "diagonal", "first", F.when((F.col("template") >= 0) & good, found).alias("s"))
    others = good.withColumn("others", F.when(F.col("template") >= 0, F.collect_list("s").over(near)))
    beaten = F.exists("others", lambda t: ~t.exact & (t.template != F.col("s.template")) & (t["first"] < F.col("s.past")) & (F.col("s.first") < t.past) & (t.share > F.col("s.share")))
    stays = F.when(F.col("s").isNotNull() & (F.col("s.exact") | ~beaten), F.col("s"))
    return others.groupBy("row", "doc_id").agg(F.max(F.when(F.col("template") < 0, -1 - F.col("diagonal"))).cast("long").alias("n_words"), F.sort_array(F.collect_list(stays)).alias("spans")).select("doc_id", "n_words", "spans")


def report(docs: DataFrame, **options) -> DataFrame:
    rows = scan(docs, **options)
    own = F.filter("spans", lambda s: s.exact)
    label = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda s: s.label))), ",")
    return rows.select(
        "doc_id", "n_words", F.size(own).cast("long").alias("n_base"), F.array_min(F.transform(own, lambda s: s["first"])).alias("first_word"), F.array_max(F.transform(own, lambda s: s["first"])).alias("last_word"),
        label(own).alias("base_labels"), label(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s.share)), F.lit(0.0)).alias("score"),
    )


#: The columns of ``report`` that the base phrases alone decide.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
x AS (SELECT doc_id, len(w) AS n, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS c,
 list_filter(range(0, len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS g,
 list_filter(range(0, len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved') AS r FROM d),
y AS (SELECT *, list_concat(list_concat(c, g), r) AS a FROM x)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(a) AS BIGINT) AS n_base, CAST(list_min(a) AS BIGINT) AS first_word, CAST(list_max(a) AS BIGINT) AS last_word,
 array_to_string(list_filter([CASE WHEN len(c) > 0 THEN 'cc-by' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(r) > 0 THEN 'reserved' END], lambda s: s IS NOT NULL), ',') AS base_labels FROM y
"""
