"""Chat formatting after a collapse of cumulative snapshots.

Logs often hold a conversation several times, as it grew. A rolling hash of each prefix of turns is a
running sum of turn hashes, each hashed with its place; a conversation whose last prefix hash is some
longer conversation's prefix hash is a snapshot of it. Two anti-joins retain, of equal conversations, that
with the smallest id, and conversations that no longer one begins with. Those are rendered.

Defined results: turns go by ``turn``, then role and text; null roles are rendered as ``user`` and null
texts as empty ones, but they differ from those in the hashes; rows repeated in full count once;
conversations with a null id are one conversation; two 128-bit hashes that are equal stand for equal prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text), each once, with its place from 1 and its prefix's hashes ``a`` and ``b``."""
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    placed = rows.withColumn("place", F.row_number().over(order))
    # xxhash64 passes over nulls, so whether a cell is null is hashed too.
    cells = [F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    wide = "decimal(38,0)"
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    part = lambda salt: F.sum(F.xxhash64(F.lit(salt), *cells).cast(wide)).over(so_far)
    return placed.withColumn("a", part(1)).withColumn("b", part(2))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, length, copies) of the conversations that stay; ``copies`` counts the equal ones, itself included."""
    own = prefixes(turns)
    whole = own.groupBy("conv_id").agg(F.max_by(F.struct("a", "b"), "place").alias("h"), F.max("place").alias("length"))
    # Equal conversations meet in partial aggregates, so a conversation that a third are equal to is one row.
    distinct = whole.groupBy("h", "length").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    begun = own.join(whole.select(F.col("conv_id").alias("c"), "length"), F.col("conv_id").eqNullSafe(F.col("c"))).where("place < length")
    inner = begun.groupBy(F.struct("a", "b").alias("h"), F.col("place").alias("length")).agg(F.lit(1).alias("one")).drop("one")
    return distinct.join(inner, ["h", "length"], "left_anti").select("conv_id", "length", "copies")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END + "\n"))


def render(turns: DataFrame) -> DataFrame:
    """One row for each conversation that stays: conv_id, n_turns, copies and its turns as one chat text."""
    keep = maximal(turns).withColumnRenamed("conv_id", "kept_id")
    own = turns.select("conv_id", "turn", "role", "text").distinct().join(keep, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    # A conversation is one training text, so its turns meet in one row by need.
    turn = F.struct(F.col("turn").isNull().alias("n"), "turn", "role", "text")
    return own.groupBy("conv_id").agg(F.max("length").cast("long").alias("n_turns"), F.max("copies").alias("copies"), F.sort_array(F.collect_list(turn)).alias("turns")).select(
        "conv_id", "n_turns", "copies", F.array_join(F.transform("turns", lambda t: rendered(t.role, t.text)), "").alias("chat")
    )


def report(turns: DataFrame) -> DataFrame:
    return render(turns).select("conv_id", "n_turns", "copies", "chat")


SQL = f"""
WITH o AS (SELECT conv_id, list({{'t': turn, 'r': role, 'x': text}} ORDER BY turn, role, text) AS l FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY conv_id),
k AS (SELECT conv_id, l, list_transform(l, lambda t: {{'r': t.r, 'x': t.x}}) AS s FROM o),
p AS (SELECT DISTINCT s[1:i] AS s FROM (SELECT s, unnest(range(1, len(s))) AS i FROM k)),
u AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, s FROM k GROUP BY s)
SELECT conv_id, CAST(len(s) AS BIGINT) AS n_turns, copies, array_to_string(list_transform(s, lambda t: '{BEGIN}' || t.r || chr(10) || t.x || '{END}' || chr(10)), '') AS chat FROM u WHERE s NOT IN (SELECT s FROM p)
"""
