"""A corpus pipeline over ``documents``: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, BPE.

``run`` writes each stage's result as Parquet to the shared folder and hands what it reads back to the next. A stage's
result has no more partitions than the size of its input calls for, so small inputs don't become many small files. All stages keep
columns of any name beside those of ``documents``, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerframe.llm import bpe, decontaminate, lines, simhash, toxicity
from ledgerframe.llm.common import documents, packed, release, stored
from ledgerframe.llm.queries import VOCABULARY, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half stay, null and empty texts by the score of a text without hits. The model learns from the labels of ``docs`` that aren't held out."""
    return packed(toxicity.clean(docs, table(spark, sf_dir, "labels")), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line goes if an earlier one is equal or near; a document goes if all its lines do. Null and empty texts stay as they are, repeated rows alike."""
    return packed(lines.clean(docs), docs)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of fingerprints reach from one another the one with the smallest id stays; of its repeated rows one. Null and empty texts are copies of one another."""
    return packed(simhash.one_each(docs), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of ten words of a benchmark item occurs go; those with null or empty texts stay."""
    return packed(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document that is left: its ids and decoded bytes as digests. A null text is encoded as an empty one."""
    import public_tokenizers

    return packed(bpe.report(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN), docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash_near_dedup", dedup_near_copies), ("decontamination", drop_leaks), ("bpe", encode)]

#: A learned score and fingerprints of 64-bit hashes are not SQL. A test computes the rows of ``run`` by plain Python, taking from the
#: model only the score of a text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns, stored; the files of each other stage go once the next one is stored."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return docs
