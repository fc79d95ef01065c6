"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import packed, release, shared_folder, stored  # noqa: F401


def shared(spark: SparkSession) -> str:
    """The folder all executors share, also as the folder of checkpoints."""
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder; Spark removes it if told to clean checkpoints."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now: it does once nothing on the driver refers to them any more, and
    that shows only when garbage is collected. What Python lets go of in the first round goes in the second."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, whatever the optimizer merges."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sha_hex(col: Column) -> Column:
    return F.sha2(col, 256)


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case, every other character unchanged."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes of a word in lower case, and a space for every byte between words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case; null has none."""
    return text.translate(FOLD).split() if text else []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
