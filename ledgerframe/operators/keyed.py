"""Keyed views of a log: latest rows, running state, differences, cumulative budgets, as-of lookups."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import Files, stored


def latest(df: DataFrame, key: str, order: str, deleted: str | None = None) -> DataFrame:
    """The last row of each key, without keys whose last row is a deletion.

    ``max_by`` aggregates on the map side, so a key with a third of all rows is no hot spot.
    """
    rest = [c for c in df.columns if c != key]
    out = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
    return out.where(~F.col(deleted)) if deleted else out


def running(df: DataFrame, key: str, order: str, amount: Column, name: str) -> DataFrame:
    """``df`` with the running sum of ``amount`` within each key; streams through a sorted partition."""
    over = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(amount).over(over))


def difference(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose rows differ between two versions of a table, with both sides."""
    o, n = old.select(key, F.struct(*columns).alias("o")), new.select(key, F.struct(*columns).alias("n"))
    both = o.join(n, key, "full")
    return both.where(~F.col("o").eqNullSafe(F.col("n"))).select(key, *[F.col(f"o.{c}").alias(f"old_{c}") for c in columns], *[F.col(f"n.{c}").alias(f"new_{c}") for c in columns])


def budget(df: DataFrame, key: str, order: str, size: Column, max_bytes: int, max_rows: int) -> DataFrame:
    """Of each key's rows in order, those taken until bytes or rows reach their bound; the first is always taken."""
    over = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = df.withColumn("_b", F.coalesce(F.sum(size).over(over), F.lit(0))).withColumn("_n", F.count("*").over(over))
    return before.where(((F.col("_b") < max_bytes) & (F.col("_n") < max_rows)) | (F.col("_n") == 0)).drop("_b", "_n")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, name: str) -> DataFrame:
    """``left`` with the ``value`` of the last row of ``right`` with the same key at or before its ``time``.

    A union sorted by (key, time) and one running last value: no range join, so no product of rows.
    """
    cols = left.columns
    l = left.select(*cols, F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"))
    r = right.select(*[F.col(c) if c in (key, time) else F.lit(None).cast(t).alias(c) for c, t in left.dtypes], F.lit(0).alias("_side"), F.col(value).alias("_v"))
    over = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r).withColumn(name, F.last("_v", ignorenulls=True).over(over)).where("_side = 1").select(*cols, name)


def running_stream(df: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """``running`` on a stream of (key string, offset long, amount long): each key's sum is kept in the state store."""
    import pandas as pd
    from pyspark.sql import types as T
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    state = T.StructType([T.StructField("total", T.LongType())])

    class Running(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.total = handle.getValueState("total", state)

        def handleInputRows(self, k, rows, timerValues):
            total = self.total.get()[0] if self.total.exists() else 0
            got = pd.concat(list(rows)).sort_values("offset")
            sums = total + got["amount"].cumsum()
            self.total.update((int(sums.iloc[-1]),))
            yield pd.DataFrame({key: k[0], "offset": got["offset"], name: sums})

        def close(self) -> None:
            pass

    own = df.select(F.col(key).cast("string").alias(key), F.col("offset").cast("long").alias("offset"), F.col(amount).cast("long").alias("amount"))
    return own.groupBy(key).transformWithStateInPandas(Running(), f"{key} string, offset long, {name} long", outputMode="append", timeMode="none")


def upsert_into(path: str, key: str, order: str, buckets: int = 64):
    """For ``foreachBatch``: keeps the latest row of each key under ``path``, in immutable versions.

    Keys are dealt to buckets by hash, and a batch rewrites the buckets that it touches. A version is a record of its
    buckets' folders, written after them, whole or not at all; a batch that is tried again finds its record and changes nothing.
    Folders that none of the last two versions names are deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        files = Files(batch.sparkSession)
        done = _versions(files, path)
        if number in done:
            return
        before = _record(files, path, max((n for n in done if n < number), default=None))
        n = before["n"] or buckets
        bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
        rows = latest(batch, key, order).select(*batch.columns)
        rows = stored(rows.withColumn("_b", bucket), "upsert")
        touched = [r[0] for r in rows.select("_b").distinct().collect()]  # as many as buckets at most
        old = [before["folders"][str(b)] for b in touched if str(b) in before["folders"]]
        if old:
            rows = rows.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(*old).withColumn("_b", bucket))
        folder = f"{path}/data/{number:08d}-{uuid.uuid4().hex}"
        kept = latest(rows, key, order).select(*batch.columns, "_b")
        kept.repartition("_b").write.partitionBy("_b").parquet(folder)
        folders = before["folders"] | {str(b): f"{folder}/_b={b}" for b in touched}
        files.write_new(f"{path}/versions/{number:08d}.json", json.dumps({"n": n, "folders": folders}))
        for older in [x for x in done if x < number][:-1]:
            for gone in set(_record(files, path, older)["folders"].values()) - set(folders.values()) - set(before["folders"].values()):
                files.delete(gone)
            files.delete(f"{path}/versions/{older:08d}.json")

    return write


def _versions(files: Files, path: str) -> list[int]:
    return sorted(int(x.removesuffix(".json")) for x in files.names(f"{path}/versions") if re.fullmatch(r"\d{8,}\.json", x))


def _record(files: Files, path: str, number: int | None) -> dict:
    return {"n": None, "folders": {}} if number is None else json.loads(files.read(f"{path}/versions/{number:08d}.json"))


def materialized(spark, path: str, schema, deleted: str | None = None) -> DataFrame:
    """The newest version that :func:`upsert_into` has finished, without deleted keys; no rows before the first."""
    files = Files(spark)
    folders = list(_record(files, path, max(_versions(files, path), default=None))["folders"].values())
    df = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    return df.where(~F.col(deleted)) if deleted else df


def lag_histogram(df: DataFrame, sent: str, stored: str, bounds: list[float]) -> DataFrame:
    """Rows by seconds from ``sent`` to ``stored`` (microseconds): one row for each upper bound and one beyond."""
    seconds = (F.col(stored) - F.col(sent)) / 1e6
    slot = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        slot = F.when(seconds <= bounds[i], i).otherwise(slot)
    top = F.element_at(F.array(*[F.lit(float(b)) for b in bounds], F.lit(None).cast("double")), F.col("slot") + 1)
    return df.groupBy(slot.alias("slot")).agg(F.count("*").alias("rows")).select(top.alias("up_to"), "rows")


def pairs_in_range(df: DataFrame, key: str, value: str, width: int, name: str) -> DataFrame:
    """(value, ``name``): the pairs of rows of one key whose values, integers, are no more than ``width`` apart, counted by the first one's.

    Rows are counted first and pairs are products of counts, so no pair of rows is made: the work follows the distinct values.
    """
    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    near = counts.select(F.col(key).alias("_k"), F.explode(F.sequence(F.col(value).cast("long") - width, F.col(value).cast("long") + width)).alias("_v"), F.col("_n").alias("_m"))
    met = counts.join(near, (F.col(key) == F.col("_k")) & (F.col(value).cast("long") == F.col("_v")))
    return met.groupBy(value).agg(F.sum(F.col("_n") * F.col("_m")).alias(name))
