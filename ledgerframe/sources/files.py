"""Small files through Spark's own file systems, so any store that Spark reads will do."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import CommitConflict, SourceUnreadable

#: Schemes of stores without a rename in one step.
OBJECT_STORES = ("s3", "s3a", "s3n", "gs", "abfs", "abfss", "wasb", "wasbs", "oss")

class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._path(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._path(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> None:
        """Creates the file whole or not at all; another writer's file of that name is a conflict.

        The text is written aside and then takes its name, in one step that never overwrites: a hard link on a local
        disk, a rename without overwriting on HDFS and its like. Object stores show a file only once it is
        closed, and are asked to create it only if there is none; a store that can't is refused.
        """
        fs, p = self._path(path)
        scheme = fs.getUri().getScheme()
        if scheme in OBJECT_STORES:
            self._create_if_absent(fs, p, text)
            return
        aside = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{uuid.uuid4().hex}.tmp")
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if scheme == "file":
                local = lambda x: self.jvm.java.io.File(x.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(p), local(aside))
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
                options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(aside, p, options)
        except Exception as e:
            if fs.exists(p):
                raise CommitConflict(f"{path} is there already") from e
            raise
        finally:
            fs.delete(aside, False)

    def _create_if_absent(self, fs, p, text: str) -> None:
        try:
            stream = fs.createFile(p).overwrite(False).must("fs.option.create.conditional.overwrite", "true").build()
            try:
                stream.write(bytearray(text.encode()))
            finally:
                stream.close()
        except Exception as e:
            if fs.exists(p):
                raise CommitConflict(f"{p} is there already") from e
            raise SourceUnreadable(f"{p} can't be created on condition that it isn't there: {e}") from e

    def replace(self, path: str, text: str) -> None:
        fs, p = self._path(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        fs, p = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def parquet(self, folder: str) -> list[str]:
        fs, p = self._path(folder)
        return sorted(str(s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")) if fs.exists(p) else []

    def modified_us(self, path: str) -> int:
        fs, p = self._path(path)
        return fs.getFileStatus(p).getModificationTime() * 1000

    def delete(self, path: str) -> None:
        fs, p = self._path(path)
        fs.delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``. Only a local session does without: one folder is all it has."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise SourceUnreadable("spark.checkpoint.dir isn't set: on a cluster it names the folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="ledgerframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def packed(df: DataFrame, like: DataFrame | None = None, mb: int = 8) -> DataFrame:
    """``df`` in no more partitions than four for each core, or one for so many megabytes of ``like`` (default: itself), whichever is more.

    So a small table that was dealt to many partitions doesn't become as many small files. Sizes are the plan's own; nothing is
    shuffled, and a large table stays as it is.
    """
    size = int(str((like or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-size // (mb << 20))), (1 << 31) - 1))


def stored(df: DataFrame, name: str, block_mb: int = 16) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a lost executor costs no recomputation.

    The files go when the driver ends, or by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = Files(spark)._path(path)
    fs.deleteOnExit(p)
    df.write.option("parquet.block.size", block_mb << 20).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of what :func:`stored` returned."""
    if getattr(df, "stored_at", None):
        Files(df.sparkSession).delete(df.stored_at)
