"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, a folder of this machine's is set, which only a session on one machine may use.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset; it has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessella-"))
    return context.getCheckpointDir()


class Tables:
    """Parquet tables in a folder of their own under the shared folder.

    A table that is read back has no lineage and the size statistics of its files, so executors may be lost and plans
    over many rounds stay short. The folder goes with ``close`` or at the end of a ``with`` block, else when the JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self._files, path = self._at(self.root)
        self._files.deleteOnExit(path)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of ``df``, written and read again."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete these tables: only those that no frame in use still reads."""
        for name in names:
            self._files.delete(self._at(f"{self.root}/{name}")[1], True)

    def close(self) -> None:
        self._files.delete(self._at(self.root)[1], True)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
