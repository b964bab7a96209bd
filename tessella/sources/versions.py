"""Sets of tables that change together: a log of snapshots, written by put-if-absent.

Rows lie in folders of Parquet files, one for each write and table, partitioned by a bucket of their document. A commit is
one small file that names the folders in force of every table; it is moved into place whole, and only if no other
commit has its number. A writer that dies before that leaves the snapshot before in force, and its folders unread.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.scratch import Tables

BUCKETS = 16
#: Times that a commit is tried again when another writer was first.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer has committed the same version."""


class Versions:
    """The versions of a set of tables in a folder; ``keys`` names each table's column of its document."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root, keys, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    # --- the log

    def _path(self, *names: str):
        return self._hadoop.Path("/".join((self.root, *names)))

    def _files(self):
        return self._path().getFileSystem(self._conf)

    def latest(self) -> int:
        """The number of the newest commit; 0 without any."""
        log = self._path("log")
        if not self._files().exists(log):
            return 0
        return max((int(s.getPath().getName().split(".")[0]) for s in self._files().listStatus(log) if s.getPath().getName().endswith(".json")), default=0)

    def snapshot(self, version: int | None = None) -> dict:
        """The commit of a version: per table the folders in force and the schema."""
        number = self.latest() if version is None else version
        if number == 0:
            return {"tables": {}}
        text = self.spark.read.text(f"{self.root}/log/{number:020d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def commit(self, number: int, snapshot: dict) -> int:
        """Put a commit in place whole, if its number is still free; else ``Conflict``."""
        draft, place = self._path("drafts", uuid.uuid4().hex), self._path("log", f"{number:020d}.json")
        files = self._files()
        files.mkdirs(place.getParent())
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(snapshot).encode()))
        out.close()
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        options[0] = none
        try:
            self._hadoop.FileContext.getFileContext(self._path().toUri(), self._conf).rename(files.makeQualified(draft), files.makeQualified(place), options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            files.delete(draft, False)
            raise Conflict(f"version {number} is taken") from None
        return number

    def _change(self, change: Callable[[dict], dict | None]) -> int:
        """Commit what ``change`` makes of the newest snapshot, again from the start where another writer is first."""
        for _ in range(TRIES):
            number = self.latest()
            changed = change(self.snapshot(number))
            if changed is None:
                return number
            try:
                return self.commit(number + 1, changed)
            except Conflict:
                continue
        raise Conflict("other writers were always first")

    # --- rows

    def _write(self, name: str, rows: DataFrame) -> str:
        """Rows as a folder that no snapshot names yet."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.col(self.keys[name]).cast("string")), F.lit(self.buckets)).cast("int"))
        bucketed.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        return folder

    def _buckets(self, folder: str) -> list[str]:
        found = self._files().listStatus(self._path(folder))
        return sorted(f"{folder}/{s.getPath().getName()}" for s in found if s.getPath().getName().startswith("_bucket="))

    def load(self, tables: dict[str, DataFrame]) -> int:
        """Add rows to several tables in one commit: readers see all of them or none."""
        written = {name: self._buckets(self._write(name, rows)) for name, rows in tables.items()}

        def change(snapshot: dict) -> dict:
            held = dict(snapshot["tables"])
            for name, folders in written.items():
                before = held.get(name, {"folders": []})
                held[name] = {"schema": json.loads(tables[name].schema.json()), "folders": before["folders"] + folders}
            return {"tables": held}

        return self._change(change)

    def delete(self, doomed: DataFrame) -> int:
        """Drop the documents of a one-column frame from every table, in one commit.

        Only folders of buckets that hold a doomed document are written anew. Rows without a document stay.
        """
        with Tables(self.spark) as scratch:
            keys = scratch.keep(doomed.select(F.col(doomed.columns[0]).alias("_doomed")).where("_doomed IS NOT NULL").distinct(), "doomed")
            bucket = F.pmod(F.xxhash64(F.col("_doomed").cast("string")), F.lit(self.buckets))
            hit = {f"_bucket={r[0]}" for r in keys.select(bucket.cast("int")).distinct().collect()}  # at most ``buckets`` rows
            rewritten: dict[tuple, list[str]] = {}

            def change(snapshot: dict) -> dict | None:
                held = {}
                for name, table in snapshot["tables"].items():
                    old = [f for f in table["folders"] if f.rsplit("/", 1)[1] in hit]
                    stays = [f for f in table["folders"] if f not in set(old)]
                    if old and (name, *old) not in rewritten:
                        rows = self._rows(table["schema"], old)
                        left = rows.join(keys, rows[self.keys[name]] == keys["_doomed"], "left_anti")
                        rewritten[name, *old] = self._buckets(self._write(name, left))
                    held[name] = table | {"folders": stays + rewritten.get((name, *old), [])}
                return {"tables": held} if hit else None

            return self._change(change)

    def _rows(self, schema: dict, folders: list[str]) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(schema)
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the newest one unless given."""
        table = self.snapshot(version)["tables"].get(name)
        if table is None:
            raise KeyError(f"no table {name} in this version")
        return self._rows(table["schema"], table["folders"])

    def vacuum(self) -> int:
        """Delete folders that the newest snapshot does not name; their number. Only while no writer and no older reader is at work."""
        live = {f.rsplit("/", 1)[0] for t in self.snapshot()["tables"].values() for f in t["folders"]}
        files, gone = self._files(), 0
        for name in self.keys:
            if files.exists(self._path("data", name)):
                for status in files.listStatus(self._path("data", name)):
                    if f"data/{name}/{status.getPath().getName()}" not in live:
                        gone += files.delete(status.getPath(), True)
        return gone
