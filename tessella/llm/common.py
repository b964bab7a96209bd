"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a slot table, in rows of so many bytes: it has 8 MB of bits at most, whatever it is made of.
SLOTS = 2**26
SLOT_BYTES = 256
#: Rows that one bitmap of Spark's gives, and the power of two of a row's bits.
_PIECES = 4096 // SLOT_BYTES
_ROW_SHIFT = (8 * SLOT_BYTES).bit_length() - 1
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one driver table by Spark's own reader, so any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: str | Column) -> Column:
    """Number of words as a long; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


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


class Scratch:
    """Parquet tables in a folder of their own under the shared folder, which goes when the session's JVM ends.

    A table that is read back has no lineage and the size statistics of its files, so executors may be lost, and
    plans over many rounds stay short and well sized.
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
        """The rows of ``df``, written and read again; the shuffles that made them are given up."""
        conf, path = self.spark.conf, f"{self.root}/{name}"
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete these tables, or all: only those that no frame in use still reads."""
        for name in names or ("",):
            self._files.delete(self._at(f"{self.root}/{name}".rstrip("/"))[1], True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a Parquet table of its own in the shared folder, read again."""
    return Scratch(df.sparkSession).keep(df, name.replace(" ", "_"))


def slot_table(hashes: DataFrame) -> DataFrame:
    """(part, bits): the slots that the 64-bit numbers of a one-column frame take, one bit for each of SLOTS.

    The rows move to their part before bits are set, so what moves grows with the rows and not with the tasks.
    """
    slot = F.pmod(F.col(hashes.columns[0]), F.lit(SLOTS))
    placed = hashes.select(F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot).alias("at"))
    whole = placed.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    # Short rows, as a look-up copies the whole row.
    pieces = F.sequence(F.lit(0), F.lit(_PIECES - 1))
    cut = whole.select("part", F.explode(pieces).alias("i"), "bits").select(
        (F.col("part") * _PIECES + F.col("i")).alias("part"), F.substring("bits", F.col("i") * SLOT_BYTES + 1, F.lit(SLOT_BYTES)).alias("bits")
    )
    return written(cut.where("hex(bits) rlike '[^0]'"), "slots")


def marked(df: DataFrame, number: str, table: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: false only where ``number`` is none of those that the slot table was made of.

    It may be true for others that share a slot, more often the fuller the table is, so an exact join has to follow.
    The table is broadcast, which its fixed size allows.
    """
    slot = F.pmod(F.col(number), F.lit(SLOTS))
    held = table.select(F.col("part").alias(f"{name}_part"), F.col("bits").alias(f"{name}_bits"))
    place = F.bitmap_bit_position(slot)
    at = place.bitwiseAND(F.lit(8 * SLOT_BYTES - 1))
    byte = F.conv(F.hex(F.substring(F.col(f"{name}_bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    part = F.bitmap_bucket_number(slot) * _PIECES + F.shiftright(place, _ROW_SHIFT)
    joined = df.join(F.broadcast(held), part == F.col(f"{name}_part"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], found.alias(name))
