"""Line deduplication over levelled sorted runs of line hashes.

A batch of documents is reduced to its distinct line hashes, with the number of documents and the largest one that
hold each. That table is merge-joined with the runs so far: hashes without a match (the anti join) are the batch's own
run, sorted and bucketed like the others, so that no run is ever shuffled again; hashes with a match, or of several
documents, are hits. Runs of one level are merged into one of the next as soon as there are ``fanout`` of them. A hash
lies in one run only, and everything that is decided later is decided from the hits.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessella.llm.common import Scratch

#: Code points that a key has at least, and documents that hold it.
LEAST_CHARS = 20
LEAST_DOCS = 3
#: Batches that a whole table is taken in, and runs of a level that are merged.
BATCHES = 4
FANOUT = 2

_BLANK = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HASH = ("h1", "h2")


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _UPPER.lower())


def split_lines(text: Column) -> Column:
    """Lines of a text; a null or empty one is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(key: Column) -> list[Column]:
    """128 bits of a key, as two 64-bit hashes of different seeds."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


class LineRuns:
    """Levelled sorted runs of line hashes, in bucketed tables under the shared folder.

    A run has a row for each hash: h1, h2, n (documents of its batch), last (the largest key among them). Tables that
    were merged into a higher level are deleted.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.scratch = Scratch(spark)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.hits: list[DataFrame] = []

    def _save(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        sorted_ = df.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH)
        sorted_.option("path", f"{self.scratch.root}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.scratch.drop(name)

    def runs(self) -> list[str]:
        """Names of the runs, the highest level first."""
        return [name for level in reversed(self.levels) for name in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Merge a batch in: rows (key, h1, h2), one for each document and distinct hash in it. Returns the hits.

        Hits: h1, h2, n, last, seen: documents of the batch that hold the hash, the largest of them, and the largest
        one of the run that has it; ``fresh`` where no run has it, so that it comes from several of the batch.
        """
        self._compact()
        probed = lines.groupBy(*_HASH).agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("last"))
        probed = probed.select("*", F.lit(None).cast(lines.schema["key"].dataType).alias("seen"), F.lit(True).alias("fresh"))
        for name in self.runs():
            run = self.spark.table(name).select(*_HASH, F.col("last").alias("found"), F.lit(True).alias("in_run"))
            probed = probed.join(run, list(_HASH), "left").select(
                *_HASH, "n", "last", F.coalesce("seen", "found").alias("seen"), (F.col("fresh") & F.col("in_run").isNull()).alias("fresh")
            )
        batch = self._save(probed)
        table = self.spark.table(batch)
        hits = self.scratch.keep(table.where("NOT fresh OR n > 1"), f"hits_{len(self.hits)}")
        self.hits.append(hits)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(batch)
        return hits

    def _content(self, name: str) -> DataFrame:
        """A run's rows: of a batch's table those that no earlier run has."""
        table = self.spark.table(name)
        return table.where("fresh").select(*_HASH, "n", "last", "seen", "fresh")

    def _compact(self) -> None:
        """Merge the runs of every level that is full into one of the next, bucket by bucket."""
        for level in range(len(self.levels)):
            if len(self.levels[level]) < self.fanout:
                continue
            full, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._save(reduce(self._merged, [self._content(name) for name in full])))
            self._drop(full)

    def _merged(self, one: DataFrame, other: DataFrame) -> DataFrame:
        """Two runs as one: no hash is in both, so the full join is their merge, and it needs no exchange."""
        pairs = [F.coalesce(one[c], other[c]).alias(c) for c in ("n", "last", "seen", "fresh")]
        return one.join(other, list(_HASH), "full").select(*_HASH, *pairs)

    def common(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """h1, h2, last: the hashes that ``least_docs`` documents hold, and the largest one of all. From the hits only."""
        hits = reduce(DataFrame.unionByName, self.hits)
        found = hits.groupBy(*_HASH).agg(
            # A hash that was of one document when it came is no hit then; that document is not in n.
            (F.sum("n") + F.when(F.max(F.col("fresh").cast("int")) == 1, 0).otherwise(1)).alias("docs"),
            F.max("last").alias("own"),
            F.max("seen").alias("before"),
        )
        return found.where(F.col("docs") >= least_docs).select(*_HASH, F.greatest("own", "before").alias("last"))

    def close(self) -> None:
        """Delete the runs; the hits stay until the session ends."""
        self._drop(self.runs())
        self.levels = []


def _batches(docs: DataFrame, key: str, number: int) -> list[Column]:
    """Conditions that share the rows out by ranges of the key, the largest first; by hash if it is no number.

    A range is a pushed-down filter, so a table in order of its key is read once in all.
    """
    if isinstance(docs.schema[key].dataType, NumericType):
        points = [i / number for i in range(1, number)]
        cuts = sorted(set(docs.approxQuantile(key, points, 0.01))) if points else []
        edges = [None, *cuts, None]
        out = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            inside = F.lit(True)
            if low is not None:
                inside &= F.col(key) >= low
            if high is not None:
                inside &= F.col(key) < high
            out.append(inside if low is not None else inside | F.col(key).isNull())
        return out[::-1]
    return [F.pmod(F.xxhash64(key), F.lit(number)) == i for i in range(number)]


def drop_common_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
    batches: int = BATCHES, fanout: int = FANOUT,
) -> DataFrame:
    """Every row of ``docs`` with n_lines, n_dropped and kept_text: its text without the lines that others hold.

    A line's key is its text without blanks at both ends, A-Z lower-cased. Keys of ``least_chars`` code points in
    ``least_docs`` documents or more lose all their lines, except in the row of the largest ``key`` that holds them.
    A null or empty text is one empty line, kept_text is then empty. Every row is a document: of rows with an equal
    key all count, and all that share the largest one keep their lines; null keys are the smallest. Other columns are
    carried along, n_lines, n_dropped and kept_text are replaced; an empty table gives no rows.

    Lines are shuffled as hashes: once to be counted (summed on the map side, so that a frequent line is one row a
    task) and once to meet the common ones, in an equi-join that adaptive execution splits where a line is very
    frequent. Texts move only to meet the positions of their own dropped lines.
    """
    spark = docs.sparkSession
    own = ("n_lines", "n_dropped", "kept_text")
    carried = [c for c in docs.columns if c not in own]
    store = LineRuns(spark, fanout)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    for inside in _batches(rows, "key", batches):
        lines = F.explode(F.array_distinct(F.transform(split_lines(F.col("text")), line_key)))
        long = rows.where(inside).select("key", lines.alias("line")).where(F.length("line") >= least_chars)
        store.add(long.select("key", *_hashes(F.col("line"))))
    common = store.scratch.keep(store.common(least_docs), "common")
    store.close()

    # Rows that agree in key and text lose the same lines, so together they need them once.
    at = rows.select("key", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("at", "line"))
    at = at.withColumn("line", line_key(F.col("line"))).where(F.length("line") >= least_chars)
    met = at.select("key", "text_hash", "at", *_hashes(F.col("line"))).join(common, list(_HASH))
    lost = met.where(F.col("key").isNull() & F.col("last").isNotNull() | (F.col("key") < F.col("last")))
    lists = lost.groupBy("key", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("lost"))
    lists = store.scratch.keep(lists, "lost").select(F.col("key").alias("_key"), F.col("text_hash").alias("_text"), F.col("lost").alias("_lost"))

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"))
    own_key, own_text = F.col("row").getField(key), F.col("row").getField(text)
    joined = whole.join(lists, own_key.eqNullSafe(F.col("_key")) & (F.xxhash64(own_text) == F.col("_text")), "left")
    split = joined.select("row", "_lost", split_lines(own_text).alias("lines"))
    cuts = F.concat(F.array(F.lit(-1)), F.coalesce("_lost", F.array().cast("array<int>")), F.array(F.size("lines")))
    split = split.select("row", "lines", cuts.alias("cuts"))
    # What stays lies between one dropped line and the next.
    between = F.transform(
        F.sequence(F.lit(1), F.size("cuts") - 1),
        lambda i: F.slice("lines", F.get("cuts", i - 1) + 2, F.get("cuts", i) - F.get("cuts", i - 1) - 1),
    )
    found = split.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("cuts") - 2).cast("long").alias("n_dropped"),
        F.array_join(F.flatten(between), "\n").alias("kept_text"),
    )
    return found.select(*[F.col("row").getField(c).alias(c) for c in carried], *own)
