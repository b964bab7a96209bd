"""Files in and tables out: directory scans with per-file errors, parsers, all-or-nothing publishing of table sets."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import pdf
from tessella.functions.text import safe_filename
from tessella.operators import ingest
from tessella.session import ship

MOST_BYTES = 60 * 1024 * 1024
#: Characters or bytes of an Arrow batch of pages or files, about; a larger one goes alone.
BATCH_CHARS = 4 * 1024 * 1024


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a scan yields fewer partitions than there are; a large table stays as it is.

    One file of one row group is one task, whatever its work. A scan of many files never meets the condition.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files of a folder with content and checksum: (path, filename, length, content, checksum, problem). Spark skips empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    name = safe_filename(F.element_at(F.split("path", "/"), -1))
    problem = F.when(F.col("length") > MOST_BYTES, "too large")
    return files.select("path", name.alias("filename"), "length", "content", F.sha2("content", 256).alias("checksum"), problem.alias("problem"))


def parsed_pages(files: DataFrame, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages of each file by an injected parser: (path, page, text, error). A file that fails is one row with its error."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, i, t, None) for i, t in enumerate(parse(bytes(content)), 1)]
                except Exception as error:  # noqa: BLE001  one bad file must not fail the others
                    rows.append((path, 0, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"])

    return files.where("problem is null").select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def glyph_runs(files: DataFrame) -> DataFrame:
    """Text runs of PDF files (path, content): (document, page, strs, ys, error), a row a page, by the library's own reader.

    Pages count from 1; a page without text has no row. A file that cannot be read, also because a later page is
    damaged, is one row with its error and page 0. Files are read one after the other, and their pages go on in Arrow
    batches of about BATCH_CHARS.
    """
    ship(files.sparkSession)
    types = {"document": pa.string(), "page": pa.int32(), "strs": pa.list_(pa.string()), "ys": pa.list_(pa.float64()), "error": pa.string()}

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    pages = pdf.runs_of(content.as_py() or b"")
                    found = [(path, n, [text for text, _ in runs], [y for _, y in runs], None) for n, runs in enumerate(pages, 1) if runs]
                except Exception as error:  # noqa: BLE001  one bad file must not fail the others
                    found = [(path, 0, None, None, f"{type(error).__name__}: {error}")]
                rows += found
                size += sum(len(text) for row in found for text in row[2] or ())
                if size > BATCH_CHARS:
                    yield given(rows)
                    rows, size = [], 0
            if rows:
                yield given(rows)

    return files.select("path", "content").mapInArrow(run, "document string, page int, strs array<string>, ys array<double>, error string")


def pdf_pages(files: DataFrame) -> DataFrame:
    """Page texts of PDF files (path, content[, problem]): (document, page, text, error); lines are put together by Spark.

    A file with a problem, or one that cannot be read, is one row of page 0 with its error. Each file is read once, and
    nothing is shuffled: a page is a row, from its runs to its text.
    """
    sound = files.where("problem is null") if "problem" in files.columns else files
    pages = glyph_runs(sound).select("document", "page", ingest.run_lines("strs", "ys").alias("text"), "error")
    if "problem" in files.columns:
        refused = files.where("problem is not null").select(F.col("path").alias("document"), F.lit(0).alias("page"), F.lit(None).cast("string").alias("text"), F.col("problem").alias("error"))
        pages = pages.unionByName(refused)
    return pages


def pdf_content(texts: DataFrame, key: str, text: str, lines: int = pdf.LINES) -> DataFrame:
    """Each text as a PDF file: (path, content), pages of ``lines`` lines; the path is the key and ``.pdf``."""
    ship(texts.sparkSession)

    def given(names: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            contents: list[bytes] = []
            size = 0
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(f"{name}.pdf")
                contents.append(pdf.write(pdf.paged(body.as_py(), lines)))
                size += len(contents[-1])
                if size > BATCH_CHARS:
                    yield given(names, contents)
                    names, contents, size = [], [], 0
            if names:
                yield given(names, contents)

    return texts.select(F.col(key).cast("string"), text).mapInArrow(run, "path string, content binary")


def publish(tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Write a set of tables as one version: readers follow the manifest, which is written last.

    Each table's write is all-or-nothing by Spark's commit protocol; a run that dies before the manifest leaves
    the earlier version in force.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    manifest = json.dumps({"version": version, "tables": sorted(tables)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest")
    return f"{root}/{version}"


def published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the version in force."""
    manifest = json.loads(spark.read.text(f"{root}/manifest").first()[0])
    return {name: spark.read.parquet(f"{root}/{manifest['version']}/{name}") for name in manifest["tables"]}
