"""Ingestion: extraction checks, running headers, deduplication, chunks, tables with cascade."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.python_text import chunk_page, chunker
from tessella.session import ship
from tessella.sources.scratch import Tables

HEADER_SHARE = 0.6
HEADER_PAGES = 4


def assess(pages: DataFrame) -> DataFrame:
    """Quality of each document's extracted pages: (document, pages, total_chars, empty_pages, chars_per_page, verdict)."""
    empty = F.length(T.trim_all("text")) < 20
    per = pages.groupBy("document").agg(
        F.count("*").alias("pages"),
        F.sum(F.length("text")).cast("long").alias("total_chars"),
        F.count_if(empty).alias("empty_pages"),
    )
    mean = F.round(F.col("total_chars") / F.col("pages")).cast("long")
    verdict = (
        F.when(F.col("total_chars") < 200, "scanned")
        .when(F.col("empty_pages") > F.col("pages") * 0.5, "partly scanned")
        .when(mean < 150, "sparse")
        .otherwise("ok")
    )
    return per.select("*", mean.alias("chars_per_page"), verdict.alias("verdict"))


def repeated_lines(pages: DataFrame) -> DataFrame:
    """Running headers and footers: (document, key, n_pages), on 60 % of a document's pages or more, from 4 pages."""
    sizes = pages.groupBy("document").agg(F.count("*").alias("pages")).where(F.col("pages") >= HEADER_PAGES)
    keys = pages.select("document", F.explode(T.edge_lines("text")).alias("line")).select("document", T.header_key(F.col("line")).alias("key"))
    counted = keys.groupBy("document", "key").agg(F.count("*").alias("n_pages"))
    return counted.join(sizes, "document").where(F.col("n_pages") >= HEADER_SHARE * F.col("pages")).select("document", "key", "n_pages")


def strip_repeated(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """Pages without the lines found repeated in their document."""
    keys = repeated.groupBy("document").agg(F.collect_set("key").alias("keys"))
    joined = pages.join(keys, "document", "left")
    kept = F.filter(F.split("text", "\n"), lambda line: ~F.array_contains(F.col("keys"), T.header_key(line)))
    return joined.withColumn("text", F.when(F.col("keys").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("keys")


def by_checksum(files: DataFrame, key: str, text: str, existing: DataFrame | None = None) -> DataFrame:
    """One row a content: (checksum, first key, copies), without contents that ``existing`` (checksum) holds."""
    summed = files.withColumn("checksum", F.sha2(F.col(text), 256)).groupBy("checksum").agg(F.min(key).alias("document"), F.count("*").alias("copies"))
    return summed if existing is None else summed.join(existing.select("checksum"), "checksum", "left_anti")


def _estimated(chunked: DataFrame) -> DataFrame:
    """With the usual estimate of tokens, one for four characters begun."""
    return chunked.withColumn("token_estimate", F.ceil(F.length("text") / 4).cast("long"))


def document_chunks(documents: DataFrame, target: int = 500, overlap: int = 100, least: int = 80) -> DataFrame:
    """Chunks of documents(document, pages array<string>): (document, page, chunk_index, text, token_estimate).

    Pages count from 1, chunks from 0 over all pages of their document; null and blank pages have none. A document is
    one row, so nothing is shuffled.
    """
    ship(documents.sparkSession)
    cut = documents.select("document", chunker(target, overlap, least)("pages").alias("parts"))
    paged = F.transform("parts", lambda page, i: F.transform(page, lambda x: F.struct((i + 1).alias("page"), x.alias("text"))))
    rows = cut.select("document", F.posexplode(F.flatten(paged)).alias("chunk_index", "chunk"))
    return _estimated(rows.select("document", "chunk.page", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk.text"))


def chunks(pages: DataFrame, target: int = 500, overlap: int = 100, least: int = 80) -> DataFrame:
    """Chunks of pages in rows (document, page, text): (document, page, chunk_index, text, token_estimate).

    The index runs over a document's pages in their order; rows of one page go by the hash of their text. Pages are
    sorted by ranges, so a document of very many pages is many tasks. Each numbers its chunks as it cuts them, and the
    chunks are written; then the numbers of a document that an earlier range began start at what that range counted.
    Pages move once and before they are cut; where a document is one row, ``document_chunks`` moves nothing.
    """
    spark = pages.sparkSession
    ship(spark)
    order = ["document", "page", F.xxhash64("text")]
    sorted_pages = pages.select("document", "page", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    kind = lambda c: pages.schema[c].dataType.simpleString()
    cut = sorted_pages.mapInArrow(_cut(target, overlap, least), f"document {kind('document')}, page {kind('page')}, at long, text string")
    placed = Tables(spark).keep(cut.withColumn("part", F.spark_partition_id()), "chunks")
    counted = placed.groupBy("document", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("document").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # A range goes on with one document at most, its first, so these are fewer than the ranges.
    begun = counted.select(F.col("document").alias("begun"), "part", earlier.alias("earlier")).where("earlier > 0")
    met = placed.join(F.broadcast(begun), (placed["part"] == begun["part"]) & placed["document"].eqNullSafe(begun["begun"]), "left")
    return _estimated(met.select("document", "page", (F.col("at") + F.coalesce("earlier", F.lit(0))).alias("chunk_index"), "text"))


def _cut(target: int, overlap: int, least: int):
    """Task function: pages (document, page, text) in order to chunks, numbered by document from the task's first page on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, at = object(), 0
        for batch in batches:
            rows, numbers, texts = [], [], []
            for i, (own, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if own != document:
                    document, at = own, 0
                parts = chunk_page(text, target, overlap, least)
                rows += [i] * len(parts)
                numbers += range(at, at + len(parts))
                texts += parts
                at += len(parts)
            own = batch.take(pa.array(rows, pa.int64()))
            columns = [own.column(0), own.column(1), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["document", "page", "at", "text"])

    return run


def delete_cascade(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the doomed keys."""
    gone = doomed.select(F.col(doomed.columns[0]).alias("gone")).distinct()
    keep = lambda t, k: t.join(gone, F.col(k) == F.col("gone"), "left_anti")
    return keep(parents, key), keep(children, child_key)


def orphans(children: DataFrame, parents: DataFrame, child_key: str, key: str) -> DataFrame:
    """Child rows whose parent is missing."""
    return children.join(parents.select(F.col(key).alias("parent_key")), F.col(child_key) == F.col("parent_key"), "left_anti")


def run_lines(strs: str, ys: str, jump: float = 2.0) -> Column:
    """Page text from a page's runs and their heights, two arrays in order: a new line where y jumps by over 2."""
    breaks = lambda i: (i > 0) & (F.abs(F.get(ys, i) - F.get(ys, i - 1)) > jump)
    pieces = F.transform(strs, lambda piece, i: F.concat(F.when(breaks(i), "\n").otherwise(""), piece))
    return F.regexp_replace(F.array_join(pieces, ""), r"\n{2,}", "\n")


def glyph_lines(items: DataFrame, jump: float = 2.0) -> DataFrame:
    """Page text from positioned glyph runs (document, page, seq, str, y, has_eol): a new line where y jumps by over 2.

    The last known y carries over runs without one.
    """
    order = Window.partitionBy("document", "page").orderBy("seq")
    before = F.last("y", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    breaks = F.coalesce(F.abs(F.col("y") - before) > jump, F.lit(False))
    piece: Column = F.concat(F.when(breaks, "\n").otherwise(""), F.coalesce("str", F.lit("")), F.when(F.coalesce("has_eol", F.lit(False)), "\n").otherwise(""))
    pieces = items.select("document", "page", "seq", piece.alias("piece"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"])
    return pieces.groupBy("document", "page").agg(F.regexp_replace(F.array_join(ordered, ""), r"\n{2,}", "\n").alias("text"))
