"""Vector search over blocks: an inverted-file index, and the exact search of many queries in one scan.

Vectors are packed into blocks, rows of up to BLOCK vectors that share a key. Queries are packed in the same way, and
both sides meet in a join of blocks, by the cell in the index and as ``blocks.meet`` has it in the exact search. Each pair
of blocks is one matrix product that keeps the k best of each query. No query and no vector ever lies on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.blocks import meet
from tessella.session import ship
from tessella.sources.scratch import Tables

#: Vectors of a block; a pair of blocks has its square of scores, 8 MB in doubles.
BLOCK = 1024
#: The index is fitted on at most so many rows and has at most so many cells: documented bounds, whatever the table's size.
SAMPLE_ROWS = 50_000
MOST_CELLS = 1_024
#: Rows of the sample to a cell, and rounds of fitting.
ROWS_TO_CELL = 40
ROUNDS = 12
#: Share of the cells that a query visits, and the fewest.
PROBED = 0.2
LEAST_PROBES = 8

_BLOCK_SCHEMA = "key long, width int, ids array<bigint>, vectors array<float>"
_TYPES = {"float": np.float32, "double": np.float64}
_HIT_SCHEMA = "query_id long, id long, similarity double"


def _vectors(batch: pa.RecordBatch, at: int, kind: str = "float") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, matrix) of the vectors in a column, by width; null and empty ones, and rows without id, are left out."""
    lists = batch.column(at)
    width = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero((width == w) & known)
        if len(rows):
            yield w, rows, lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(_TYPES[kind]).reshape(-1, w)


def _block(key: int, ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    columns = [
        pa.array([key], type=pa.int64()),
        pa.array([matrix.shape[1]], type=pa.int32()),
        pa.array([ids], type=pa.list_(pa.int64())),
        pa.array([matrix.ravel()], type=pa.list_(pa.from_numpy_dtype(matrix.dtype))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["key", "width", "ids", "vectors"])


def _packed(kind: str, block: int = BLOCK):
    """Task function: vectors (id, v) to blocks of ``block`` vectors of one width, in the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(width: int) -> Iterator[pa.RecordBatch]:
            parts = held.pop(width)
            ids, matrix = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            for at in range(0, len(ids), block):
                yield _block(0, ids[at : at + block], matrix[at : at + block])

        for batch in batches:
            for width, rows, matrix in _vectors(batch, 1, kind):
                held.setdefault(width, []).append((batch.column(0).take(pa.array(rows)).to_numpy().astype(np.int64), matrix))
                if sum(len(ids) for ids, _ in held[width]) >= block:
                    yield from flush(width)
        for width in list(held):
            yield from flush(width)

    return run


def _best(k: int):
    """Task function: the k best of each query of a query block among the vectors of a block, for each joined pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width = batch.column("width")[i].as_py()
                array = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                ids, queries = array("ids"), array("query_ids")
                scores = array("queries").reshape(-1, width).astype(np.float64) @ array("vectors").reshape(-1, width).astype(np.float64).T
                scores = np.round(scores, 9)
                scores[queries[:, None] == ids[None, :]] = -np.inf
                row, column = best_cells(scores, ids, k)
                found = [pa.array(queries[row]), pa.array(ids[column]), pa.array(scores[row, column])]
                yield pa.RecordBatch.from_arrays(found, names=["query_id", "id", "similarity"])

    return run


def best_cells(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best finite scores of each row; ties by the lowest id."""
    if scores.shape[1] > k:  # the k-th best of each row, and all ties with it
        scores = np.where(scores < np.partition(scores, -k, axis=1)[:, -k][:, None], -np.inf, scores)
    row, column = np.nonzero(np.isfinite(scores))
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep]


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query, ties by the lowest id; Spark limits groups before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pairs(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Blocks and query blocks of the same key and width."""
    asked = queries.select("key", "width", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    return blocks.join(asked, ["key", "width"]).select("width", "ids", "vectors", "query_ids", "queries")


def exact(queries: DataFrame, corpus: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Exact nearest rows by dot product: queries(query_id, q) and corpus(id, v) to (query_id, id, similarity, rank).

    Both sides are packed in their scans, queries by ``block``, and every query block meets every block of the corpus
    (``blocks.meet``): one scan of the corpus, whatever the number of queries. A row is no neighbour of the query of the
    same id; null vectors and those of another length are no neighbours; ties go to the lowest id; an empty side gives
    no rows. Vectors of doubles are multiplied as such.
    """
    spark = corpus.sparkSession
    ship(spark)
    double = any("double" in frame.schema[c].dataType.simpleString() for frame, c in ((queries, "q"), (corpus, "v")))
    kind = "double" if double else "float"
    schema = _BLOCK_SCHEMA.replace("float", kind)
    asked = queries.select("query_id", "q").mapInArrow(_packed(kind, block), schema)
    asked = asked.select(F.col("width").alias("query_width"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    asked = Tables(spark).keep(asked, "queries")
    blocks = corpus.select("id", "v").mapInArrow(_packed(kind), schema).select("width", "ids", "vectors")
    pairs = meet(blocks, asked, "8L * size(query_ids) + 8L * size(queries)").where("width = query_width")
    return _ranked(pairs.mapInArrow(_best(k), _HIT_SCHEMA), k)


class VectorIndex:
    """An inverted-file index in a folder: ``cells`` (centres and radii) and ``blocks``, partitioned by cell.

    Every row of every append is in the index, in single precision; only the centres come from a sample.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        ship(spark)

    # --- building

    @classmethod
    def build(cls, corpus: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS, most_cells: int = MOST_CELLS) -> VectorIndex:
        """Fit the cells on a sample of at most ``sample_rows`` rows of corpus(id, v) and index all rows.

        The sample is of the rows whose ids have the lowest hashes, so it is the same at every run. It has the width of
        most of its vectors; rows of another width, and null ones, are not indexed, as they are no neighbours either.
        """
        index = cls(corpus.sparkSession, path)
        # Only about four times the sample is ranked, and each task's share of it is limited.
        thinned = max(1, corpus.count() // (4 * sample_rows))
        some = corpus.where("size(v) > 0").select("v", F.xxhash64("id").alias("h")).where(F.pmod("h", F.lit(thinned)) == 0)
        hashed = some.orderBy("h").limit(sample_rows)
        # One task fits the centres on the bounded sample.
        one = hashed.coalesce(1).mapInArrow(_fit(most_cells), "cell long, centre array<float>")
        one.write.mode("errorifexists").parquet(f"{path}/centres")
        index.append(corpus)
        return index

    def centres(self) -> np.ndarray:
        """The cells' centres: at most MOST_CELLS vectors, so they may go out with the tasks."""
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()
        return np.array([r.centre for r in rows], dtype=np.float32)

    def append(self, corpus: DataFrame) -> None:
        """Add rows to the cells. Rows move once, as (cell, hash of id) ranges, so a very full cell is cut too."""
        centres = self.centres()
        if not len(centres):
            return
        placed = corpus.select("id", "v").mapInArrow(_placed(centres, 1), "key long, id long, v array<float>, near double")
        order = ["key", F.xxhash64("id")]
        dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
        blocks = dealt.mapInArrow(_cell_blocks, f"{_BLOCK_SCHEMA}, least double, n long")
        blocks.withColumn("cell", F.col("key")).write.mode("append").partitionBy("cell").parquet(f"{self.path}/blocks")

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(f"{_BLOCK_SCHEMA}, least double, n long, cell long").parquet(f"{self.path}/blocks")

    def cells(self) -> DataFrame:
        """(cell, rows, least): rows of each cell, and the lowest similarity of one to the centre."""
        return self.blocks().groupBy("cell").agg(F.sum("n").alias("rows"), F.min("least").alias("least"))

    def describe(self) -> str:
        """Cells and rows, as JSON."""
        found = self.cells().agg(F.count("*").alias("cells"), F.sum("rows").alias("rows"), F.max("rows").alias("largest")).first()
        return json.dumps(found.asDict())

    # --- searching

    def search(self, queries: DataFrame, k: int, probes: int | None = None, whole: bool = False) -> DataFrame:
        """Nearest rows of queries(query_id, q) among those of the ``probes`` nearest cells: (query_id, id, similarity, rank).

        By default PROBED of the cells, LEAST_PROBES at least. With ``whole`` the result is exact for unit vectors: the
        k-th similarity found so far is a bound, and the cells that it does not rule out are visited too. A row of a
        cell lies within the cell's angle of the centre, so its similarity to a query is at most the cosine of the
        query's angle to the centre less that angle.
        """
        centres = self.centres()
        if not len(centres):
            return self.spark.createDataFrame([], f"{_HIT_SCHEMA}, rank int")
        probes = min(len(centres), max(LEAST_PROBES, round(PROBED * len(centres))) if probes is None else probes)
        if whole:
            return self._whole(queries, k, probes, centres)
        visits = queries.select("query_id", "q").mapInArrow(_placed(centres, probes), "key long, id long, v array<float>, near double")
        return _ranked(self._met(visits).mapInArrow(_best(k), _HIT_SCHEMA), k)

    def _met(self, visits: DataFrame) -> DataFrame:
        """Blocks of the visited cells beside the blocks of the queries that visit them."""
        order = ["key", F.xxhash64("id")]
        packed = visits.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cell_blocks, f"{_BLOCK_SCHEMA}, least double, n long")
        # The cell is the partition column, so partitions that no query visits need not be read.
        mine = self.blocks().drop("key").withColumnRenamed("cell", "key")
        return _pairs(mine, packed)

    def _whole(self, queries: DataFrame, k: int, probes: int, centres: np.ndarray) -> DataFrame:
        tables = Tables(self.spark)
        near = queries.select("query_id", "q").mapInArrow(_placed(centres, len(centres)), "key long, id long, v array<float>, near double")
        order = Window.partitionBy("id").orderBy(F.desc("near"), "key")
        ranked = near.withColumn("place", F.row_number().over(order))
        first = _ranked(self._met(ranked.where(F.col("place") <= probes)).mapInArrow(_best(k), _HIT_SCHEMA), k)
        first = tables.keep(first, "first")
        bound = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("similarity").alias("reached"))
        reach = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "near"))) - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "least")))
        most = F.when(reach <= 0, F.lit(1.0)).otherwise(F.cos(reach))
        # The margin covers single precision.
        rest = ranked.where(F.col("place") > probes).join(self.cells().withColumnRenamed("cell", "key"), "key").join(bound, "id", "left")
        rest = rest.where(F.col("reached").isNull() | (most + 1e-4 >= F.col("reached"))).select("key", "id", "v", "near")
        second = self._met(rest).mapInArrow(_best(k), _HIT_SCHEMA)
        return _ranked(first.drop("rank").unionByName(second), k)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm > 0, norm, 1)


def _fit(most_cells: int):
    """Task function: spherical k-means over the vectors of the commonest width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_width: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            turned = pa.RecordBatch.from_arrays([batch.column(1), batch.column(0)], names=["h", "v"])
            for width, _, matrix in _vectors(turned, 1):
                by_width.setdefault(width, []).append(matrix)
        if not by_width:
            return
        rows = _unit(np.concatenate(max(by_width.values(), key=lambda parts: sum(map(len, parts)))).astype(np.float32))
        rng = np.random.default_rng(17)
        centres = rows[rng.permutation(len(rows))[: max(1, min(most_cells, len(rows) // ROWS_TO_CELL))]]
        for _ in range(ROUNDS):
            own = np.concatenate([np.argmax(rows[at : at + BLOCK] @ centres.T, axis=1) for at in range(0, len(rows), BLOCK)])
            sums = np.zeros_like(centres)
            np.add.at(sums, own, rows)
            # A cell without rows starts again at one of them.
            for cell in np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0):
                sums[cell] = rows[rng.integers(len(rows))]
            centres = _unit(sums)
        columns = [pa.array(np.arange(len(centres))), pa.array(list(centres), type=pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "centre"])

    return run


def _placed(centres: np.ndarray, number: int):
    """Task function: each vector with its ``number`` nearest cells and its cosine to their centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            for width, rows, matrix in _vectors(batch, 1):
                if width != centres.shape[1]:
                    continue
                near = _unit(matrix) @ centres.T
                cells = np.argsort(-near, axis=1, kind="stable")[:, :number]
                ids = batch.column(0).take(pa.array(rows)).to_numpy().astype(np.int64)
                vectors = pa.array(list(matrix), type=pa.list_(pa.float32())).take(pa.array(np.repeat(np.arange(len(rows)), number)))
                similar = np.take_along_axis(near, cells, 1).ravel().astype(np.float64)
                columns = [pa.array(cells.ravel()), pa.array(np.repeat(ids, number)), vectors, pa.array(similar)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "v", "near"])

    return run


def _cell_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors in order of their cell to blocks of one cell, with the lowest similarity to the centre."""
    cell: int | None = None
    ids: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    near: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not ids:
            return
        all_ids, matrix, similar = np.concatenate(ids), np.concatenate(parts), np.concatenate(near)
        for at in range(0, len(all_ids), BLOCK):
            part = _block(cell, all_ids[at : at + BLOCK], matrix[at : at + BLOCK])
            more = [pa.array([float(similar[at : at + BLOCK].min())]), pa.array([len(all_ids[at : at + BLOCK])], type=pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "least", "n"])
        ids.clear(), parts.clear(), near.clear()

    for batch in batches:
        cells = batch.column(0).to_numpy()
        for start, end in zip(*_stretches(cells), strict=True):
            if cells[start] != cell or sum(map(len, ids)) >= BLOCK:
                yield from flush()
                cell = int(cells[start])
            own = batch.slice(start, end - start)
            ids.append(own.column(1).to_numpy())
            lists = own.column(2)
            parts.append(lists.flatten().to_numpy(zero_copy_only=False).reshape(end - start, -1))
            near.append(own.column(3).to_numpy())
    yield from flush()


def _stretches(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of stretches of equal values, none longer than BLOCK."""
    if not len(values):
        return [], []
    edges = np.flatnonzero(np.diff(values)) + 1
    bounds = np.union1d(np.concatenate([[0], edges, [len(values)]]), np.arange(0, len(values), BLOCK)).astype(int).tolist()
    return bounds[:-1], bounds[1:]
