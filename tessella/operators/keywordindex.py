"""A stored inverted index of posting blocks, with a search that skips blocks which cannot reach the k-th score.

The documents of a segment are dealt into ranges by a hash of their id. A posting block holds the ids and weights of one
term in one range, and the block's maximal weight. All terms have the same ranges, so the maximal weights of a query's
terms in a range add up to a bound on the score of any document in it. A range is one row of the index, so a search is one
scan: a task bounds the ranges that it holds, scores those of the highest bounds first, and the k-th score that it has found
rules out all ranges of a lower bound, whose postings are not gone through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessella.operators import retrieval
from tessella.operators.blocks import meet
from tessella.session import ship
from tessella.sources.scratch import Tables

#: Documents of a range, on average.
RANGE_DOCS = 64
#: Ranges of a task's first ones that are scored to find a query's bound.
FIRST_RANGES = 4
#: Queries of a block.
QUERY_BLOCK = 256
#: Sums of a query's weights differ by less than this with their order.
MARGIN = 1e-8

#: A range: its blocks by term, and the postings of one block after the other.
_RANGE = "part int, terms array<string>, most array<double>, sizes array<int>, ids array<bigint>, weights array<double>"
#: Ranges that are bounded at once.
SLICE = 32
#: Row groups of the index: a reader holds one of them as a whole, and a range is a large row.
ROW_GROUPS = {"parquet.block.size": str(4 * 1024 * 1024), "parquet.block.size.row.check.min": "8"}

#: Postings of a block at most: a range may hold more documents than the average.
BLOCK_POSTINGS = 4 * RANGE_DOCS
_NAMES = ["term", "part", "most", "ids", "weights"]


def _whole(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows in order, cut only where the named columns change; the last group of a batch waits for the next one."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        given = pa.Table.from_batches([batch])
        if held and any(held[-1].column(n)[-1] != given.column(n)[0] for n in names):
            yield pa.concat_tables(held)
            held = []
        last = int(_starts(given, names)[-1])
        if last:
            yield pa.concat_tables([*held, given.slice(0, last)])
            held = []
        held.append(given.slice(last))
    if held:
        yield pa.concat_tables(held)


def _posting_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (term, part, id, tf) in order to blocks of one term and part; counts of one term and id are added up."""
    for counts in _whole(batches, ("term", "part")):
        yield _blocks(counts)


def _packed(stemmed: bool):
    """Task function: (id, text) to one row a text that has a term: (id, its terms, how often it has them as 32-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] = {}
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key is not None and text and (found := retrieval.counted(text, stemmed, stems)):
                    rows.append((key, " ".join(found), np.fromiter(found.values(), np.int32, len(found)).tobytes()))
            ids, terms, tfs = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(tfs, pa.binary())], names=["id", "terms", "tfs"])

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed texts (part, id, terms, tfs) in order of their part to ranges."""
    for texts in _whole(batches, ("part",)):
        blocks = _blocks(_counts(texts))
        bounds = np.append(_starts(pa.Table.from_batches([blocks]), ("part",)), blocks.num_rows).astype(np.int32)
        ids, weights = blocks.column("ids"), blocks.column("weights")
        offsets = ids.offsets.to_numpy()
        of_block = lambda values: pa.ListArray.from_arrays(pa.array(bounds), values)  # noqa: B023, E731
        of_posting = lambda values: pa.ListArray.from_arrays(pa.array(offsets[bounds]), values)  # noqa: B023, E731
        parts = blocks.column("part").take(pa.array(bounds[:-1]))
        sizes = pa.array(np.diff(offsets).astype(np.int32))
        columns = [parts, of_block(blocks.column("term")), of_block(blocks.column("most")), of_block(sizes), of_posting(ids.values), of_posting(weights.values)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "terms", "most", "sizes", "ids", "weights"])


def _counts(texts: pa.Table) -> pa.Table:
    """Packed texts as counts (term, part, id, tf), grouped by part and term, in order of id."""
    part, key = texts.column("part").to_numpy(), texts.column("id").to_numpy()
    order = np.lexsort((key, part))
    part, key = part[order], key[order]
    texts = texts.take(pa.array(order))
    lists = pc.split_pattern(texts.column("terms").combine_chunks(), " ")
    row = np.repeat(np.arange(len(key)), np.diff(lists.offsets.to_numpy()))
    tf = np.frombuffer(b"".join(texts.column("tfs").to_pylist()), np.int32).astype(np.int64)
    terms = lists.flatten().dictionary_encode()
    place = np.cumsum(np.append(0, part[1:] != part[:-1]))
    at = np.argsort(place[row] * len(terms.dictionary) + terms.indices.to_numpy(), kind="stable")
    row = row[at]
    return pa.table({"term": terms.dictionary.take(terms.indices.take(pa.array(at))), "part": part[row], "id": key[row], "tf": tf[at]})


def _starts(rows: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Rows that differ from the row before in any of the columns."""
    changed = np.zeros(rows.num_rows, dtype=bool)
    changed[:1] = True
    for name in names:
        column = rows.column(name).combine_chunks()
        changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)


def _blocks(rows: pa.Table) -> pa.RecordBatch:
    """Whole terms and parts as blocks of at most BLOCK_POSTINGS postings."""
    firsts = _starts(rows, ("term", "part", "id"))
    tf = np.add.reduceat(rows.column("tf").to_numpy(), firsts)
    kept = rows.take(pa.array(firsts))
    groups = _starts(kept, ("term", "part"))
    sizes = np.diff(np.append(groups, len(firsts)))
    place = np.arange(len(firsts)) - np.repeat(groups, sizes)
    begins = np.flatnonzero(place % BLOCK_POSTINGS == 0)
    # The weight of a posting: 0.1 * sum(1/j^2, j <= tf) / ZETA2.
    weights = 0.1 * np.cumsum(1.0 / np.arange(1, tf.max() + 1, dtype=np.float64) ** 2)[tf - 1] / retrieval.ZETA2
    offsets = pa.array(np.append(begins, len(firsts)).astype(np.int32))
    heads = kept.take(pa.array(begins))
    lists = [pa.ListArray.from_arrays(offsets, v) for v in (kept.column("id").combine_chunks(), pa.array(weights))]
    columns = [heads.column("term").combine_chunks(), heads.column("part").combine_chunks(), pa.array(np.maximum.reduceat(weights, begins)), *lists]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


class _Best:
    """The k best documents of each query of a block so far: by score, then by the lowest id."""

    def __init__(self, query_ids: np.ndarray, asked: list[list[str]], k: int):
        self.query_ids, self.k = query_ids, k
        numbers, self.query, self.share, self.first = retrieval.by_term(asked)
        self.terms = pa.array(list(numbers), pa.string())
        self.reached = np.full(len(query_ids), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = self.read = self.there = 0

    def add(self, ranges: pa.RecordBatch) -> None:
        """Score the ranges (terms, most, sizes, ids, weights) that may hold one of the best."""
        lists = {name: ranges.column(ranges.schema.get_field_index(name)) for name in ("terms", "most", "sizes", "ids", "weights")}
        values = {name: column.flatten() for name, column in lists.items()}
        number = pc.index_in(values["terms"], value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(number >= 0)
        number = number[hit].astype(np.int64)
        of = np.repeat(np.arange(ranges.num_rows), pc.list_value_length(lists["terms"]).to_numpy())[hit]
        sizes = values["sizes"].to_numpy()
        begin, size = (np.cumsum(sizes, dtype=np.int64) - sizes)[hit], sizes[hit].astype(np.int64)
        # One entry for each block and each query that has its term.
        entry, at = _spread(self.first[number], self.first[number + 1] - self.first[number])
        query, share = self.query[at], self.share[at]
        shape = (len(self.query_ids), ranges.num_rows)
        bound = np.bincount(query * shape[1] + of[entry], weights=values["most"].to_numpy()[hit][entry] * share, minlength=shape[0] * shape[1]).reshape(shape)
        begins = np.searchsorted(of[entry], np.arange(shape[1] + 1))
        self.there += len(entry)
        ids, weights = values["ids"].to_numpy(), values["weights"].to_numpy()
        waits = bound > 0
        best = np.argpartition(-bound, min(FIRST_RANGES, shape[1]) - 1, axis=1)[:, :FIRST_RANGES]
        first = np.zeros(shape, dtype=bool)
        np.put_along_axis(first, best, True, axis=1)
        first &= np.isneginf(self.reached)[:, None]
        for turn in (waits & first, waits & ~first):
            for r in np.argsort(-(bound * turn).sum(axis=0), kind="stable"):
                asking = turn[:, r] & (bound[:, r] + MARGIN >= self.reached)
                if not asking.any():
                    continue
                these = begins[r] + np.flatnonzero(asking[query[begins[r] : begins[r + 1]]])
                self.read += len(these)
                block = entry[these]
                which, posting = _spread(begin[block], size[block])
                low, high = posting.min(), posting.max() + 1
                docs, column = np.unique(ids[low:high], return_inverse=True)
                cell = query[these][which] * len(docs) + column[posting - low]
                score = np.round(np.bincount(cell, weights=weights[posting] * share[these][which], minlength=shape[0] * len(docs)), 9)
                kept = np.flatnonzero((score > 0) & (score >= np.repeat(self.reached, len(docs))))
                self.found.append((kept // len(docs), docs[kept % len(docs)], score[kept]))
                self.waiting += len(kept)
                if self.waiting > self.k * shape[0]:
                    self.trim()
            self.trim()

    def trim(self) -> None:
        """Keep k rows a query, and note the k-th score of each that has them."""
        if not self.found:
            return
        query, key, score = (np.concatenate(c) for c in zip(*self.found, strict=True))
        order = np.lexsort((key, -score, query))
        query, key, score = query[order], key[order], score[order]
        starts = np.searchsorted(query, np.arange(len(self.query_ids) + 1))
        rank = np.arange(len(query)) - starts[query]
        last = rank == self.k - 1
        self.reached[query[last]] = score[last]
        kept = rank < self.k
        self.found, self.waiting = [(query[kept], key[kept], score[kept])], 0

    def rows(self) -> pa.RecordBatch:
        self.trim()
        query, key, score = self.found[0] if self.found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.RecordBatch.from_arrays([pa.array(self.query_ids[query]), pa.array(key), pa.array(score)], names=["query_id", "id", "score"])


def _spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of places from ``begin`` on, one after the other: the number of each place's run, and the place."""
    run = np.repeat(np.arange(len(size)), size)
    return run, np.arange(len(run)) + np.repeat(begin - (np.cumsum(size) - size), size)


def _best_ranges(k: int, visits: bool = False):
    """Task function: ranges, each joined with blocks of queries, to the k best documents of each query among them.

    With ``visits`` one row a block of queries instead: how many blocks were gone through, of how many with its terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, _Best] = {}
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            queries = batch.column(batch.schema.get_field_index("query_ids"))
            names = [queries[i].values.to_numpy().tobytes() for i in range(batch.num_rows)]
            for name in dict.fromkeys(names):
                rows = [i for i, other in enumerate(names) if other == name]
                if name not in best:
                    asked = batch.column(batch.schema.get_field_index("asked"))[rows[0]].as_py()
                    best[name] = _Best(queries[rows[0]].values.to_numpy().copy(), asked, k)
                best[name].add(batch if len(rows) == batch.num_rows else batch.take(pa.array(rows)))
        for found in best.values():
            yield pa.RecordBatch.from_pydict({"read": [found.read], "there": [found.there]}) if visits else found.rows()

    return run


class KeywordIndex:
    """Posting blocks in a folder, a subfolder a segment; an append writes a segment and changes no other.

    With ``stemmed`` documents and queries are compared by Porter stems; an index keeps the form it was begun with.
    """

    def __init__(self, spark: SparkSession, path: str, stemmed: bool = False):
        self.spark, self.path, self.stemmed = spark, path, stemmed
        ship(spark)

    def ranges(self) -> DataFrame:
        """(part, terms, most, sizes, ids, weights, segment)."""
        return self.spark.read.schema(f"{_RANGE}, segment int").parquet(self.path)

    def _next(self) -> int:
        try:
            return (self.ranges().agg(F.max("segment")).first()[0] or 0) + 1
        except AnalysisException:  # the first segment
            return 1

    def append(self, docs: DataFrame, key: str = "id", text: str = "text") -> None:
        """Index the rows of ``docs`` as a new segment: ids that are not in the index yet.

        Rows of one id are one document. Rows without an id, and texts without a term, are not found by any query.
        A text is one row from the scan on, its terms beside their counts, and moves once, to its range; there the counts of
        one id are added up and weighed. A task holds the texts of one range, and of one batch, at a time.
        """
        packed = docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(_packed(self.stemmed), "id long, terms string, tfs binary")
        parts = max(1, -(-docs.count() // RANGE_DOCS))
        placed = packed.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "terms", "tfs")
        dealt = placed.repartition("part").sortWithinPartitions("part")
        dealt.mapInArrow(_ranges, _RANGE).write.options(**ROW_GROUPS).mode("errorifexists").parquet(f"{self.path}/segment={self._next()}")

    def _met(self, queries: DataFrame) -> DataFrame:
        """Every range with every block of queries."""
        asked = queries.select("query_id", "text").mapInArrow(retrieval._packed_queries(self.stemmed, QUERY_BLOCK), "query_ids array<bigint>, asked array<array<string>>")
        asked = Tables(self.spark).keep(asked, "queries")
        return meet(self.ranges().drop("segment", "part"), asked, "8L * size(query_ids) + 16L * size(flatten(asked))")

    def search(self, queries: DataFrame, k: int = retrieval.CANDIDATES) -> DataFrame:
        """The k best documents of each query, exactly: (query_id, id, score, rank), ties by the lowest id.

        A document scores the sum of its weights of the query's distinct terms without stop words, over their number. A
        query of stop words only, a null or an empty one has no hits. Nothing but each task's k best is shuffled.
        """
        best = self._met(queries).mapInArrow(_best_ranges(k), "query_id long, id long, score double")
        return retrieval.top_k(best.withColumn("score", F.round("score", 9)), "query_id", F.desc("score"), "id", k)

    def visited(self, queries: DataFrame, k: int = retrieval.CANDIDATES) -> tuple[int, int]:
        """Posting blocks that a search goes through, and those that its terms have, by query."""
        counts = self._met(queries).mapInArrow(_best_ranges(k, visits=True), "read long, there long")
        return tuple(counts.agg(F.sum("read"), F.sum("there")).first())
