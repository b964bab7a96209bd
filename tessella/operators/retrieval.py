"""Exact vector search, keyword search and reciprocal-rank fusion, for many queries at once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessella.functions import python_text as P
from tessella.functions import text as T
from tessella.operators import vectorindex
from tessella.operators.blocks import BROADCAST_BYTES, meet
from tessella.session import ship
from tessella.sources.scratch import Tables

#: Fusion constant and candidates a retriever gives a query.
RRF_K = 60
CANDIDATES = 20
#: Fixed value: the limit of sum(1 / j^2), which scales a term's weight to at most 0.1.
ZETA2 = 1.64493406685
#: Words that a query drops.
STOP_WORDS = (
    "a an and are as at be by for from had has have he her his in into is it its not of on or she that the their them then there "
    "these they this to was we were what when where which who will with you your"
).split()
#: Texts of a block.
SLICE = 1024
#: Pairs of a row and a query that a part of an inverted index may have.
PART_HITS = 1 << 19
#: Distinct terms of a block of keyword queries.
BLOCK_TERMS = 8192
_TOKEN = re.compile("[a-z0-9]+")


def top_k(scored: DataFrame, query: str, score: Column, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best rows of each query by score, then ``tie``; ranks start at 1. Spark limits groups before the shuffle."""
    order = Window.partitionBy(query).orderBy(score, tie)
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def knn(queries: DataFrame, corpus: DataFrame, k: int = CANDIDATES, block: int = vectorindex.BLOCK) -> DataFrame:
    """Exact nearest rows by cosine: queries(query_id, q) and corpus(id, v), unit vectors, to (query_id, id, similarity, rank).

    Each task multiplies its blocks of the corpus by the blocks of queries and keeps the k best of each query, so what is
    shuffled is queries * k rows a task, not queries * corpus. A row is no neighbour of the query of the same id.
    Vectors that are null or of another length than the query's are no neighbours; ties go to the lowest id.
    """
    return vectorindex.exact(queries, corpus, k, block)


def postings(docs: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """Inverted index: (term, id, tf), of all terms or of those of ``only`` (query_id, term), which are then kept before they move.

    Terms are counted text by text in the scan. The counts move once, to parts by id, where those of one id are added
    up. With ``only`` a part has about PART_HITS pairs of a row and a query, so that a task's share is the same whatever
    the number of rows, and ``keyword_search`` scores the rows of a part where they are.
    """
    ship(docs.sparkSession)
    counted = docs.select(F.col(key).alias("id"), text)
    schema = StructType([StructField("term", StringType()), counted.schema["id"], StructField("tf", LongType())])
    counted = counted.mapInArrow(term_counts(False, nulls=True), schema)
    if only is None:
        return counted.groupBy("term", "id").agg(F.sum("tf").alias("tf"))
    queries = only.select(F.count_distinct("query_id")).first()[0]
    parts = max(1, -(-docs.count() * queries // PART_HITS))
    kept = counted.join(_small(only).select("term").distinct(), "term", "left_semi")
    return kept.repartition(parts, "id").groupBy("id", "term").agg(F.sum("tf").alias("tf")).select("term", "id", "tf")


def _small(terms: DataFrame) -> DataFrame:
    """The terms of queries, marked to go out to the rows if they are few, as their summed size shows."""
    total = terms.agg(F.sum(F.length("term") + 16)).first()[0] or 0
    return F.broadcast(terms) if total <= BROADCAST_BYTES else terms


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct terms of each query without stop words, and their number: (query_id, term, n_terms)."""
    kept = F.array_distinct(F.filter(T.tokens(text), lambda w: ~w.isin(STOP_WORDS)))
    return queries.select(F.col(key).alias("query_id"), kept.alias("terms")).select(
        "query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms")
    )


def keyword_search(terms: DataFrame, index: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Rows that hold any term of a query, by the sum of 0.1 * sum(1/j^2, j <= tf) / ZETA2 over the terms, per query term."""
    weight = F.aggregate(F.sequence(F.lit(1), F.col("tf").cast("int")), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))
    # A posting's weight is worked out once, not once for each query that holds its term.
    weighed = index.select("term", "id", (0.1 * weight / ZETA2).alias("weight"))
    hits = weighed.join(_small(terms), "term").select("query_id", "id", (F.col("weight") / F.col("n_terms")).alias("part"))
    scored = hits.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    return top_k(scored, "query_id", F.desc("score"), "id", k)


def keyword_top(queries: DataFrame, docs: DataFrame, k: int = CANDIDATES, stemmed: bool = False, block: int = 256) -> DataFrame:
    """The k best rows of docs(id, text) for each of queries(query_id, text), scored as by ``keyword_search``, in one scan.

    Texts are packed in the scan, as the counts of their terms, and every block of queries meets every block of texts
    (``blocks.meet``); each pair keeps the k best of each query, so neither postings nor hits are shuffled. With
    ``stemmed`` both sides are compared by Porter stems. Rows of one id count as one text if they meet in a task, so ids
    have to be unique. A null or empty text, or a query of stop words only, has no hits; ties go to the lowest id.
    """
    ship(docs.sparkSession)
    asked = queries.select("query_id", "text").mapInArrow(_packed_queries(stemmed, block), "query_ids array<bigint>, asked array<array<string>>")
    asked = Tables(docs.sparkSession).keep(asked, "queries")
    blocks = docs.select("id", "text").mapInArrow(_packed_texts(stemmed), "ids array<bigint>, texts array<int>, terms array<string>, tfs array<bigint>")
    pairs = meet(blocks, asked, "8L * size(query_ids) + 16L * size(flatten(asked))")
    return top_k(pairs.mapInArrow(_best_texts(k), "query_id long, id long, score double"), "query_id", F.desc("score"), "id", k)


def term_counts(stemmed: bool = False, nulls: bool = False):
    """Task function: (id, text) to each text's distinct terms and how often it has them: (term, id, tf).

    Texts without an id are left out, unless ``nulls`` keeps them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] = {}
        for batch in batches:
            sizes, terms, numbers = np.zeros(batch.num_rows, dtype=np.int64), [], []
            for place, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if (nulls or key is not None) and text:
                    found = counted(text, stemmed, stems)
                    sizes[place] = len(found)
                    terms += found
                    numbers += found.values()
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            columns = [pa.array(terms, type=pa.string()), ids, pa.array(numbers, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "id", "tf"])

    return run


def _packed_texts(stemmed: bool):
    """Task function: (id, text) to blocks of texts: their ids, and of each distinct term of each text the text's place, the term and its count."""
    count = term_counts(stemmed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            for found in count(iter([batch])):
                if found.num_rows:
                    ids, place = np.unique(found.column("id").to_numpy(), return_inverse=True)
                    lists = [pa.array([ids]), pa.array([place.astype(np.int32)])]
                    lists += [pa.ListArray.from_arrays(pa.array([0, found.num_rows], pa.int32()), found.column(c)) for c in ("term", "tf")]
                    yield pa.RecordBatch.from_arrays(lists, names=["ids", "texts", "terms", "tfs"])

    return run


def _packed_queries(stemmed: bool, block: int):
    """Task function: (query_id, text) to blocks of queries of at most ``block`` queries and BLOCK_TERMS terms, or one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[str]]] = []
        seen: set[str] = set()

        def given() -> pa.RecordBatch:
            lists = [pa.array([[q for q, _ in held]], pa.list_(pa.int64())), pa.array([[t for _, t in held]], pa.list_(pa.list_(pa.string())))]
            return pa.RecordBatch.from_arrays(lists, names=["query_ids", "asked"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain = [w for w in _words(text, False, {}) if w not in STOP_WORDS]
                terms = sorted({P.stem(w) for w in plain} if stemmed else set(plain))
                if not terms:
                    continue
                if held and (len(held) == block or len(seen.union(terms)) > BLOCK_TERMS):
                    yield given()
                    held, seen = [], set()
                held.append((key, terms))
                seen.update(terms)
        if held:
            yield given()

    return run


def counted(text: str, stemmed: bool, stems: dict[str, str]) -> dict[str, int]:
    """Distinct terms of a text and how often it has them; ``stems`` remembers the stems of words, up to a bound."""
    words = Counter(_TOKEN.findall(text.lower()))
    if not stemmed:
        return words
    if len(stems) > 200_000:
        stems.clear()
    found: dict[str, int] = {}
    for word, n in words.items():
        if (term := stems.get(word)) is None:
            term = stems[word] = P.stem(word)
        found[term] = found.get(term, 0) + n
    return found


def _words(text: str | None, stemmed: bool, stems: dict[str, str]) -> list[str]:
    words = _TOKEN.findall((text or "").lower())
    if not stemmed:
        return words
    for w in set(words).difference(stems):
        stems[w] = P.stem(w)
    return [stems[w] for w in words]


def by_term(asked: list[list[str]]) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of terms; of each term in this order its queries and their shares, and where a term's begin."""
    numbers: dict[str, int] = {}
    for terms in asked:
        for term in terms:
            numbers.setdefault(term, len(numbers))
    pairs = sorted((numbers[t], q, 1.0 / len(terms)) for q, terms in enumerate(asked) for t in terms)
    term, query, share = (np.array(c) for c in zip(*pairs, strict=True))
    return numbers, query, share, np.searchsorted(term, np.arange(len(numbers) + 1))


def _best_texts(k: int):
    """Task function: the k best texts of a block for each query of a block, for each joined pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[tuple, tuple] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                array = lambda name: batch.column(batch.schema.get_field_index(name))[i].values  # noqa: B023, E731
                ids, queries = array("ids").to_numpy(), array("query_ids").to_numpy()
                name = (queries.tobytes(), len(queries))
                if known is None or known[0] != name:
                    known = name, by_term(array("asked").to_pylist())
                numbers, query, share, first = known[1]
                # A term is looked up once a block.
                coded = array("terms").dictionary_encode()
                place = np.array([numbers.get(t, -1) for t in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()]
                hit = np.flatnonzero(place >= 0)
                if not len(hit):
                    continue
                held, doc, tf = place[hit], array("texts").to_numpy()[hit].astype(np.int64), array("tfs").to_numpy()[hit]
                # The weight of a term that a text has tf times: 0.1 * sum(1/j^2, j <= tf) / ZETA2.
                weight = 0.1 * np.cumsum(1.0 / np.arange(1, tf.max() + 1, dtype=np.float64) ** 2)[tf - 1] / ZETA2
                number = first[held + 1] - first[held]
                at = np.arange(number.sum()) + np.repeat(first[held] - (np.cumsum(number) - number), number)
                cell = query[at] * len(ids) + np.repeat(doc, number)
                scores = np.bincount(cell, weights=np.repeat(weight, number) * share[at], minlength=len(ids) * len(queries))
                scores = np.round(scores, 9).reshape(len(queries), -1)
                row, column = vectorindex.best_cells(np.where(scores > 0, scores, -np.inf), ids, k)
                found = [pa.array(queries[row]), pa.array(ids[column]), pa.array(scores[row, column])]
                yield pa.RecordBatch.from_arrays(found, names=["query_id", "id", "score"])

    return run


def fuse(vector: DataFrame, keyword: DataFrame, k: int = 5, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: sum of 1 / (constant + rank), best k of each query."""
    v = vector.select("query_id", "id", F.col("rank").alias("vector_rank"), "similarity")
    w = keyword.select("query_id", "id", F.col("rank").alias("keyword_rank"))
    both = v.join(w, ["query_id", "id"], "full_outer")
    part = lambda r: F.coalesce(1.0 / (constant + F.col(r)), F.lit(0.0))
    found = (
        F.when(F.col("vector_rank").isNotNull() & F.col("keyword_rank").isNotNull(), "both")
        .when(F.col("vector_rank").isNotNull(), "vector")
        .otherwise("keyword")
    )
    scored = both.withColumn("rrf_score", F.round(part("vector_rank") + part("keyword_rank"), 9)).withColumn("found_by", found)
    return top_k(scored, "query_id", F.desc("rrf_score"), "id", k, "position")


def fuse_by_union(lists: list[DataFrame], k: int = 5, constant: int = RRF_K) -> DataFrame:
    """The same fusion of any number of lists, as one aggregation instead of joins: (query_id, id, rrf_score, position)."""
    every = lists[0].select("query_id", "id", "rank")
    for more in lists[1:]:
        every = every.unionByName(more.select("query_id", "id", "rank"))
    scored = every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("rrf_score"))
    return top_k(scored, "query_id", F.desc("rrf_score"), "id", k, "position")
