"""The vector index and the stored keyword index against exact searches."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import python_text as P
from tessella.operators import blocks, keywordindex, retrieval, vectorindex
from tessella.plans import retrieval as plans
from tessella.sources.files import table

HITS = "query_id long, q array<float>"


def unit(rng, n, width=24, around=None):
    rows = rng.standard_normal((n, width)) + (0 if around is None else around)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def clustered(spark):
    """4,000 vectors around 40 points, a third of them equal, some null or of another length."""
    rng = np.random.default_rng(3)
    points = rng.standard_normal((40, 24)) * 2
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([unit(rng, 60, around=p) for p in points]))]
    rows += [(10_000 + i, rows[7][1]) for i in range(1_300)]
    rows += [(20_000, None), (20_001, [1.0, 0.0]), (20_002, []), (None, rows[0][1])]
    return spark.createDataFrame(rows, "id long, v array<float>").repartition(5)


def hits(df):
    return {(r.query_id, r["rank"]): (r.id, r.similarity) for r in df.collect()}


def test_index_holds_every_row_and_finds_most_neighbours(spark, clustered, tmp_path):
    index = vectorindex.VectorIndex.build(clustered, str(tmp_path / "index"), sample_rows=2_000, most_cells=30)
    held = [r[0] for r in index.blocks().select(F.explode("ids")).collect()]
    assert sorted(held) == sorted(r.id for r in clustered.where("size(v) = 24 and id is not null").collect())
    assert index.blocks().agg(F.max(F.size("ids"))).first()[0] <= vectorindex.BLOCK
    queries = clustered.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    want = hits(retrieval.knn(queries, clustered, 10))
    found = hits(index.search(queries, 10, probes=4))
    close = lambda got: np.mean([s >= want[key][1] - 1e-9 for key, (_, s) in got.items()])
    assert close(found) >= 0.9 and len(found) == len(want)
    assert hits(index.search(queries, 10, probes=1, whole=True)) == want
    assert hits(index.search(queries, 10, probes=30)) == want


def test_appended_rows_are_found(spark, clustered, tmp_path):
    index = vectorindex.VectorIndex.build(clustered.where("id < 1000"), str(tmp_path / "index"), most_cells=8)
    index.append(clustered.where("id >= 1000"))
    queries = clustered.where("id % 500 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    assert hits(index.search(queries, 5, whole=True)) == hits(retrieval.knn(queries, clustered, 5))


def test_index_of_an_empty_table_and_unknown_widths(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, v array<float>")
    index = vectorindex.VectorIndex.build(empty, str(tmp_path / "a"))
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], HITS)
    assert index.search(queries, 3).count() == 0
    index = vectorindex.VectorIndex.build(spark.createDataFrame([(5, [0.6, 0.8]), (1, [1.0, 0.0])], "id long, v array<float>"), str(tmp_path / "b"))
    assert [(r.query_id, r.id) for r in index.search(queries, 3).collect()] == [(1, 5)]
    assert index.search(spark.createDataFrame([(1, [1.0])], HITS), 3).count() == 0


def test_recall_of_the_query(spark, sf_dir):
    want = hits(plans.knn_topk(spark, sf_dir))
    found = {(q, i) for (q, _), (i, _) in hits(plans.knn_index_topk(spark, sf_dir)).items()}
    assert len(found & {(q, i) for (q, _), (i, _) in want.items()}) >= 0.9 * len(want)


def test_many_queries_are_dealt_to_shares(spark, clustered, monkeypatch):
    queries = clustered.where("id < 200").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    want = hits(retrieval.knn(queries, clustered, 3))
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    dealt = retrieval.knn(queries, clustered, 3, block=32)
    assert hits(dealt) == want
    assert "BroadcastNestedLoopJoin" not in dealt._jdf.queryExecution().executedPlan().toString()


# --- stored keyword index


WORDS = "river bridge stone walks running runner runs cities city lights happily happy under over seven eleven".split()


def some_docs(rng, ids):
    return [(i, " ".join(rng.choices(WORDS[: rng.randrange(2, len(WORDS))], k=rng.randrange(30)))) for i in ids]


def plain_search(docs, queries, k, stemmed=False):
    """The k best of each query by the definition of the score."""
    form = P.stem if stemmed else str
    out = {}
    for q, text in queries:
        kept = [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if w not in retrieval.STOP_WORDS]
        terms = {form(w) for w in kept}
        found = []
        for i, t in docs:
            words = [form(w) for w in re.findall("[a-z0-9]+", (t or "").lower())]
            score = sum(0.1 * sum(1 / j**2 for j in range(1, words.count(x) + 1)) / retrieval.ZETA2 / len(terms) for x in terms)
            if score > 0:
                found.append((-round(score, 9), i))
        out |= {(q, n): (i, -s) for n, (s, i) in enumerate(sorted(found)[:k], 1)}
    return out


def scored(df):
    return {(r.query_id, r["rank"]): (r.id, r.score) for r in df.collect()}


QUERIES = [(1, "the river under a bridge"), (2, "Running cities"), (3, "the of and"), (4, None), (5, "seven seven eleven unknown"), (6, "happily")]


@pytest.mark.parametrize("stemmed", [False, True])
def test_stored_search_equals_the_definition(spark, tmp_path, monkeypatch, stemmed):
    monkeypatch.setattr(keywordindex, "RANGE_DOCS", 8)
    rng = random.Random(4)
    docs = [*some_docs(rng, range(400)), (900, None), (901, ""), (902, "!!")]
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    index = keywordindex.KeywordIndex(spark, str(tmp_path / "index"), stemmed)
    for part in (docs[:250], docs[250:]):  # an appended segment
        index.append(spark.createDataFrame(part, "id long, text string"))
    assert scored(index.search(queries, 5)) == plain_search(docs, QUERIES, 5, stemmed)
    assert scored(keywordindex.KeywordIndex(spark, str(tmp_path / "index"), stemmed).search(queries, 3)) == plain_search(docs, QUERIES, 3, stemmed)
    top = scored(retrieval.keyword_top(queries, spark.createDataFrame(docs, "id long, text string"), 5, stemmed))
    assert top == plain_search(docs, QUERIES, 5, stemmed)


def test_blocks_below_the_bound_are_not_read(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(keywordindex, "RANGE_DOCS", 4)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = keywordindex.KeywordIndex(spark, str(tmp_path / "index"))
    index.append(docs)
    read, there = index.visited(queries, 1)
    assert 0 < read < 0.8 * there


def test_many_keyword_queries_are_dealt_to_shares(spark, monkeypatch):
    rng = random.Random(8)
    docs = spark.createDataFrame(some_docs(rng, range(150)), "id long, text string").repartition(3)
    queries = spark.createDataFrame(some_docs(rng, range(40)), "query_id long, text string")
    want = scored(retrieval.keyword_top(queries, docs, 4))
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    assert scored(retrieval.keyword_top(queries, docs, 4, block=7)) == want


def test_posting_blocks_add_up_counts_of_one_id_across_batches():
    import pyarrow as pa

    from tessella.operators import keywordindex, retrieval

    rows = [("a", 0, 1, 1), ("a", 0, 1, 1), ("a", 0, 2, 3), ("a", 1, 9, 1), *[("b", 0, i, 1) for i in range(keywordindex.BLOCK_POSTINGS + 1)]]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("term", "part", "id", "tf"), r))], schema=pa.schema({"term": pa.string(), "part": pa.int32(), "id": pa.int64(), "tf": pa.int64()})) for r in rows]
    blocks = [b for batch in keywordindex._posting_blocks(iter(batches)) for b in batch.to_pylist()]
    assert [(b["term"], b["part"], len(b["ids"])) for b in blocks] == [("a", 0, 2), ("a", 1, 1), ("b", 0, keywordindex.BLOCK_POSTINGS), ("b", 0, 1)]
    one = 0.1 / retrieval.ZETA2
    assert blocks[0]["ids"] == [1, 2] and abs(blocks[0]["weights"][0] - 1.25 * one) < 1e-15 and blocks[0]["most"] == max(blocks[0]["weights"])


def test_parts_of_an_inverted_index_grow_in_number_only(spark, monkeypatch):
    """Counts move once, by id; a part has as many rows whatever the size of the table, and is scored where it is."""
    monkeypatch.setattr(retrieval, "PART_HITS", 200)
    rng = random.Random(6)
    docs = some_docs(rng, range(300))
    asked = [(q, text) for q, text in QUERIES if q in (1, 2, 5)]
    terms = retrieval.query_terms(spark.createDataFrame(asked, "query_id long, text string"), "query_id", "text")
    given = lambda rows: spark.createDataFrame(rows, "id long, text string")
    for n in (100, 300):
        index = retrieval.postings(given(docs[:n]), "id", "text", terms)
        assert index.rdd.getNumPartitions() == -(-n * 3 // 200)
        found = retrieval.keyword_search(terms, index, 5)
        assert scored(found) == plain_search(docs[:n], asked, 5)
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("REPARTITION_BY_NUM") == 1 and "hashpartitioning(query_id#" in plan
        assert not re.search(r"Exchange hashpartitioning\((term|id|query_id)#\d+L?, (term|id)#", plan)


@pytest.mark.parametrize("only", [True, False])
def test_postings_of_repeated_and_missing_ids(spark, monkeypatch, only):
    monkeypatch.setattr(retrieval, "PART_HITS", 2)
    rows = [("x", "a b B"), (None, "b"), ("x", "b c"), (None, "B b"), ("y", None), ("z", "")]
    docs = spark.createDataFrame(rows, "name string, text string").repartition(3)
    asked = spark.createDataFrame([(1, "b"), (2, "b"), (2, "nothing")], "query_id long, term string") if only else None
    got = sorted((r.term, r.id or "", r.tf) for r in retrieval.postings(docs, "name", "text", asked).collect())
    assert got == [r for r in [("a", "x", 1), ("b", "", 3), ("b", "x", 3), ("c", "x", 1)] if not only or r[0] == "b"]


@pytest.mark.parametrize("shares", [False, True])
def test_stored_search_shuffles_texts_and_best_rows_only(spark, tmp_path, monkeypatch, shares):
    """No posting and no hit is a row of a shuffle; texts of one id, cut by batches, are one document."""
    monkeypatch.setattr(keywordindex, "RANGE_DOCS", 8)
    monkeypatch.setattr(keywordindex, "FIRST_RANGES", 1)
    if shares:
        monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(keywordindex, "QUERY_BLOCK", 2, raising=False)
    rng = random.Random(11)
    docs = some_docs(rng, range(120))
    rows = [*docs, *some_docs(rng, range(0, 120, 3)), *[(7, "river bridge")] * 20, (None, "river")]
    whole = {}
    for i, text in rows:
        if i is not None:
            whole[i] = f"{whole.get(i, '')} {text}"
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "3")
        index = keywordindex.KeywordIndex(spark, str(tmp_path / "index"), True)
        index.append(spark.createDataFrame(rows, "id long, text string").repartition(3))
        found = index.search(spark.createDataFrame(QUERIES, "query_id long, text string"), 5)
        assert scored(found) == plain_search(list(whole.items()), QUERIES, 5, True)
    finally:
        spark.conf.set(size, before)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not re.search(r"Exchange hashpartitioning\((segment#|term#|part#|query_id#\d+L?, id#)", plan)


def test_stems_of_words_with_y_and_long_ends():
    words = "yes syzygy happy sky dying trying employed conflated hopping filing hissing agreed rationalizations generalizations controll yyy"
    assert [P.stem(w) for w in words.split()] == "ye syzygi happi sky dy try emploi conflat hop file hiss agre ration gener control yyi".split()
