"""Queries on search, the semantic cache and grounded answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import vector as V
from tessella.operators import answering, cache, keywordindex, retrieval, vectorindex
from tessella.sources.files import spread, table
from tessella.sources.scratch import Tables

#: Queries are all rows whose id is divisible by this, against all rows.
EVERY = 100


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.knn(_vector_queries(spark, d), _vectors(spark, d))
    return found.select("query_id", "id", "similarity", F.col("rank").cast("long").alias("rank"))


_DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
_KNN = f"""
SELECT query_id, id, similarity, rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS id, round({_DOT.format(a="q.embedding", b="c.embedding")}, 9) AS similarity,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT.format(a="q.embedding", b="c.embedding")}, 9) DESC, c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0)
WHERE rank <= 20"""


def keyword_search_or(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = retrieval.keyword_top(queries, spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")))
    return found.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
_KEYWORD = f"""
WITH terms AS (
  SELECT item_id AS query_id, unnest(t) AS term, len(t) AS n_terms FROM (
    SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ({_STOP}))) AS t FROM benchmark)),
tf AS (
  SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
  WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
scored AS (
  SELECT query_id, id, round(sum(0.1 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j))) / {retrieval.ZETA2}::DOUBLE / n_terms), 9) AS score
  FROM tf JOIN terms USING (term) GROUP BY query_id, id)
SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 20"""


def keyword_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The same search over an inverted index of the documents."""
    terms = retrieval.query_terms(table(spark, d, "benchmark"), "item_id", "text")
    found = retrieval.keyword_search(terms, retrieval.postings(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", terms))
    return found.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def knn_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same queries by an inverted-file index of all vectors: the cells nearest to each."""
    index = vectorindex.VectorIndex.build(_vectors(spark, d), f"{Tables(spark).root}/vectors")
    found = index.search(_vector_queries(spark, d), retrieval.CANDIDATES)
    return found.select("query_id", "id", "similarity", F.col("rank").cast("long").alias("rank"))


def knn_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same by the index's exact way: further cells, until the bounds rule out the rest."""
    index = vectorindex.VectorIndex.build(_vectors(spark, d), f"{Tables(spark).root}/vectors")
    found = index.search(_vector_queries(spark, d), retrieval.CANDIDATES, whole=True)
    return found.select("query_id", "id", "similarity", F.col("rank").cast("long").alias("rank"))


def _stored(spark: SparkSession, d: str, stemmed: bool) -> DataFrame:
    """Keyword search over a stored index, whose segments hold the documents of even and of odd numbers."""
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    index = keywordindex.KeywordIndex(spark, f"{Tables(spark).root}/postings", stemmed)
    for part in (0, 1):
        index.append(docs.where(f"id % 2 = {part}"))
    found = index.search(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return found.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def keyword_stored_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search over stored posting blocks; blocks that cannot reach the k-th score are not read."""
    return _stored(spark, d, stemmed=False)


def keyword_stemmed_search(spark: SparkSession, d: str) -> DataFrame:
    """The same over an index of Porter stems."""
    return _stored(spark, d, stemmed=True)


def _hybrid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both lists of every benchmark item: by the vector of the same number, and by its words."""
    vectors = table(spark, d, "embeddings")
    items = table(spark, d, "benchmark").select("item_id")
    queries = vectors.join(items, F.col("vec_id") == F.col("item_id")).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.knn(queries, _vectors(spark, d)), keyword_search_or(spark, d)


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    fused = retrieval.fuse(*_hybrid(spark, d))
    # A list that lacks the row gives rank 0.
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("vector_rank", "keyword_rank", "position")]
    return fused.select("query_id", "id", *longs, "similarity", "rrf_score", "found_by")


_LISTS = f"""
v AS (SELECT query_id, id, similarity, rank AS vector_rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS id, round({_DOT.format(a="q.embedding", b="c.embedding")}, 9) AS similarity,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT.format(a="q.embedding", b="c.embedding")}, 9) DESC, c.vec_id) AS rank
  FROM embeddings q JOIN benchmark ON q.vec_id = item_id JOIN embeddings c ON c.vec_id <> q.vec_id) WHERE rank <= 20),
k AS (SELECT query_id, id, rank AS keyword_rank FROM ({_KEYWORD}))"""
_RRF = f"""
WITH {_LISTS},
f AS (SELECT query_id, id, vector_rank, keyword_rank, similarity,
             round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0), 9) AS rrf_score,
             CASE WHEN vector_rank IS NOT NULL AND keyword_rank IS NOT NULL THEN 'both' WHEN vector_rank IS NOT NULL THEN 'vector' ELSE 'keyword' END AS found_by
      FROM v FULL JOIN k USING (query_id, id))
SELECT * REPLACE (coalesce(vector_rank, 0) AS vector_rank, coalesce(keyword_rank, 0) AS keyword_rank)
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS position FROM f) WHERE position <= 5"""


def rrf_by_union(spark: SparkSession, d: str) -> DataFrame:
    fused = retrieval.fuse_by_union(list(_hybrid(spark, d)))
    return fused.select("query_id", "id", "rrf_score", F.col("position").cast("long").alias("position"))


_RRF_UNION = f"SELECT query_id, id, rrf_score, position FROM ({_RRF})"


def vector_distance(spark: SparkSession, d: str) -> DataFrame:
    """Cosine distance of each vector to the next number's, and the vector's first component as text."""
    a = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    literal = F.length(V.literal(F.transform("embedding", lambda x: F.signum(x).cast("int")))).cast("long")
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine_distance("embedding", "other"), 9).alias("distance"), literal.alias("literal_size"))


_DISTANCE = """
SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance,
       length('[' || array_to_string(list_transform(a.embedding, lambda x: sign(x)::INT), ',') || ']')::BIGINT AS literal_size
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def cache_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Requests are the vectors whose id is divisible by 100, entries all others; a label is a user."""
    vectors = table(spark, d, "embeddings").withColumn("user_id", F.col("label").cast("string"))
    ids = lambda c: T.identifiers(F.concat(F.lit("order A-"), (1000 + F.col(c) % 3).cast("string"), F.lit(" please")))
    asked = vectors.where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("request_id"), "user_id", F.col("embedding").alias("q"), ids("vec_id").alias("ids"))
    held = vectors.where(f"vec_id % {EVERY} <> 0").select(F.col("vec_id").alias("entry_id"), "user_id", F.col("embedding").alias("v"), ids("vec_id").alias("entry_ids"))
    return cache.lookup(asked, held, threshold=0.25).withColumn("entry_id", F.coalesce("entry_id", F.lit(-1)))


_CACHE = f"""
WITH s AS (
  SELECT q.vec_id AS request_id, e.vec_id AS entry_id, round({_DOT.format(a="q.embedding", b="e.embedding")}, 9) AS score, q.vec_id % 3 = e.vec_id % 3 AS same
  FROM (SELECT * FROM embeddings WHERE vec_id % {EVERY} = 0) q LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % {EVERY} <> 0) e USING (label)),
g AS (
  SELECT request_id, count(entry_id) AS n, count(*) FILTER (WHERE score >= 0.25 AND NOT same) AS blocked,
         first(entry_id ORDER BY score DESC, entry_id) FILTER (WHERE score >= 0.25 AND same) AS ce, max(score) FILTER (WHERE score >= 0.25 AND same) AS cs,
         first(entry_id ORDER BY score DESC, entry_id) FILTER (WHERE score >= 0.25 AND NOT same) AS ve, max(score) FILTER (WHERE score >= 0.25 AND NOT same) AS vs
  FROM s GROUP BY request_id)
SELECT request_id, ce IS NOT NULL AS hit,
       CASE WHEN ce IS NOT NULL THEN 'hit' WHEN n = 0 THEN 'empty' WHEN ve IS NOT NULL THEN 'identifier guard' ELSE 'below threshold' END AS reason,
       coalesce(ce, ve, -1) AS entry_id, coalesce(cs, vs) AS score, blocked FROM g"""


def cache_counters(spark: SparkSession, d: str) -> DataFrame:
    return cache.counters(cache_outcomes(spark, d))


_COUNTERS = f"""
SELECT count(*) AS lookups, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses,
       count(*) FILTER (WHERE reason = 'identifier guard') AS blocked, count(*) FILTER (WHERE reason = 'below threshold') AS below,
       count(*) FILTER (WHERE reason = 'empty') AS empty, round(coalesce(100.0::DOUBLE * count(*) FILTER (WHERE hit) / nullif(count(*), 0), 0), 6) AS hit_rate
FROM ({_CACHE})"""


def cache_live(spark: SparkSession, d: str) -> DataFrame:
    """Events as cache entries: those of the last hour before the newest one, at most 500 a user."""
    entries = table(spark, d, "events").select("user_id", F.col("event_id").alias("entry_id"), F.col("ts").alias("created_at"))
    now = entries.agg(F.max("created_at")).scalar()
    return cache.newest(cache.live(entries, now, 6 * cache.TTL_SECONDS)).select("user_id", "entry_id")


_LIVE = """
SELECT user_id, event_id AS entry_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events
  WHERE ts + INTERVAL 6 HOUR > (SELECT max(ts) FROM events)) WHERE n <= 500"""


def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    """Context of each benchmark item from the passages of its keyword search."""
    hits = keyword_search_or(spark, d).where("rank <= 3")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("page"), "text")
    return answering.context(hits.join(docs, "id"))


_CONTEXT = f"""
SELECT query_id, string_agg('[Passage ' || rank || '] (page ' || (doc_id % 10) || ')' || chr(10) || text,
                            chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM ({_KEYWORD}) h JOIN documents ON doc_id = id WHERE rank <= 3 GROUP BY query_id"""


def answer_decision(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item as a question: three hits by number, a recorded reply of one of six shapes."""
    items = table(spark, d, "benchmark")
    docs = table(spark, d, "documents").select("doc_id", "text")
    near = (F.col("item_id") % 5).cast("double") / 5
    spread = items.where("item_id % 6 <> 0").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    hits = spread.join(docs, F.col("doc_id") == F.col("item_id") + F.col("n"))
    lists = hits.groupBy("item_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("n", "doc_id", "text"))),
            lambda h: F.struct(h["doc_id"].cast("int").alias("page"), h["text"].alias("text"), F.lit(0.0).alias("similarity")),
        ).alias("hits")
    )
    kind = F.col("item_id") % 6
    reply = (
        F.when(kind == 1, F.lit("not json"))
        .when(kind == 2, F.lit('{"sufficient_context": false, "answer": "", "citations": []}'))
        .when(kind == 3, F.lit('{"sufficient_context": true, "answer": "it is 7", "citations": [9]}'))
        .otherwise(F.concat(F.lit('```json\n{"sufficient_context": true, "answer": "grade '), F.col("item_id").cast("string"), F.lit(' of 31", "citations": [1, 2, 7]}\n```')))
    )
    asked = items.join(lists, "item_id", "left").select(
        F.col("item_id").alias("query_id"),
        F.transform("hits", lambda h: h.withField("similarity", near)).alias("hits"),
        reply.alias("reply"),
    )
    out = answering.decide(asked)
    texts = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("query_id", "grounded", "reason", "answer", "best_similarity", texts("cited_pages"), texts("invalid_citations"),
                      F.coalesce("checked_facts", F.lit(-1)).cast("long").alias("checked_facts"), texts("unsupported"), "verdict")


_DECISION = """
WITH q AS (
  SELECT item_id, item_id % 6 AS kind, (item_id % 5) / 5.0::DOUBLE AS near,
         (SELECT count(*) FROM documents WHERE doc_id BETWEEN item_id AND item_id + 2) AS n,
         (SELECT string_agg(lower(text), ' ' ORDER BY doc_id) FROM documents WHERE doc_id BETWEEN item_id AND item_id + 1) AS cited
  FROM benchmark),
r AS (
  SELECT *, CASE WHEN kind = 0 OR n = 0 THEN 'no_results' WHEN near < 0.25 THEN 'below_similarity_gate' WHEN kind = 1 THEN 'invalid_model_output'
                 WHEN kind = 2 THEN 'model_said_insufficient' WHEN kind = 3 THEN 'no_valid_citations' END AS reason,
         list_distinct([item_id::VARCHAR, '31']) AS facts FROM q),
m AS (SELECT *, list_filter(CASE WHEN item_id = 31 THEN ['31'] ELSE [item_id::VARCHAR, '31'] END, lambda f: NOT contains(cited, f)) AS missing FROM r)
SELECT item_id AS query_id, reason IS NULL AS grounded, reason,
       CASE WHEN reason IS NULL THEN 'grade ' || item_id || ' of 31' WHEN reason = 'no_valid_citations' THEN 'it is 7' END AS answer,
       CASE WHEN kind = 0 OR n = 0 THEN -1.0 ELSE near END AS best_similarity,
       CASE WHEN reason IS NULL THEN item_id || ',' || (item_id + 1) END AS cited_pages,
       CASE WHEN reason IS NULL THEN '7' WHEN reason = 'no_valid_citations' THEN '9' ELSE '' END AS invalid_citations,
       CASE WHEN reason IS NULL THEN len(facts) ELSE -1 END AS checked_facts,
       CASE WHEN reason IS NULL THEN array_to_string(missing, ',') END AS unsupported,
       CASE WHEN reason IS NULL THEN CASE WHEN len(missing) = 0 THEN 'all_facts_appear_in_citations' ELSE 'some_facts_not_found_in_citations' END END AS verdict
FROM m"""


def fact_support(spark: SparkSession, d: str) -> DataFrame:
    """Facts of every document, against the text of the document of the previous number."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("cited"))
    both = docs.select("doc_id", T.facts("text").alias("facts")).join(before, "doc_id")
    missing = T.unsupported_facts(F.col("facts"), F.col("cited"))
    return both.select("doc_id", F.size("facts").cast("long").alias("checked"), F.size(missing).cast("long").alias("unsupported"), T.support_verdict(F.col("facts"), missing).alias("verdict"))


_SUPPORT = r"""
WITH f AS (SELECT doc_id, list_distinct(list_transform(list_concat(regexp_extract_all(text, '\b[0-9][0-9,.:]*\b'), regexp_extract_all(text, '\b[A-Z]{2,}-[0-9]+\b')),
                  lambda x: regexp_replace(lower(x), '[.,]$', ''))) AS facts FROM documents),
m AS (SELECT a.doc_id, facts, list_filter(facts, lambda x: NOT contains(lower(b.text), x)) AS missing FROM f a JOIN documents b ON b.doc_id = a.doc_id - 1)
SELECT doc_id, len(facts)::BIGINT AS checked, len(missing)::BIGINT AS unsupported,
       CASE WHEN len(facts) = 0 THEN 'no_checkable_facts' WHEN len(missing) = 0 THEN 'all_facts_appear_in_citations' ELSE 'some_facts_not_found_in_citations' END AS verdict
FROM m"""

QUERIES = {f.__name__: f for f in (knn_topk, knn_index_topk, knn_index_exact, keyword_search_or, keyword_index_search, keyword_stored_search, keyword_stemmed_search, rrf_hybrid, rrf_by_union, vector_distance, cache_outcomes, cache_counters, cache_live, prompt_context, answer_decision, fact_support)}
SQL = {
    "knn_topk": _KNN,
    "knn_index_exact": _KNN,
    "keyword_search_or": _KEYWORD,
    "keyword_stored_search": _KEYWORD,
    "rrf_hybrid": _RRF,
    "rrf_by_union": _RRF_UNION,
    "vector_distance": _DISTANCE,
    "keyword_index_search": _KEYWORD,
    "cache_outcomes": _CACHE,
    "cache_counters": _COUNTERS,
    "cache_live": _LIVE,
    "prompt_context": _CONTEXT,
    "answer_decision": _DECISION,
    "fact_support": _SUPPORT,
}
