"""The thin queries of the training-data operators over the driver tables, and their SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import (
    fingerprints, langid, layout, linededup, mixing, neardup, periods, perspectives, pieces, repetition, secrets, turns, urlfilter,
)
from tessella.llm.common import read

#: Rules of op5: fixed values.
URL_RULES = [
    urlfilter.Rule("org", "/", "allow"),
    urlfilter.Rule("example.org", "/es/", "block"),
    urlfilter.Rule("example.org", "/en/1", "block"),
    urlfilter.Rule("com", "/fr/", "allow"),
    urlfilter.Rule("com", "/de/", "block"),
]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, and whether decoding gives the text back (markers in it read as spaces)."""
    docs = read(spark, sf_dir, "documents")
    return pieces.round_trip(docs, hashed=True)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return neardup.group(read(spark, sf_dir, "documents"), width=3, threshold=85)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document: weights 3, 1, 2, share 150 %, at most 2 copies."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict on repetition inside every text."""
    return repetition.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_repeat_chars", "longest_repeat",
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document, through a ledger that starts empty."""
    docs = read(spark, sf_dir, "documents")
    found = secrets.findings(docs, secrets.scan_unseen(docs))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    kinds = [r.kind for r in secrets.BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id",
        *[of(k) for k in kinds],
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(read(spark, sf_dir, "documents"))


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, rendered for each participant."""
    return perspectives.rotate(read(spark, sf_dir, "conversations"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every text and its edited text, and their likeness."""
    return fingerprints.compare(read(spark, sf_dir, "documents"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return layout.extract(read(spark, sf_dir, "pages"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of 20 characters or more that two or more others hold, but for the last of them."""
    kept = linededup.drop_common_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def damaged(said: DataFrame) -> DataFrame:
    """Conversations with the damage of op12's contract; ``times`` is how often a row occurs."""
    given = said.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    code = F.crc32(name.cast("binary")) % 20
    return given.select(
        "conv_id",
        "turn",
        F.when(code == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("times"),
    )


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    return turns.repair(damaged(read(spark, sf_dir, "conversations")), times="times", with_turns=False).drop("turns")


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the repetition that op13's contract plants in one document of ten; none without a key."""
    h = zlib.crc32(str(key).encode())
    n, g = len(words), h // 10
    if key is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, and its words without their repetitions."""
    found = periods.find(read(spark, sf_dir, "documents"), edit=planted)
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256")
    )


_OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || left(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 9))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END::DOUBLE AS weight, 2 * source_size::DOUBLE AS most FROM s),
l AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget, coalesce(sum(most) OVER before, 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open
  FROM w WINDOW before AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT max(CASE WHEN (budget - capped) / open * weight <= most THEN (budget - capped) / open END) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN most ELSE least(most, level * weight) END AS target FROM w, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
b AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
u AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS up_to FROM b),
c AS (
  SELECT p.source, min(h) AS h0, arg_min(words, h) AS words, arg_min(up_to, h) AS up_to
  FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source WHERE up_to > target - copies * source_size GROUP BY p.source),
q AS (
  SELECT p.*, h0 + CASE WHEN 2 * (target - copies * source_size - (up_to - words)) >= words THEN 1 ELSE 0 END AS cut
  FROM p LEFT JOIN c ON p.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, d.source, size, source_size, target, (size * (copies + CASE WHEN h < cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source"""


def _kind_sql(rank: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
    SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind,
           coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0)
             + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s, length(hits[i]) AS n
    FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}', 0) AS hits,
                 regexp_extract_all(t, '{pattern}', {rule.group}) AS vals,
                 unnest(range(1, len(regexp_extract_all(t, '{pattern}', 0)) + 1)) AS i FROM d)
    WHERE length(vals[i]) >= {rule.least}"""


_OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_kind_sql(i, r) for i, r in enumerate(secrets.RULES))}),
by_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS k,
         count(*) FILTER (WHERE kind = 'hex') AS h,
         string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base,
         string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS every
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN by_doc USING (doc_id)"""

_OP8_SQL = """
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said FROM conversations),
party AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM said WHERE speaker <> 'system'),
r AS (
  SELECT conv_id, perspective, turn, speaker, said,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role_name
  FROM said JOIN party ON conv_id IS NOT DISTINCT FROM c),
h AS (
  SELECT *, CASE role_name WHEN 'system' THEN '<|system|>' WHEN 'assistant' THEN '<|assistant|>'
                           ELSE '<|user name=' || speaker || '|>' END || chr(10) AS head FROM r),
s AS (SELECT *, head || said || '<|end|>' || chr(10) AS segment FROM h),
p AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said
                                           ROWS UNBOUNDED PRECEDING) AS up_to FROM s)
SELECT conv_id, perspective, turn, role_name, segment, (up_to - length(segment))::BIGINT AS start, up_to::BIGINT AS "end",
       (up_to - length(segment) + CASE WHEN role_name = 'assistant' THEN length(head) ELSE 0 END)::BIGINT AS mask_start,
       (up_to - length(segment) + CASE WHEN role_name = 'assistant' THEN length(segment) - 1 ELSE 0 END)::BIGINT AS mask_end,
       role_name = 'assistant' AS trained
FROM p"""


_OP11_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, e'\x20\x09\x0A\x0B\x0C\x0D'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
k AS (
  SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT l.*, k.key IS NOT NULL AND doc_id < last AS lost FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE lost))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


_QUERIES = (
    op1_sentencepiece,
    op2_near_duplicates,
    op3_mix_sources,
    op4_repetition,
    op5_url_filter,
    op6_secret_scan,
    op7_language,
    op8_chat_perspectives,
    op9_fingerprints,
    op10_page_text,
    op11_line_dedup,
    op12_turn_repair,
    op13_periodic_runs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": _OP3_SQL, "op6_secret_scan": _OP6_SQL, "op8_chat_perspectives": _OP8_SQL, "op11_line_dedup": _OP11_SQL}
