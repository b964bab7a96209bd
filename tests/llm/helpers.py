from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema=DOCS):
    """Documents from (doc_id, text) or full rows."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, schema)
