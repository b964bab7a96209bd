"""A training-data pipeline over the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import langid, mixing, neardup, pieces, secrets
from tessella.llm.common import Scratch, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose words' languages are found with a mean certainty of 0.5 or more; lang becomes the leading one.

    Null and empty texts and those without letters go, and all where no row has a language. Repeated rows fare alike;
    an empty table gives none.
    """
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, width: int = 3, threshold: int = 85) -> DataFrame:
    """One document of each group of near duplicates, by shingles of ``width`` words and ``threshold`` percent.

    The one of the smallest doc_id stays, null the largest; where ids repeat, the text decides and of equal rows one
    stays. Null, empty and wordless texts are no duplicates of anything. An empty table gives none.
    """
    return neardup.keep_one(docs, width=width, threshold=threshold)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stage: shingles of five words, and a similarity of 0.8 or more."""
    return drop_near_duplicates(spark, docs, sf_dir, 5, 80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text masked; null texts stay null, repeated rows are masked alike."""
    return secrets.redact_versions(docs, secrets.scan_unseen(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one of its own.

    Texts without words have size 0 and go with the documents of their hash; rows of one doc_id and text go together.
    """
    return mixing.repeat(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text: doc_id, ids, n_pieces, n_bytes, decoded; none for null and empty texts."""
    return pieces.round_trip(docs)


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_copies),
    ("secret masking", mask_secrets),
    ("source mixing", mix_sources),
    ("piece encoding", encode_pieces),
]

#: Learned labels, sketches and segmentations are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again but for the last; read tables are deleted."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            before.drop()
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
