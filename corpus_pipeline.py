"""A training-data pipeline over the documents table, a stage for each operator used.

Quality classifier, exact dedup, SimHash near-dedup completed by shingle similarity, mixing to
target weights, SentencePiece encoding and decoding. Each stage takes what its predecessor
kept; all but the last return the columns of documents, whole rows only. Rows are told apart
by identifier and text, so that rows without an identifier, or that share one, are judged
each by its own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm.common import durable, read_table
from corrobora.llm.exact_dedup import distinct_rows
from corrobora.llm.mixing import mixed_rows
from corrobora.llm.near_copies import near_copy_rows, text_hash
from corrobora.llm.pieces import default_vocabulary, encode_texts
from corrobora.llm.quality import fit_quality, rows_of_quality
from corrobora.llm.toxicity import in_fold


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go. Labels of the held-out fold stay unseen.

    Null and empty texts are scored as texts without words; an empty table stays empty.
    """
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"), ~in_fold(F.col("__id"), 5, 0))
    return rows_of_quality(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, one row stays: that with the largest doc_id.

    A row without doc_id stays only if all copies lack one; ties are broken by a hash of the
    columns. Null and empty texts are equal.
    """
    return distinct_rows(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word Jaccard similarity of 0.8 or more, the one with the smallest doc_id stays.

    Rows without doc_id come last; ties go to the smallest text hash. Links run over chains of
    pairs. The join shuffles the texts once, at every size.
    """
    gone = near_copy_rows(docs).where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"))
    same = docs["doc_id"].eqNullSafe(gone["__id"]) & (text_hash(docs["text"]) == gone["__node"])
    return docs.join(gone.hint("merge"), same, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it: not at all, once or twice.

    Rows without source form a source; null texts have no words and are taken with their source.
    """
    return mixed_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, their number, and whether decoding gives the text again (null texts: no ids)."""
    return encode_texts(docs, default_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("sentencepiece", pieces),
]

#: SQL has neither the classifier nor XXH64 shingles; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written out and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = durable(docs)
    return docs
