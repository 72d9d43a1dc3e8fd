"""A training corpus from raw documents: filtered, deduplicated, mixed and packed.

``run`` applies ``STAGES`` in turn to the documents of a table directory. All stages but the last return
the columns of documents; the last returns pieces of documents with their places in sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.blocks import without_copies
from tidemark.llm.mixture import mixed_documents
from tidemark.llm.near import without_near_copies
from tidemark.llm.packing import pack
from tidemark.llm.rules import good_documents
from tidemark.llm.shared import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject go on.

    A null or empty text is scored as an empty one, repeated rows are scored each, a label or id may be null.
    Without labels every document scores 0.5 and is kept. An empty table stays empty.
    """
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, but for the case of A-Z, the one with the largest doc_id stays.

    Null and empty texts are equal. A null doc_id is smaller than any other, so it stays only where all of
    a group are null; of repeated rows one stays. An empty table stays empty.
    """
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least doc_id stays.

    Texts without words are one class, shorter ones than five words are one shingle. A null doc_id stays only
    where all of a class are null; of repeated rows one stays. An empty table stays empty.
    """
    return without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mixture takes them.

    A null source is a source. Documents without words, null texts too, stay once; repeated rows count each;
    documents that the mixture takes less than half of are left out. An empty table stays empty.
    """
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; one that appears n times is packed n times.

    A null or empty text is a piece of its end alone; only longer texts than a sequence are cut; a null doc_id is
    packed like any other. An empty table gives no sequence.
    """
    return pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL expresses neither the classifier nor the signatures; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
