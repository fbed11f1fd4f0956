"""A corpus pipeline over documents: reject toxic texts, drop exact and near copies, mix sources, encode.

STAGES are applied in order; each is written as Parquet and read again before the next. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import exact_dedup, jaccard_join, mixing, sentencepiece_codec, toxicity
from siltstone.llm.common import small_batches, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject."""
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (lower-cased A-Z), against a fresh digest index."""
    small_batches(spark)
    return exact_dedup.keep_first_copies(docs, exact_dedup.new_index(spark), "pipeline")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a Jaccard similarity of 0.8 or more."""
    small_batches(spark)
    return jaccard_join.keep_one_of_each(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each time a document is taken, good ones first."""
    small_batches(spark)
    return mixing.mixed_documents(docs, weight=mixing.by_quality(docs, table(spark, sf_dir, "labels")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the SentencePiece ids of each text, decoded again and compared."""
    import public_tokenizers

    small_batches(spark)
    rows = docs.select("doc_id", "lang", "source", "text")
    return sentencepiece_codec.encoded(rows, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Trained scores, hash draws and tokenizer ids have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
