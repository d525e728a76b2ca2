"""From raw documents to encoded training text: toxicity, quality, near-duplicates, source weights, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the columns of the
documents; a document is dropped by the first three and repeated as often as the mix takes it by the fourth.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import bagminhash, bpe, mixing, quality, toxicity
from lectern.llm.common import restricted, stored, table
from lectern.llm.queries import QUALITY_FOLD, TOXICITY_FOLD

#: No SQL: trained models, sketches and a tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.reject(docs, toxicity.fit(docs, labels, ~toxicity.held_out(F.col("doc_id"), *TOXICITY_FOLD)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id"), *QUALITY_FOLD))
    named = stored(labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id").distinct(), "labelled")
    stats = quality.measured(restricted(docs.select("doc_id", "text"), named, "doc_id"))
    return quality.accept(docs, quality.fit(stats, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return bagminhash.keep_first(docs, bagminhash.near_duplicates(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.take(docs, mixing.mix_sources(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text they decode to, as digests: one row per document and copy."""
    return bpe.digests(bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic), ("quality classifier", keep_good), ("MinHash near-dedup", one_of_each),
    ("mixing sources to target weights", mix), ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
