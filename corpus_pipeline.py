"""Corpus pipeline: from raw documents to packed training sequences.

Five stages, each on all that the one before kept: language identification, toxicity, near-
duplicates, pseudonyms, packing. ``run`` writes each stage's result as Parquet to the shared
folder and reads it back, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import language_id, minmax, packing, pseudonyms, toxicity
from voxloom.llm.base import materialize, table

TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with an identifiable language. Profiles come from all rows with a language."""
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score below the cutoff; the lexicon is learned from labelled rows."""
    grammar = toxicity.learn(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, grammar)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group; rows without an id stay."""
    found = minmax.near_duplicates(docs)
    return docs.join(found.filter(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms of the same format, under the session's secret."""
    out = pseudonyms.pseudonymize(docs, pseudonyms.session_key(spark), domains=True)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", hide_private),
    ("packing", pack),
]

#: No stage but the pseudonyms could be put in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
