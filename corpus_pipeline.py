"""Cleans and packs documents: STAGES in order, each reading what the one before wrote.

A stage takes (spark, docs, sf_dir). All but the last return the columns of
documents, whatever they are called. A stage scans docs more than once;
what decides by a text alone decides in the scan that keeps the rows, other
decisions go from scan to scan by the rows' content or by numbers in a
written table, never by the order of a scan. So they meet the rows they were
made on whatever becomes of the executors in between.

Defined results: a null, empty or wordless text has no letter and goes in the
first stage; without any lang only such go there; repeated rows are one document after exact dedup; of ties the
stages' own rules decide (largest doc_id for equal texts, least for near
copies); a null doc_id is the smallest for equal texts and the last choice
for near copies; an empty table stays empty; missing labels leave only the
base rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import exact_dedup, langid, near_dup, packing, rules
from tracelake.llm.common import staged


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no language that the corpus taught, or in two, where that is sure."""
    known = langid.learn(docs)
    keep = langid.keeper(known, langid.floors(langid.identify(docs, known, lang="lang")))
    return docs.filter(keep(F.col("text").cast("binary")))


def passes_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or lie over the forest's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keep = rules.keeper(*rules.fit(staged(rules.measured(docs), "rule-statistics"), labels))
    return docs.filter(keep(F.col("text").cast("binary")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each class of near copies (five-word shingles, similarity of 0.8 or more)."""
    return near_dup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", known_language),
    ("quality rules", passes_rules),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack),
]

#: The stages learn models and compare sets of shingles, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
