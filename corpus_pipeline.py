"""Corpus pipeline: five stages over ``documents``, each written and read again.

1. quality classifier: documents whose tail probability is below the cut go;
2. quality rules: documents that fail the base or line rules go, and lines above the
   line limits are taken out of those that stay (``n_chars`` follows);
3. n-gram Jaccard join: one document of each near-duplicate group stays, the one with
   the smallest (doc_id, text key);
4. benchmark decontamination: documents go that are contaminated, or hold a hit
   stretch of at least one whole window (13 words) of a benchmark item;
5. packing: pieces of the documents in sequences of at most 2048 tokens.

All but the last stage return the columns of ``documents``, in their order and types;
further columns are carried, whatever their names.

Defined cases: a null or empty text has no features, so stage 1 judges it by the
model's prior, and stage 2 rejects it, as it does every text of fewer than ten words;
texts of any length are read whole; ties (a probability at the cut, a line in as many
documents as a limit says) keep the document or line; rows that repeat id and text are
judged alike and stage 3 keeps one of them; null ids are never learnt from and kept
like others; without labels of two grades stage 1 keeps all, without benchmark rows
stage 4 does; an empty table passes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontamination, near_duplicates, packing, quality_classifier, quality_rules
from lodestrata.llm.queries import table, tokenizer_path
from lodestrata.storage import materialise


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability reaches the cut; the model learns from their labelled rows."""
    return quality_classifier.select(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass base and line rules, without the lines above the limits."""
    left = quality_rules.rejected_out(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five-word shingles, Jaccard 0.8 or more)."""
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole window of a benchmark item and not contaminated by short ones."""
    return decontamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: The classifier is fitted and the tokenizer run outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; every result is written to the shared folder and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
