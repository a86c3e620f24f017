"""The training-data pipeline: documents through five stages, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
Rows that share a doc_id count as one document for the near-duplicate stage; null texts fail the rules.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import near_dedup, packing, quality_neighbours, quality_rules, substring_dedup
from tabulon.llm.labelled import remainder
from tabulon.llm.shared import fresh, table, temporaries


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score 0.3 or more; learns from labelled rows outside the held-out fifth."""
    space = quality_neighbours.fitted(docs, table(spark, sf_dir, "labels"), "quality", lambda k: remainder(k, 5) != 0)
    score = fresh("score", docs.columns)
    return quality_neighbours.scored(docs, space, score=score).where(F.col(score) >= 0.3).select(*docs.columns)


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and whose host is not rejected."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each class of near-duplicates, one row of an id, and rows without id."""
    return near_dedup.kept_documents(docs, idf=near_dedup.smooth_idf).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words of windows that a document of smaller id has; n_chars follows the text that is left."""
    counts = (fresh("n_words", docs.columns), fresh("n_removed", docs.columns))
    out = substring_dedup.without_repeats(docs, counts=counts)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens along the curve."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rule_filter),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packed_sequences),
]

#: SQL can express neither the classifier nor the samples nor the curve.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with temporaries(spark) as keep:  # what a stage stores goes when its result is written
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
