"""The corpus pipeline: documents through five operators, each on all that the one before kept.

Stages read doc_id, text and lang; other columns, whatever their names, pass through all but the last. An empty table
gives an empty table. Texts of any length are read whole, ties are decided as the stage or its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from velograph.llm import common, op01_sentencepiece, op03_decontaminate, op04_simhash, op05_classifier, op10_quality
from velograph.sources import files


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. A text that is null or empty goes, having no words. Repeated rows are kept or go alike."""
    return docs.where(op10_quality.judge(docs)["kept"])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the cutoff or above. Without any label of kind 0, or of 1, all share one
    score; no model can tell them apart then, and all stay."""
    how = op05_classifier.Fit()
    model = op05_classifier.fit(docs, common.table(spark, sf_dir, "labels"), how)
    return docs if model.beta is None else docs.where(op05_classifier.score(model) >= how.cutoff)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id, null last; of its rows that of the smallest
    text hash, so of repeated rows one. Null and empty texts are copies of each other."""
    return op04_simhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts have none. Without items, all."""
    (found,) = common.fresh(docs, "found")
    judged = op03_decontaminate.judged(docs, common.table(spark, sf_dir, "benchmark"), name=found)
    return judged.where(~judged[found]["contaminated"]).drop(found)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled segmentations of each document, two at most; of a null or empty text the empty one. Repeated rows
    give theirs each."""
    return op01_sentencepiece.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Fingerprints, kernel scores and lattice samples are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents, each written to the shared folder and read again. A stage's table goes
    when the next one is written, the last one's when the application ends."""
    docs, top = common.table(spark, sf_dir, "documents"), files.scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
        if k:
            files.remove(spark, f"{top}/{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
