"""A corpus pipeline of five stages, each calling one operator of ``millrace.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last
return the columns of ``docs``. ``run`` writes each result as Parquet in the shared folder
(``spark.checkpoint.dir``) and reads it again as the next stage's input, so a lost executor
costs tasks, not stages; a stage's files are deleted when the next one's are written.

All stages take null doc_ids, texts and sources, empty and very long texts, repeated rows, empty tables and further columns; what each
makes of them is said below. Only doc_id, text, source and, where other columns decide between equal rows, these are looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, decontaminate, materialise, mixing, quality, simhash

#: The pipeline draws and fits models; SQL can't express it. tests/llm holds each stage's operator against a plain version of it.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the weak-label quality classifier, fitted on ``docs`` itself, rejects.

    Null and empty texts get the classifier's bias, all alike; rows of equal texts stay or go together.
    """
    common.tune(spark)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near-duplicates: the one with the least doc_id, null ids last.

    Groups are of SimHashes within 3 bits and of 5-word Jaccard 0.8. Null, empty and wordless texts are one group; repeated rows become one.
    """
    common.tune(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents into which an item of the ``benchmark`` table leaks, by word edits of a fifth of the item at most.

    Null, empty and wordless texts stay; an empty benchmark drops nothing.
    """
    return decontaminate.drop_leaks(docs, common.documents(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document 0, 1 or 2 times, so that every source comes to its target words.

    Null sources are a source; documents without words aren't taken; rows alike in all columns are decided one by one.
    """
    common.tune(spark)
    return mixing.apply_mix(docs)


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences of all documents in training order, written as shards of fixed-size records and read from them.

    A text without tokens is one end id; repeated rows are all written; an empty table writes no shard.
    """
    common.tune(spark)
    return materialise.written_order(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix),
    ("token-ID output", training_order),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the ``documents`` table of ``sf_dir``."""
    docs = common.documents(spark, sf_dir)
    before = []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stage(docs, f"pipeline-{k}")
            common.release(*before)
            before = [docs]
    common.release(*before)  # the last stage has written its shards
    return docs
