"""A corpus pipeline of five stages over ``documents``: each takes what the one before kept, written and read again.

Quality rules reject documents and remove failing lines; repeated lines go; of every group of near copies one document
stays; the rest is mixed to target weights; and the mix is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import bpe, linededup, mixing, ngramjoin, quality
from lakewarden.llm.common import documents, free_name, only, visible_to_workers
from lakewarden.session import new_scratch

#: Near copies share 80 of 100 runs of five words.
NEAR_PERCENT, NEAR_WORDS = 80, 5


#: Bytes of rows that a Python worker gets at a time; texts of any length then need little memory beside a full heap.
BATCH_BYTES = "8m"
#: Settings of the allocators in Python workers: what one stage freed goes back to the system before the next one.
ALLOCATORS = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ready(spark: SparkSession) -> None:
    """Workers find this package, take rows in small batches, and give memory back."""
    visible_to_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    for name, value in ALLOCATORS.items():
        spark.sparkContext.environment.setdefault(name, value)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their failing lines. Null and empty texts go."""
    ready(spark)
    return quality.cleaned(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that enough others repeat.

    Null and empty texts have one empty line, which is no key and stays. Of rows with the largest id that hold a repeated
    line, all keep it. An empty table gives none; other columns stay as they are.
    """
    ready(spark)
    return linededup.cleaned(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies. Rows with one id, or without, stay or go together."""
    ready(spark)
    groups = ngramjoin.linked(spark, only(docs), NEAR_PERCENT, NEAR_WORDS)
    gone = free_name(docs.columns, "gone")
    others = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(others, docs["doc_id"] == others[gone], "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the schedule takes its words.

    Null and empty texts have no words and are taken never; sources without a name are one source, the last. Repeated rows
    are a document each. An empty table gives an empty mix.
    """
    ready(spark)
    return mixing.repeated(spark, docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids and digests of ids and decoded bytes, per row: a null text is an empty one and has no ids, repeated rows
    give the same digests, and an empty table gives no rows."""
    ready(spark)
    return bpe.digests(docs, bpe.public_codec(spark))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copies),
    ("source mix", source_mix),
    ("byte-level BPE", byte_bpe),
]
#: Hashes and merges of the stages have no SQL; tests/llm compares the join with brute force and the ids with a library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = new_scratch(spark, "stage-" + "-".join(name.lower().split()))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
