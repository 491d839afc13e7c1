"""Corpus pipeline: language, lines, near-duplicates, benchmark passages, packed sequences.

Each stage takes the documents that its predecessor kept, all of them, and writes its result before
the next one reads it. ``run`` does the same through the folder that the cluster shares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import Scope, load, removed, stage_path
from tidemark.llm.decontamination import drop_contaminated
from tidemark.llm.language import keep_identified
from tidemark.llm.line_dedup import drop_lines
from tidemark.llm.packing import pack_documents
from tidemark.llm.simhash import keep_one

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: No SQL: a trained network and Hamming components are beyond it; tests compare with brute force.
ORACLE_SQL = None

#: What the stage called last has staged.
_last = Scope()


def _stage(work: Stage) -> Stage:
    """The stage as it is called from outside: what the stage before it staged goes, since its result is written by then."""

    def start(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _last.release(spark)
        with _last:
            return work(spark, docs, sf_dir)

    return start


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces of all documents in sequences of 1,024 tokens.

    A null or empty text is its closing id alone; repeated rows and rows that share an id are packed one
    by one; ties in length go by id and checksum; other columns are ignored, whatever their names; an
    empty table gives no piece.
    """
    return pack_documents(docs)


WORK: list[tuple[str, Stage]] = [
    ("language_id", keep_identified),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", keep_one),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", _pack),
]
STAGES: list[tuple[str, Stage]] = [(name, _stage(work)) for name, work in WORK]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Each removes what it staged once its result is written; other results of the session keep theirs."""
    docs, before = load(spark, sf_dir, "documents"), None
    for name, work in WORK[:-1]:
        path = stage_path(spark, name)
        with Scope() as scope:
            kept = work(spark, docs, sf_dir)
        kept.write.parquet(path)
        scope.release(spark)
        if before is not None:
            removed(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return WORK[-1][1](spark, docs, sf_dir)
