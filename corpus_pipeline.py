"""Documents to packed training sequences: five stages, each written as Parquet and read by the next.

All stages take any table with ``doc_id`` and ``text``, give no rows for no rows, count null texts as empty, and leave
other columns, whatever their names, as they are; the last gives columns of its own.

A stage's result is to be written before the next stage is called: that deletes what the stage before it wrote on its way.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuespan.llm import decontaminate, exact, packing, quality, simhash
from cuespan.llm.queries import RANKS, TOKENIZER
from cuespan.llm.texts import table
from cuespan.session import drop_written, shared_dir, written_paths

#: Intermediates of the stage that was called last.
_left: list[str] = []


def _stage(make: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(make)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = set(written_paths(spark))
        drop_written(spark, [p for p in _left if p in before])
        found = make(spark, docs, sf_dir)
        _left[:] = [p for p in written_paths(spark) if p not in before]
        return found

    return staged


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score by their text is 0.5 or more. Repeated rows stay or go together; without labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text, that of the largest doc_id; of rows repeated whole, one. A null doc_id stays only if its
    text has no other."""
    return exact.drop_exact_copies(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of near copies, that of the smallest doc_id, null ids last. Texts without words are copies
    of each other."""
    return simhash.drop_near_copies(docs)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows less than a twentieth of whose words are in windows of the benchmark. Texts without words stay; repeated rows
    stay or go together; without a benchmark all stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences; each row, repeated or not, has its pieces, an empty text one."""
    return packing.packed(docs, TOKENIZER, RANKS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: SQL expresses neither the classifier nor the fingerprints; tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # The stage's own input has been used up.
        drop_written(spark, [before] if before else [])
        before = path
    drop_written(spark, [p for p in _left if p in set(written_paths(spark))])
    return docs
