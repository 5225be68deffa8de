"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of documents.

Defined results: null and empty texts have no words, so the first stage drops
them; other columns may be null. Rows that repeat an id, or have none, are
documents of their own: near-dedup tells them apart by their sets of shingles
and keeps one row of each group (least id, null last, then least text), the
stage on passages cuts only what a smaller id holds, the mix takes equal rows
equally often. Ties are broken by hashes of id and text. Texts are read whole,
whatever their length. Empty tables give empty results. Other columns, whatever
their names, pass through to the last stage, which returns its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tagweave.llm import mixing, near_dup, packing, quality, repeats
from tagweave.llm.common import prepare
from tagweave.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go, those without text among them."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, also of rows that share an id or have none."""
    prepare(spark)
    return near_dup.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller id holds are cut out; rows of one id, or without, cut nothing from each other."""
    prepare(spark)
    return repeats.without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source, the last one."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences with their token ids; a document's pieces carry its id, null if it has none."""
    prepare(spark)
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("source mixing", source_mixing),
    ("packing", sequence_packing),
]

#: Tokenising, hashing and dependent rounding have no SQL form; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the
    shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
