"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.session import cut_lineage, ship_package

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows that a Python worker holds at once; texts are some thousand characters long.
BATCH_ROWS = 1024


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers, and keep their batches small."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def stored(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder of ``spark.checkpoint.dir``:
    the lineage ends in files that every executor can reach."""
    return cut_lineage(df)


def stored_by(df: DataFrame, parts: int, key: str) -> DataFrame:
    """``stored``, dealt by ``key``, and known to be: later groupings by ``key``
    don't shuffle it again. An adaptive plan doesn't tell its partitioning, so
    this one is planned without."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        return cut_lineage(df.repartition(parts, key))
    finally:
        conf.set(name, was)


#: Rows of a partition of a gathered table.
GATHERED_ROWS = 50_000


def gathered(df: DataFrame, rows: int = GATHERED_ROWS) -> DataFrame:
    """``stored``, read in as many partitions as its rows need and no more: what
    shuffles a small table then writes few files, however many partitions made it."""
    out = stored(df)
    return out.coalesce(parts_for(out.count(), rows))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z, and no other character, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts_for(total: int, per_part: int, least: int = 1) -> int:
    """Number of parts so that each holds about ``per_part`` units: it follows the data."""
    return max(least, -(-int(total) // per_part))
