"""The token cache of the reaction jobs as a parquet table.

Write: per comment, its tokens and original text keyed by (post_id, c) with
c the running index within the post (W4); partitioned by post bucket; an
existing cache is kept (``mode('ignore')``) unless ``force``. Read: the
space-joined tokens (X) and the post key (Y) of every cached comment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_token_cache(df: DataFrame, path: str, force: bool = False, buckets: int = 16) -> None:
    """``df``: (post_id, c, tokens ARRAY<STRING>, orig STRING)."""
    out = df.select("post_id", "c", "tokens", "orig", F.pmod(F.xxhash64("post_id"), F.lit(buckets)).alias("bucket"))
    out.write.mode("overwrite" if force else "ignore").partitionBy("bucket").parquet(path)


def read_token_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, X, Y): key = '<post>_<c>', X = tokens joined by spaces, Y = post key."""
    c = spark.read.parquet(path)
    key = F.concat_ws("_", F.col("post_id").cast("string"), F.col("c").cast("string"))
    return c.select(key.alias("key"), F.concat_ws(" ", "tokens").alias("X"), F.col("post_id").cast("string").alias("Y"))
