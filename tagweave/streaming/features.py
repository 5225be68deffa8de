"""Structured Streaming: the stateless parts of the library on a stream.

The reference pulls batches only; what carries over to a stream are the
row-wise functions (T1-T27, V13-V15) and prediction with a trained, static
lens (M3 + M5). Row features are plain projections, so they run unchanged
on a ``readStream`` DataFrame. Prediction needs joins with the model tables
and a vote per row, so it runs per micro-batch in ``foreachBatch`` (each
micro-batch is an ordinary DataFrame; the model tables are static).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions import fingerprint as FP
from tagweave.functions import text as T
from tagweave.functions import timeofday as TOD


def read_table_stream(spark: SparkSession, folder: str, table: str, max_files_per_trigger: int = 1) -> DataFrame:
    """A file stream over the parquet files of one table in ``folder``
    (``<table>*.parquet``; schema taken from the files)."""
    glob = f"{table}*.parquet"
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder))


def row_features(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per-row features usable on batch and stream alike."""
    txt = F.col(text_col)
    return df.select(
        id_col,
        F.concat_ws(" ", T.punctuation(txt, strict=True)).alias("punct_strict"),
        F.size(T.punctuation(txt, strict=False)).alias("n_punct_noisy"),
        F.size(T.emoji(txt)).alias("n_emoji"),
        F.round(T.capitalization(txt), 6).alias("capitalization"),
        F.concat_ws(" ", T.urls(txt, short_url=True)).alias("hosts"),
        F.array_join(FP.fingerprint(txt), ",").alias("fingerprint"))


def events_time_of_day(df: DataFrame, resolution: int = 3) -> DataFrame:
    return df.select("event_id", TOD.time_of_day(F.col("ts"), resolution).alias("tod"))


def run_available_now(stream: DataFrame, name: str, checkpoint: str):
    """Drain everything available into a memory table ``name`` and stop."""
    q = (stream.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def predict_stream(lens, stream: DataFrame, out_path: str, checkpoint: str, trigger_available_now: bool = True):
    """Tag a stream of rows (id, sample_text, fingerprint, time) with a static
    lens. Every micro-batch is predicted as a batch and written to a folder of
    its own, ``epoch=<n>``: a batch that is replayed after a failure replaces its
    rows. Rows don't depend on what else is in their batch."""
    from tagweave.operators import lens as L

    def batch(df: DataFrame, epoch_id: int) -> None:
        _, win = L.predict(lens, df)
        win.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_available_now else w
    return w.start()
