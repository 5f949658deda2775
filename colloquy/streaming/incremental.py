"""Labelling conversations as they arrive, and events by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.functions.columns import number, roster
from colloquy.operators.current import current_conversations, current_turns
from colloquy.operators.heuristic import heuristic_labels
from colloquy.schema import CONVERSATION


def label_stream(spark: SparkSession, source: str, target: str, checkpoint: str, step: int = 40, context: int = 10) -> StreamingQuery:
    """Label every new file of JSON-line conversations in ``source`` and append the labels to Parquet in ``target``.

    Each micro-batch is one batch job; its labels go to a folder of its own, overwritten if the batch is run again, so a restart
    neither loses nor doubles any. The current row of a batch gives both turns and roster. A conversation that comes again in a
    later batch is labelled again; :func:`streamed_labels` tells which labels count.
    """
    arrivals = spark.readStream.schema(CONVERSATION).json(source)

    def batch(rows: DataFrame, n: int) -> None:
        heads = current_conversations(
            rows, speakers=roster(F.col("speakers"), F.col("turns")), revision=number(F.try_element_at("meta", F.lit("revision")))
        )
        labels = heuristic_labels(current_turns(rows), heads.select("conversation_id", "speakers"), step, context)
        labels.join(heads.select("conversation_id", "revision"), "conversation_id", "left").write.mode("overwrite").parquet(f"{target}/batch={n}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_labels(spark: SparkSession, target: str) -> DataFrame:
    """The labels that count: of each conversation those of the highest revision, of equal ones the latest batch."""
    rows = spark.read.parquet(target)
    newest = F.struct(F.coalesce("revision", F.lit(float("-inf"))), "batch")
    top = F.max(newest).over(Window.partitionBy("conversation_id"))
    return rows.withColumn("__top", top).where(newest == F.col("__top")).drop("__top", "batch", "revision")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of ``events`` (ts, event_type, value) by window and type; on a stream, windows close after ``late``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
