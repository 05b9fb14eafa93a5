"""Streaming ingestion: transcripts that arrive as files, and turns that arrive one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def transcript_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(doc_id, text) of new text files below a folder."""
    rows = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).text(path)
    return rows.select(F.regexp_extract("_metadata.file_path", r"([^/]+?)\.[A-Za-z]+$", 1).alias("doc_id"), F.col("value").alias("text"))


def process(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run each micro-batch of transcripts through `each` (build, then write); stops at the end if once."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def assemble_turns(turns: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """turns(doc_id, ts, seq, text) to transcripts: an interview ends after a gap without turns."""
    sessions = turns.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "doc_id")
    parts = sessions.agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    return parts.select("doc_id", F.col("w.start").alias("started"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"))
