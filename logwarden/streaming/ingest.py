"""Streams of log lines: sources, micro-batches, analysis sink, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logwarden.operators import alerts, reports
from logwarden.sources import tail
from logwarden.streaming.envelope import envelope


def directory_lines(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True,
                    max_files: int | None = None) -> DataFrame:
    """Lines of files that arrive in a folder, with ingest time; blank lines skipped."""
    reader = spark.readStream.format("text").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(folder).select(F.col("value").alias("raw_line"), F.col("_metadata.file_path").alias("source_file"))
    return lines.where(F.trim("raw_line") != "").withColumn("ingest_time", F.current_timestamp())


def growing_lines(spark: SparkSession, folder: str, glob: str = "*", from_end: bool = False, max_bytes: int | None = None,
                  progress: str | None = None) -> DataFrame:
    """Lines appended to the files of a folder, about ``max_bytes`` a micro-batch; see :mod:`logwarden.sources.tail`."""
    tail.register(spark)
    reader = (spark.readStream.format("growing_files").option("glob", glob)
              .option("startingPosition", "latest" if from_end else "earliest"))
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if progress:
        reader = reader.option("progressLocation", progress)
    lines = reader.load(folder)
    return lines.select(F.col("value").alias("raw_line"), "source_file").withColumn("ingest_time", F.current_timestamp())


def records(lines: DataFrame, schema: str) -> DataFrame:
    """Wrap and parse lines to the fields of ``schema`` (a DDL string)."""
    text = envelope(F.col("raw_line"), F.date_format("ingest_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return lines.select("source_file", "ingest_time", F.from_json(text, schema).alias("r")).select("source_file", "ingest_time", "r.*")


BatchFn = Callable[[DataFrame, int], None]


def micro_batches(stream: DataFrame, fn: BatchFn, checkpoint: str, interval: str = "5 seconds",
                  available_now: bool = False, name: str | None = None) -> StreamingQuery:
    """Call ``fn`` per micro-batch.

    A slow consumer delays the next batch; nothing is dropped.
    """
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def analysis_sink(scorer: Callable[[DataFrame], DataFrame], out: str, record: str = "record_id", ts: str | None = "ts") -> BatchFn:
    """Score a batch and write history, alerts and statistics.

    Each batch has its own folder and is overwritten when it is retried, so a
    restart neither loses nor repeats rows.  The history written first feeds
    the other two outputs.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        place = f"{out}/history/batch_id={batch_id}"
        scorer(batch).write.mode("overwrite").parquet(place)
        scored = batch.sparkSession.read.parquet(place)
        alerts.generate_alerts(scored, record, ts).write.mode("overwrite").parquet(f"{out}/alerts/batch_id={batch_id}")
        reports.result_stats(scored).write.mode("overwrite").parquet(f"{out}/stats/batch_id={batch_id}")
    return run


def append_history(scored: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append scored rows to the history that drift reports read."""
    writer = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def drain(stream: DataFrame, path: str, checkpoint: str, timeout: int | None = None) -> None:
    """Run a stream over everything available and write it to ``path``; a stream not done in ``timeout`` seconds is an error."""
    query = append_history(stream, path, checkpoint, available_now=True)
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"stream did not finish in {timeout} s")
    finally:
        query.stop()


def ingestion_stats(query: StreamingQuery) -> dict:
    """Rows, batches, rate, rows dropped as too late and last activity, over the progress entries that Spark retains."""
    progress = [p for p in query.recentProgress]
    return {
        "batches": len(progress), "rows": sum(p.numInputRows for p in progress),
        "rows_per_second": max((p.processedRowsPerSecond or 0.0 for p in progress), default=0.0),
        "rows_too_late": sum(int(s.numRowsDroppedByWatermark) for p in progress for s in p.stateOperators),
        "last_activity": progress[-1].timestamp if progress else None,
        "error": str(query.exception()) if query.exception() else None,
    }
