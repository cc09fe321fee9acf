"""Audits over streams: files of chunks or records that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.chunks import ChunkPolicy, audit_chunks
from plumbline.operators.incremental import GenerationStore


def audit_stream(chunks: DataFrame, path: str, checkpoint: str, policy: ChunkPolicy | None = None, available_now: bool = True) -> StreamingQuery:
    """Audit each micro-batch of a chunk stream, by itself, and commit its findings exactly once.

    Checks that compare chunks (duplicates, boilerplate, distinctiveness) see one batch at a time; what
    repeats across batches shows in an audit of the whole table.

    A batch's findings are written to a folder of their own and published under the batch's number. A
    batch that is replayed after a failure finds its number taken and writes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        store = GenerationStore(batch.sparkSession, path)
        if store.exists(f"{store.path}/commits/{number + 1:010d}.json"):
            return
        folder = store.new_folder()
        audit_chunks(batch, policy).findings.withColumn("batch", F.lit(number)).write.parquet(folder)
        store.publish(number + 1, {"folder": folder, "batch": number})

    w = chunks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def stream_findings(spark, path: str) -> DataFrame:
    """All committed findings of an audit_stream."""
    folders = [c["folder"] for _, c in GenerationStore(spark, path).commits()]
    if not folders:
        raise ValueError("no batch was committed yet")
    return spark.read.parquet(*folders)


def windowed_codes(findings: DataFrame, time: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window start, code, occurrences) of timed findings; with a watermark on a stream."""
    f = findings.withWatermark(time, late) if findings.isStreaming else findings
    return f.groupBy(F.window(time, window).alias("w"), "code").agg(F.count("*").alias("occurrences")).select(F.col("w.start").alias("window_start"), "code", "occurrences")


def newest_rows(rows: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Repeated rows of a stream dropped within the watermark, by key and time."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)
