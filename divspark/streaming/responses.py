"""Parse model responses as they land (P-1 .. P-5 on a stream).

Generation is slow and paid, so responses are written in small files as they
come back.  This stream reads those files, applies the same parser as the
batch path, and removes duplicate ``(run, label, seed, text)`` rows with
``dropDuplicatesWithinWatermark``: state is kept only for the watermark
delay, never for the whole history.  The sink is Parquet partitioned by the
run key, with its checkpoint in the shared checkpoint folder, so a restarted
query (or a lost executor) resumes exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from divspark.operators.parse import parse_responses


def parse_response_stream(spark: SparkSession, source_dir: str, schema, profile: str,
                          keys: Sequence[str] = (), *, label: str = "label", seed: str = "seed",
                          response: str = "response", event_time: str | None = None,
                          watermark: str = "1 hour", max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of parsed rows ``(keys, label, seed, text, event_time)``.

    Without an ``event_time`` column in the files, the arrival time is used.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    if event_time is None:
        event_time = "received_at"
        stream = stream.withColumn(event_time, F.current_timestamp())
    parsed = parse_responses(stream, profile, keys, label=label, seed=seed, response=response,
                             carry=[event_time])
    return (parsed.withWatermark(event_time, watermark)
            .dropDuplicatesWithinWatermark([*keys, label, seed, "text"]))


def write_parsed_stream(parsed: DataFrame, sink_dir: str, keys: Sequence[str] = (), *,
                        checkpoint: str | None = None, available_now: bool = True,
                        processing_time: str | None = None) -> StreamingQuery:
    """Append parsed rows to Parquet (partitioned by the run key).  The stream's
    checkpoint belongs to its sink (default ``<sink_dir>.checkpoint``), so another
    sink starts afresh and a restarted application resumes."""
    ckpt = checkpoint or f"{sink_dir.rstrip('/')}.checkpoint"
    w = (parsed.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt)
         .outputMode("append"))
    if keys:
        w = w.partitionBy(*keys)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    return w.start()
