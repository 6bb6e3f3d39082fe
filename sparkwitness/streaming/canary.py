"""Streaming forms of the canary window and of the span cap (an extension of the batch operators)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Events as a stream; a time without zone is taken as UTC so that it can carry a watermark."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def canary_windows(events: DataFrame, width: str = "1 day", lateness: str = "2 hours") -> DataFrame:
    """Tumbling windows of each release: samples, error rate, latency; later events are dropped."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), F.col("user_id").alias("release_id"))
    return w.agg(F.count(F.lit(1)).alias("sample_count"), F.avg((F.col("event_type") == "error").cast("int")).alias("error_rate"), F.max("value").alias("latency_ms")).select("release_id", F.col("w.start").alias("window_start"), "sample_count", "error_rate", "latency_ms")


def capped_spans(events: DataFrame, max_spans: int) -> DataFrame:
    """Recorded status of each span with a counter per run as state: ok up to the cap, then limited."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for f in frames:
            f = f.sort_values("event_id")
            n = range(seen + 1, seen + len(f) + 1)
            seen += len(f)
            yield pd.DataFrame({"run_id": key[0], "event_id": f["event_id"].to_numpy(), "recorded": ["ok" if i <= max_spans else "limited" for i in n]})
        state.update((seen,))

    run = events.select(F.col("user_id").alias("run_id"), "event_id")
    return run.groupBy("run_id").applyInPandasWithState(update, "run_id long, event_id long, recorded string", "seen long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now and return its table."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
