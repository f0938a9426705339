"""Structured Streaming forms: idempotent ingest, deduplication with a horizon, reading time, feed clocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators import merge

HORIZON, FLUSH_MS, CALL_MS, SHORT_READ_MS = "14 days", 60_000, 120_000, 15_000


def with_keys(entries: DataFrame) -> DataFrame:
    """Adds the canonical url and the title's key."""
    return entries.withColumns({"url": text.canonical_url(F.col("url")), "title_key": F.array_join(text.title_tokens(F.col("title")), " ")})


def fresh(entries: DataFrame, cutoff: str) -> DataFrame:
    """Entries not older than the retention cutoff; those without a time stay."""
    return entries.filter(~F.coalesce(F.col("published") < F.lit(cutoff).cast("timestamp"), F.lit(False)))


def deduplicated(entries: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Entries whose title hasn't come within the horizon; state older than that is dropped by the watermark."""
    return with_keys(entries).withWatermark("published", horizon).dropDuplicatesWithinWatermark(["title_key"])


def appender(path: str, key: str = "url") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows with new keys to a Parquet table; a batch run again adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.parquet(path)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            stored = batch.limit(0)
        merge.insert_if_new(stored, batch, key).write.mode("append").parquet(path)

    return write


def ingest(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs what is there into the table and stops; called again, it goes on where it stopped."""
    return with_keys(entries).writeStream.foreachBatch(appender(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reading_time(beats: DataFrame) -> DataFrame:
    """Running dwell and completion of articles from heartbeats (article_id, delta_ms, bottom, short)."""
    step = F.greatest(F.least(F.col("delta_ms"), F.lit(FLUSH_MS)), F.lit(0))
    done = F.col("bottom") | (F.col("short") & (F.col("delta_ms") >= SHORT_READ_MS))
    return beats.groupBy("article_id").agg(F.sum(step).alias("dwell_ms"), F.bool_or(done).alias("completed"))


def feed_clocks(entries: DataFrame) -> DataFrame:
    """For each feed the time of its last new article and the share of full texts."""
    return entries.groupBy("feed").agg(F.max(F.when(F.col("is_new"), F.col("published"))).alias("last_new_article_at"), F.avg(F.col("full_text").cast("int")).alias("fulltext_ratio"))


def windowed_activity(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events by type in windows of event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
