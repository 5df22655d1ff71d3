"""Structured Streaming forms of the incremental operators (STM-01..03, STM-12, STM-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.sources.sinks import VersionedTable


def events_stream(spark: SparkSession, path: str, schema: str, time: str = "ts", late: str = "1 day", files: int = 100, glob: str = "*.parquet") -> DataFrame:
    """STM-01: new files of a folder, at most ``files`` a batch (the budget); times as TIMESTAMP, which a watermark needs."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(path)
    return raw.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def daily_counts(events: DataFrame) -> DataFrame:
    """Tumbling days by type, partially aggregated before the shuffle."""
    days = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.col("window.start").cast("date").alias("day"), "event_type", "n")


def first_seen(events: DataFrame, *keys: str, expire: bool = False) -> DataFrame:
    """STM-03: a content's first occurrence. The state holds every key; with ``expire`` only those within the watermark, and a repeat after
    that counts as new."""
    return events.dropDuplicatesWithinWatermark(list(keys)) if expire else events.dropDuplicates(list(keys))


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of a user, closed by a gap."""
    found = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), "n")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Processes what is there and ends; the results are a table in ``path``, written by the executors: files of each batch in append mode, a
    version for each batch in complete mode."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
        return df.sparkSession.read.schema(df.schema).parquet(path)
    target = VersionedTable(df.sparkSession, path)
    writer.foreachBatch(lambda batch, _: target.replace(batch)).start().awaitTermination()
    return target.read(df.schema)


def upsert_latest(df: DataFrame, table, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """STM-02, STM-14: each batch's latest row of a key into a versioned table; an older row never replaces a newer one."""

    def newest(batch: DataFrame, now: DataFrame | None) -> DataFrame:
        both = batch.unionByName(now) if now is not None else batch
        rows = both.groupBy(*key).agg(F.max_by(F.struct(*[c for c in both.columns if c not in key]), F.col(order)).alias("_row"))
        return rows.select(*key, "_row.*").select(*both.columns)

    def write(batch: DataFrame, _: int) -> None:
        table.change(lambda now: newest(batch, now))

    query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
