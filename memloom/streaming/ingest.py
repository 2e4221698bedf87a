"""Incremental ingest and retention (an extension: the batch engine has no streams).

New files are read as a stream; content that was seen within the watermark is dropped, and each micro-batch is
anti-joined against what is stored, so a rerun of a batch adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def message_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def unseen(messages: DataFrame, ts: str = "ts", body: str = "body", within: str = "7 days") -> DataFrame:
    """One message per content hash within the watermark; state older than that is dropped."""
    return messages.withColumn("content_hash", F.sha2(F.coalesce(F.col(body), F.lit("")), 256)).withWatermark(ts, within).dropDuplicatesWithinWatermark(["content_hash"])


def upserting(spark: SparkSession, target: str, key: str = "content_hash") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows whose key the target does not have."""

    def add(batch: DataFrame, epoch: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            batch = batch.join(spark.read.parquet(target).select(key), key, "left_anti")
        batch.write.mode("append").parquet(target)

    return add


def ingest(messages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Run the stream over what is there now."""
    add = upserting(messages.sparkSession, target)
    return unseen(messages).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows per key; the same plan serves a stream and a table."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    out = marked.groupBy(F.window(ts, size), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    out = marked.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "n")


def retract_source(claims: DataFrame, source_ids: DataFrame) -> DataFrame:
    """Claims without the evidence of deleted sources; those left without any are retracted."""
    each = claims.select("id", F.posexplode_outer("evidence").alias("pos", "e"))
    gone = source_ids.select(F.col("source_id").alias("__s")).distinct()
    left = each.where("e is not null").join(gone, F.col("e.source_id") == F.col("__s"), "left_anti")
    left = left.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"]).alias("kept"))
    had = F.size("evidence") > 0
    out = claims.join(left, "id", "left")
    return out.withColumns({"status": F.when(had & F.col("kept").isNull(), "retracted").otherwise(F.col("status")), "evidence": F.coalesce("kept", F.slice("evidence", 1, 0))}).drop("kept")


def visible_claims(claims: DataFrame, acl: DataFrame, principal: str) -> DataFrame:
    """Claims with at least one evidence source that the principal may read. ``acl``: principal, source_id."""
    may = acl.where(F.col("principal") == principal).select(F.col("source_id").alias("__s")).distinct()
    ids = claims.select("id", F.explode("evidence.source_id").alias("s")).join(may, F.col("s") == F.col("__s"), "left_semi").select("id").distinct()
    return claims.join(ids, "id", "left_semi")


def durable_claims(claims: DataFrame, sources: int = 2, least: float = 0.7) -> DataFrame:
    return claims.where((F.size(F.array_distinct("evidence.source_id")) >= sources) & (F.col("confidence") >= least))
