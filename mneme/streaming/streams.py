"""Streams: notes that arrive as files, and figures over the search log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mneme.operators import index
from mneme.operators.changefeed import ManifestTable


def ingest_stream(arrivals: DataFrame, target: ManifestTable, checkpoint: str, to_points: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Bring arriving notes into a table of points, batch by batch, once each.

    Every micro-batch is one commit: notes whose hash is unchanged are left alone, the points of
    changed notes replace the old ones, and old points that are not among the new ones go in the same
    commit, so readers never see a note half replaced. A batch that is delivered again after a crash
    finds its number in the table's tags and is left alone.
    """

    def step(batch: DataFrame, number: int) -> None:
        if int(target.manifest(target.latest())["tags"].get("batch", -1)) >= number:
            return
        latest = batch.groupBy("source_path").agg(F.max_by(F.struct(*batch.columns), "seen_at").alias("r")).select("r.*")
        known = target.read()
        changed = latest if known is None else index.changed_files(latest, known.select("source_path", "content_hash"))
        changed = changed.persist()
        points = to_points(changed)
        stale = None
        if known is not None:
            stale = known.join(changed.select("source_path"), "source_path", "left_semi").select("point_id").join(points.select("point_id"), "point_id", "left_anti")
        target.commit(points, stale, batch=number)
        changed.unpersist()

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_windows(log: DataFrame, time: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and latency per tumbling or sliding window of a (streaming or static) log; late rows beyond ``late`` are dropped by a stream."""
    stamped = log.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return stamped.groupBy(F.window("__t", width, slide) if slide else F.window("__t", width), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("value_max")
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "value_max")


def log_sessions(log: DataFrame, time: str, user: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user: stretches without a pause of ``gap``."""
    stamped = log.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return stamped.groupBy(F.session_window("__t", gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n")).select(
        user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n"
    )


def read_stream(spark: SparkSession, path: str, schema: str | object, files_per_batch: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream, in the order of their arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
