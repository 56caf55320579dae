"""Incremental jobs: scoring that resumes and stops, and windows over event streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators.dedup import remove_known
from siltworks.session import job_folder, materialise


def score_incrementally(pool: DataFrame, log_path: str, key: str, score: Callable[[DataFrame], DataFrame], eligible: Column, wanted: int | None = None, batch_rows: int = 1000) -> int:
    """Append scored rows to a log, batch by batch, without those already there; stop once `wanted` rows are eligible.

    Rows are taken in the order of their key's hash, so a run that is resumed goes on where it stopped. Returns the eligible rows.
    """
    spark = pool.sparkSession
    done, todo = 0, pool
    try:
        log = spark.read.parquet(log_path)
        done, todo = log.where(eligible).count(), remove_known(pool, log, [key])
    except Exception as e:  # the log does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    # what is left is numbered and stored once by batch, so that a batch reads its own rows only
    count = max(1, -(-todo.count() // batch_rows))
    path = f"{job_folder(spark)}/tables/{uuid.uuid4().hex}-batches"
    todo.withColumn("batch__", F.pmod(F.xxhash64(key), F.lit(count))).write.partitionBy("batch__").parquet(path)
    batches = spark.read.parquet(path)
    for b in range(count):
        if wanted is not None and done >= wanted:
            break
        scored = materialise(score(batches.where(F.col("batch__") == b).drop("batch__")), "scored")
        scored.write.mode("append").parquet(log_path)
        done += scored.where(eligible).count()
    return done


def append_new(stream: DataFrame, log_path: str, key: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """A streaming sink that appends only rows whose key the log lacks; each micro-batch is made distinct first."""

    def sink(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            fresh = remove_known(fresh, batch.sparkSession.read.parquet(log_path), [key])
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        transform(fresh).write.mode("append").parquet(log_path)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 day", delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Extension: counts and sums per tumbling window and type; works on streams, where the watermark bounds the state."""
    zoneless = dict(events.dtypes)[ts] == "timestamp_ntz" and not events.isStreaming  # days then begin at midnight in any session
    at = events.withColumn("at__", F.col(ts) if zoneless else F.col(ts).cast("timestamp"))
    marked = at.withWatermark("at__", delay) if events.isStreaming else at
    out = marked.groupBy(F.window("at__", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts") -> DataFrame:
    """Extension: sessions of each user by a gap."""
    at = events.withColumn("at__", F.col(ts).cast("timestamp"))
    marked = at.withWatermark("at__", "1 hour") if events.isStreaming else at
    return marked.groupBy("user_id", F.session_window("at__", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def replay(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)
