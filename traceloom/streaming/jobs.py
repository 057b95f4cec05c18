"""Structured Streaming forms of extraction, windows, alerts and clustering.

Batch semantics are the contract; the hourly windows with late data and the
session gaps are the idiomatic streaming additions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from traceloom.operators.clusters import CENTRES, cluster_step
from traceloom.operators.extract import extract_edges


def extract_stream(logs: DataFrame, patterns: Sequence[dict], out: str, checkpoint: str, **options) -> StreamingQuery:
    """Append clean edges of new log rows to a file sink, exactly once across restarts."""
    edges = extract_edges(logs, patterns, **options)
    return (edges.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def hourly_graph_stream(e: DataFrame, late: str = "2 hours") -> DataFrame:
    """Edges, weight and kinds per hour; an hour is emitted once it is ``late`` behind the newest edge."""
    w = e.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"))
    return w.agg(F.count(F.lit(1)).alias("edges"), F.sum("value").alias("weight"), F.approx_count_distinct("action").alias("actions")).select(
        F.date_format("w.start", "yyyy-MM-dd_HH").alias("window_key"), "edges", "weight", "actions")


def first_seen_stream(e: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key combination once, when it first appears."""
    return e.dropDuplicates(list(keys))


def first_seen_recent(e: DataFrame, keys: Sequence[str], within: str = "7 days") -> DataFrame:
    """As above with bounded state: a key quiet for longer than ``within`` may be reported again."""
    return e.withWatermark("ts", within).dropDuplicatesWithinWatermark(list(keys))


def node_score_stream(scores: DataFrame, threshold: float) -> DataFrame:
    """Running maximum per node with an alert flag, for update mode."""
    return scores.groupBy("node").agg(F.max("score").alias("score")).withColumn("alert", F.col("score") >= threshold)


def session_stream(e: DataFrame, gap: str = "1 second", late: str = "2 hours") -> DataFrame:
    """Active sessions per node: runs of events with gaps below ``gap``."""
    s = e.withWatermark("ts", late).groupBy("node", F.session_window("ts", gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last")).select(
        "node", "events", "first", "last")


def cluster_stream(seeds: DataFrame, root: str, checkpoint: str, threshold: float = 0.6, fading: float = 0.005) -> StreamingQuery:
    """Continual clustering per micro-batch, centres kept in a table with one version per batch.

    A batch reads the version before it and overwrites its own, so a repeated batch
    gives the same result.
    """
    def step(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        centres = _version(spark, f"{root}/centres", no - 1) if no > 0 else spark.createDataFrame([], CENTRES)
        path = f"{root}/steps/batch={no}"
        cluster_step(batch, centres, no, threshold, fading).write.mode("overwrite").parquet(path)
        res = spark.read.parquet(path)
        res.filter("id IS NULL").select("log_type", "cluster", "v", "weight", "step").write.mode("overwrite").parquet(f"{root}/centres/batch={no}")
        res.filter("id IS NOT NULL").select("id", "log_type", "cluster").write.mode("overwrite").parquet(f"{root}/members/batch={no}")

    return (seeds.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _version(spark: SparkSession, root: str, no: int) -> DataFrame:
    return spark.read.schema(CENTRES).parquet(f"{root}/batch={no}")


def append_to(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def upsert_to(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the changed rows of each batch of an update-mode query to its own folder."""
    def save(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={no}")
    return df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
