"""Streaming jobs run to the end of the available files, compared with batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from traceloom.plans.catalog.extract import AUDIT_NAMES, AUDIT_PATTERNS, text_logs
from traceloom.plans.registry import query
from traceloom.plans.views import Tables
from traceloom.session import shared_dir
from traceloom.streaming import jobs as S


class _StreamTables(Tables):
    """The same views over a file stream of the events table."""

    def read(self, name: str):
        if name != "events":
            return super().read(name)
        return _files(self, name, super().read(name).schema)


def _files(t, name: str, schema):
    """A file stream of a table that is one file or a folder of files: a pattern matches either, a plain path only a folder."""
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{name}.parque[t]")


def _stream(t):
    return _StreamTables(t.spark, t.sf_dir)


def _place(t) -> tuple[str, str]:
    p = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    return p + "/out", p + "/checkpoint"


def _timed(t):
    return _stream(t).edges.withColumn("ts", F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000))))


def _finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@query("stream_extract_edges", """
SELECT log_idx, source_id, '' AS source_name, dest_id, dest_name, action, timestamp FROM (
 SELECT event_id AS log_idx, 'U' || user_id AS source_id, 'H' || k AS dest_id, 'tool' || k || '.exe' AS dest_name,
  unnest(CASE k % 5 WHEN 0 THEN ['ReadData', 'WriteData'] WHEN 1 THEN ['DELETE'] WHEN 3 THEN ['Open', 'Close'] ELSE [] END) AS action,
  strftime(make_timestamp(ts_ns // 1000), '%H:%M:%S') AS timestamp FROM ev WHERE k % 9 <> 0) WHERE levenshtein(source_id, dest_id) <> 1""", "ev")
def _(t):
    out, cp = _place(t)
    logs = text_logs(_stream(t), "audit")
    for _ in range(2):  # the second run finds nothing new
        _finish(S.extract_stream(logs, AUDIT_PATTERNS, out, cp, name_patterns=AUDIT_NAMES))
    return t.spark.read.parquet(out)


@query("stream_hourly_windows", """
SELECT window_key, count(*) AS edges, round(sum(value), 4) AS weight FROM edges
WHERE make_timestamp(ts_ns // 1000 // 3600000000 * 3600000000 + 3600000000) <= (SELECT make_timestamp(max(ts_ns) // 1000) - INTERVAL 2 HOUR FROM edges) GROUP BY window_key""", "edges")
def _(t):
    out, cp = _place(t)
    _finish(S.append_to(S.hourly_graph_stream(_timed(t)), out, cp))
    return t.spark.read.parquet(out).select("window_key", "edges", F.round("weight", 4).alias("weight"))


@query("stream_first_seen", "SELECT DISTINCT log_type, dst FROM edges", "edges")
def _(t):
    out, cp = _place(t)
    _finish(S.append_to(S.first_seen_stream(_stream(t).edges.select("log_type", "dst"), ["log_type", "dst"]), out, cp))
    return t.spark.read.parquet(out)


@query("stream_first_seen_recent", "SELECT DISTINCT log_type, src FROM edges", "edges")
def _(t):
    out, cp = _place(t)
    e = _timed(t).select("log_type", "src", "ts")
    _finish(S.append_to(S.first_seen_recent(e, ["log_type", "src"]), out, cp))
    return t.spark.read.parquet(out).select("log_type", "src")


@query("stream_node_alerts", "SELECT node, max(score) AS score, max(score) >= 300 AS alert FROM scores GROUP BY node", "scores")
def _(t):
    out, cp = _place(t)
    _finish(S.upsert_to(S.node_score_stream(_stream(t).scores, 300.0), out, cp))
    return t.spark.read.parquet(out).groupBy("node").agg(F.max("score").alias("score"), F.max("alert").alias("alert"))


@query("stream_sessions", """
WITH s AS (SELECT src AS node, ts_ns FROM edges), g AS (SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY node ORDER BY ts_ns) <= 3600000000000 THEN 0 ELSE 1 END AS n FROM s),
r AS (SELECT *, sum(n) OVER (PARTITION BY node ORDER BY ts_ns) AS run FROM g)
SELECT node, count(*) AS events, (min(ts_ns) // 1000)::BIGINT AS "first" FROM r GROUP BY node, run HAVING max(ts_ns) // 1000 + 3600000000 <= (SELECT max(ts_ns) // 1000 - 7200000000 FROM edges)""", "edges")
def _(t):
    out, cp = _place(t)
    e = _timed(t).select(F.col("src").alias("node"), "ts")
    _finish(S.append_to(S.session_stream(e, "1 hour"), out, cp))
    return t.spark.read.parquet(out).select("node", "events", F.unix_micros("first").alias("first"))


@query("stream_clusters")
def _(t):
    out, cp = _place(t)
    e = _files(t, "embeddings", t.read("embeddings").schema)
    seeds = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("t"), F.col("label") % 3).alias("log_type"), "embedding").withColumnRenamed("embedding", "v")
    _finish(S.cluster_stream(seeds, out, cp, threshold=1.2))
    return t.spark.read.parquet(out + "/members").select("id", "log_type", "cluster")
