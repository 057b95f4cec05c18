"""Time-window, split, order and sample queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import times
from traceloom.operators import lookup as J
from traceloom.operators import time_windows as W
from traceloom.operators import cleaning as C
from traceloom.plans.registry import query


@query("window_graph", """
SELECT window_key, count(DISTINCT node) AS nodes, count(DISTINCT src || '|' || dst) AS pairs, (count(*) // 2)::BIGINT AS edges, count(DISTINCT action) AS actions
FROM (SELECT window_key, action, src, dst, src AS node FROM edges UNION ALL SELECT window_key, action, src, dst, dst FROM edges) GROUP BY window_key""", "edges")
def _(t):
    return W.graph_windows(t.edges, "window_key")


@query("fill_timestamps", """
SELECT log_type, log_idx, coalesce(first_value(x IGNORE NULLS) OVER (PARTITION BY log_type ORDER BY log_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
 last_value(x IGNORE NULLS) OVER (PARTITION BY log_type ORDER BY log_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS ts_ns
FROM (SELECT log_type, log_idx, CASE WHEN value >= 40 AND log_idx < 9990 THEN ts_ns END AS x FROM edges)""", "edges")
def _(t):
    x = F.when((F.col("value") >= 40) & (F.col("log_idx") < 9990), F.col("ts_ns"))
    return W.fill_timestamps(t.edges.select("log_type", "log_idx", x.alias("ts_ns")), "log_type", "log_idx")


GAPS = """
WITH s AS (SELECT src AS node, ts_ns FROM {e} UNION SELECT dst, ts_ns FROM {e}),
g AS (SELECT node, (ts_ns - lag(ts_ns) OVER (PARTITION BY node ORDER BY ts_ns)) / 1000000000.0::DOUBLE AS gap FROM s)
SELECT node, coalesce(round_even(avg(gap) FILTER (gap >= {t}), 0)::BIGINT, 0) AS avg_idle_time, coalesce(round_even(max(gap) FILTER (gap >= {t}), 0)::BIGINT, 0) AS max_idle_time,
 coalesce(round_even(min(gap) FILTER (gap >= {t}), 0)::BIGINT, 0) AS min_idle_time, coalesce(round_even(sum(gap) FILTER (gap < {t}), 0)::BIGINT, 0) AS cumulative_active_time,
 coalesce(round_even(sum(gap), 0)::BIGINT, 0) AS lifespan FROM g GROUP BY node"""


@query("gap_features", GAPS.format(e="edges", t="1.0"), "edges")
def _(t):
    return W.gap_features(t.edges)


@query("gap_features_long", GAPS.format(e="edges_big", t="864000.0"), "edges_big")
def _(t):
    return W.gap_features(t.edges_big, "line_no", 864000.0)


@query("collapse_runs", """
WITH o AS (SELECT log_idx, 'U' || (log_idx // 7 % 3) AS src, 'K' || (log_idx // 3 % 2) AS dst, log_type, ts_ns FROM edges),
l AS (SELECT *, CASE WHEN lag(src) OVER w = src AND lag(dst) OVER w = dst THEN 0 ELSE 1 END AS n FROM o WINDOW w AS (PARTITION BY log_type ORDER BY ts_ns, log_idx)),
r AS (SELECT *, sum(n) OVER (PARTITION BY log_type ORDER BY ts_ns, log_idx)::BIGINT AS run FROM l)
SELECT log_type, run, src, dst, 'touch' AS action, count(*) AS n, src || ' --touch--> ' || dst || CASE WHEN count(*) > 1 THEN ' (x' || count(*) || ')' ELSE '' END AS sentence
FROM r GROUP BY log_type, run, src, dst""", "edges")
def _(t):
    i = F.col("log_idx")
    e = t.edges.select("log_idx", "log_type", "ts_ns", F.concat(F.lit("U"), F.floor(i / 7) % 3).alias("src"),
                       F.concat(F.lit("K"), F.floor(i / 3) % 2).alias("dst"), F.lit("touch").alias("action"))
    return W.collapse_runs(C.edge_sentences(e), ["ts_ns", "log_idx"], ["log_type"])


@query("edge_sequence", """
SELECT window_key, log_idx, row_number() OVER (PARTITION BY window_key ORDER BY ts_ns, log_idx) - 1 AS edge_seq FROM edges""", "edges")
def _(t):
    return W.edge_sequence(t.edges.select("window_key", "log_idx", "ts_ns"), ["window_key"], ["ts_ns", "log_idx"]).drop("ts_ns")


@query("edge_sequence_big", """
SELECT log_idx, line_no, dst, row_number() OVER (PARTITION BY action ORDER BY ts_ns, log_idx, line_no, dst, src) - 1 AS edge_seq FROM edges_big""", "edges_big")
def _(t):
    e = t.edges_big.select("action", "ts_ns", "log_idx", "line_no", "src", "dst")
    return W.edge_sequence(e, ["action"], ["ts_ns", "log_idx", "line_no", "dst", "src"]).select("log_idx", "line_no", "dst", "edge_seq")


@query("synthetic_time", "SELECT log_idx, ts_ns - ts_ns % 3600000000000 + log_idx AS t FROM edges", "edges")
def _(t):
    e = W.hourly(t.edges.select("log_idx", "ts_ns"))
    return W.synthetic_time(e, "window_start_ns", "log_idx").select("log_idx", "t")


@query("first_edge_per_pair", """
SELECT window_key, src, dst, min_by(action, log_idx) AS action, min(log_idx) AS log_idx FROM (SELECT * REPLACE (substr(window_key, 1, 10) AS window_key) FROM edges) GROUP BY window_key, src, dst""", "edges")
def _(t):
    e = t.edges.select(F.substring("window_key", 1, 10).alias("window_key"), "src", "dst", "action", "log_idx")
    return W.first_edge_per_pair(e, ["window_key"], "log_idx")


@query("last_labels", """
SELECT node, max_by(label, p) AS label, min(p) AS first_pos FROM (SELECT src AS node, action AS label, log_idx * 2 AS p FROM edges UNION ALL SELECT dst, log_type, log_idx * 2 + 1 FROM edges) GROUP BY node""", "edges")
def _(t):
    return W.last_labels(t.edges.select("log_idx", "src", "dst", F.col("action").alias("src_label"), F.col("log_type").alias("dst_label")), "log_idx")


@query("percentile_threshold", "SELECT log_type, round(quantile_cont(score, 0.99), 6) AS threshold FROM scores GROUP BY log_type", "scores")
def _(t):
    return W.percentile_threshold(t.scores, ["log_type"], "score", 0.99).withColumn("threshold", F.round("threshold", 6))


@query("percentile_threshold_all", "SELECT round(quantile_cont(price, 0.95), 6) AS threshold FROM edges_big", "edges_big")
def _(t):
    return W.percentile_threshold(t.edges_big, [], "price", 0.95).withColumn("threshold", F.round("threshold", 6))


@query("radius_value", """
SELECT log_type, max(score) FILTER (rn = floor(0.95 * n)) AS radius FROM (SELECT log_type, score, row_number() OVER (PARTITION BY log_type ORDER BY score) - 1 AS rn,
 count(*) OVER (PARTITION BY log_type) AS n FROM scores) GROUP BY log_type""", "scores")
def _(t):
    return W.radius_value(t.scores, ["log_type"], "score", 0.05)


CLUSTERED = "(SELECT log_idx, log_type, window_key, CASE WHEN log_idx % 9 = 0 THEN -1 ELSE (log_idx * 7) % 211 END AS cluster FROM edges)"


def _clustered(t):
    return t.edges.select("log_idx", "log_type", "window_key", F.when(F.col("log_idx") % 9 == 0, -1).otherwise((F.col("log_idx") * 7) % 211).alias("cluster"))


@query("new_clusters", f"""
SELECT log_idx, log_type, window_key, cluster FROM (SELECT *, min(window_key) OVER (PARTITION BY log_type, cluster) AS f FROM {CLUSTERED} WHERE cluster <> -1) WHERE window_key = f""", "edges")
def _(t):
    return W.new_clusters(_clustered(t), ["log_type"])


@query("sample_new_clusters", f"""
SELECT log_idx, log_type, window_key, cluster FROM (SELECT *, row_number() OVER (PARTITION BY log_type, cluster ORDER BY md5(log_idx || '|s1'), log_idx) AS rn FROM {CLUSTERED} WHERE cluster <> -1) WHERE rn <= 3""", "edges")
def _(t):
    return W.sample_per_group(_clustered(t).filter("cluster <> -1"), ["log_type", "cluster"], 3, "s1", "log_idx")


@query("hourly_windows", """
SELECT log_idx, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d_%H') AS window_key, ts_ns - ts_ns % 3600000000000 AS window_start_ns FROM edges""", "edges")
def _(t):
    return W.hourly(t.edges.select("log_idx", "ts_ns")).drop("ts_ns")


SPLIT = """(SELECT *, CASE WHEN substr(window_key, 1, 10) BETWEEN '2024-01-03' AND '2024-01-12' THEN 'train' WHEN substr(window_key, 1, 10) BETWEEN '2024-01-20' AND '2024-01-25' THEN 'test' END AS split
  FROM edges WHERE log_idx % 100 <> 0)"""


def _split(t):
    bad = F.when(F.col("log_idx") % 100 == 0, F.lit(5_000_000_000)).otherwise(F.col("ts_ns"))
    return W.split_by_dates(t.edges.select("log_idx", "src", "dst", bad.alias("ts_ns")), ("2024-01-03", "2024-01-12"), ("2024-01-20", "2024-01-25"))


@query("split_by_dates", f"SELECT log_idx, split FROM {SPLIT} WHERE split IS NOT NULL", "edges")
def _(t):
    return _split(t).select("log_idx", "split")


@query("split_nodes", f"SELECT DISTINCT node, split FROM (SELECT src AS node, split FROM {SPLIT} UNION SELECT dst, split FROM {SPLIT}) WHERE split IS NOT NULL", "edges")
def _(t):
    return W.split_nodes(_split(t))


@query("exclusive_test_nodes", """
WITH n AS (SELECT src AS node, CASE WHEN log_idx % 2 = 0 AND substr(src, 2)::BIGINT % 3 = 0 THEN 'train' ELSE 'test' END AS split FROM edges)
SELECT DISTINCT node, split FROM n WHERE split = 'train' OR node NOT IN (SELECT node FROM n WHERE split = 'train')""", "edges")
def _(t):
    n = t.edges.select(F.col("src").alias("node"), F.when((F.col("log_idx") % 2 == 0) & (F.substring("src", 2, 20).cast("long") % 3 == 0), "train").otherwise("test").alias("split")).distinct()
    return W.exclusive_test_nodes(n)


@query("split_windows", """
SELECT id, window_key, CASE WHEN bool_or(y = 1 AND score > 100) OVER (PARTITION BY window_key) THEN 'test' ELSE 'train' END AS split FROM scores""", "scores")
def _(t):
    s = t.scores.select("id", "window_key", ((F.col("y") == 1) & (F.col("score") > 100)).cast("long").alias("label"))
    return W.split_windows(s).drop("label")


@query("normalize_timestamps", """
SELECT event_id AS id, CASE WHEN m = 0 THEN s || '.' || rpad((k + 100)::VARCHAR, 6, '0') WHEN m = 1 THEN s || '.000000' WHEN m = 2 AND log_type = 'audit' THEN s || '.000000'
 WHEN m = 5 THEN '2024-13-45 x' ELSE strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:00:00') || '.000000' END AS ts FROM (SELECT *, event_id % 6 AS m, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S') AS s FROM ev)""", "ev")
def _(t):
    at = F.timestamp_seconds(times.seconds(F.col("ts_ns")))
    m = F.col("event_id") % 6
    s = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    raw = (F.when(m == 0, F.concat(s, F.lit("."), (F.col("k") + 100).cast("string"))).when(m == 1, s).when(m == 2, F.date_format(at, "h:mm:ss a"))
           .when(m == 3, "").when(m == 5, "2024-13-45 x"))
    w = F.concat(F.date_format(at, "yyyy-MM-dd HH:00:00"), F.lit("_end"))
    return t.ev.select(F.col("event_id").alias("id"), times.normalize_timestamp(raw, w, F.col("log_type")).alias("ts"))


@query("timestamp_epochs", """
SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN (ts_ns // 1000) / 1000000.0::DOUBLE WHEN 3 THEN 0.0 ELSE (ts_ns // 1000000000)::DOUBLE END AS epoch FROM ev""", "ev")
def _(t):
    at = F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000)))
    m = F.col("event_id") % 4
    raw = (F.when(m == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")).when(m == 1, F.date_format(at, "h:mm:ss a"))
           .when(m == 2, F.date_format(at, "H:mm:ss")).otherwise("no time"))
    w = F.concat(F.date_format(at, "yyyy-MM-dd HH:00:00"), F.lit("_end"))
    return t.ev.select(F.col("event_id").alias("id"), times.timestamp_epoch(raw, w).alias("epoch"))


@query("nanosecond_text", """
SELECT event_id AS id, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad((ts_ns % 1000000000)::VARCHAR, 9, '0') AS utc,
 strftime(make_timestamp(ts_ns // 1000) - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') || '.' || lpad((ts_ns % 1000000000)::VARCHAR, 9, '0') AS eastern, ts_ns AS back FROM ev""", "ev")
def _(t):
    d = t.ev.select(F.col("event_id").alias("id"), times.ns_text(F.col("ts_ns")).alias("utc"), times.ns_text(F.col("ts_ns"), "America/New_York").alias("eastern"))
    return d.withColumn("back", times.text_ns(F.col("eastern"), "America/New_York"))


@query("epoch_scale", """
SELECT id, round(CASE m WHEN 0 THEN ns / 1e9 WHEN 1 THEN (ns // 1000) / 1e6 WHEN 2 THEN (ns // 1000000) / 1e3 ELSE ns // 1000000000 END::DOUBLE, 3) AS fixed,
 round(CASE m WHEN 0 THEN ns / 1e9 WHEN 1 THEN (CASE WHEN ns // 1000 > 1e15 THEN (ns // 1000) / 1e9 ELSE (ns // 1000) / 1e6 END) WHEN 2 THEN (ns // 1000000) / 1e6 ELSE (ns // 1000000000) / 1e3 END::DOUBLE, 3) AS compat
FROM (SELECT event_id AS id, ts_ns AS ns, event_id % 4 AS m FROM ev)""", "ev")
def _(t):
    m = F.col("event_id") % 4
    by = F.when(m == 0, 1).when(m == 1, 1000).when(m == 2, 1_000_000).otherwise(1_000_000_000)
    d = t.ev.select(F.col("event_id").alias("id"), F.call_function("div", F.col("ts_ns"), by).alias("x"))
    return d.select("id", F.round(times.epoch_seconds(F.col("x")), 3).alias("fixed"), F.round(times.epoch_seconds(F.col("x"), True), 3).alias("compat"))


@query("merge_sorted", """
SELECT log_idx, log_type, CASE WHEN log_idx % 10 <> 0 THEN ts_ns END AS ts_ns FROM edges ORDER BY ts_ns NULLS FIRST""", "edges")
def _(t):
    e = t.edges.select("log_idx", "log_type", F.when(F.col("log_idx") % 10 != 0, F.col("ts_ns")).alias("ts_ns"))
    return W.merge_sorted([e.filter(F.col("log_type") == x) for x in ("audit", "dns", "firefox")])


@query("merge_sorted_text", "SELECT log_idx, src, dst FROM edges ORDER BY ts_ns::VARCHAR", "edges")
def _(t):
    return W.merge_sorted([t.edges.select("log_idx", "src", "dst", "ts_ns")], as_text=True, nulls_first=False).drop("ts_ns")


@query("hour_calendar", """
SELECT DISTINCT window_key FROM edges WHERE substr(window_key, 1, 10) BETWEEN '2024-01-10' AND '2024-01-15'""", "edges")
def _(t):
    return W.hour_calendar(t.edges, "2024-01-10", "2024-01-15")


@query("scenario_windows", """
SELECT DISTINCT window_key, CASE WHEN substr(window_key, 1, 10) BETWEEN '2024-01-04' AND '2024-01-09' THEN 'S2' WHEN substr(window_key, 1, 10) BETWEEN '2024-01-09' AND '2024-01-14' THEN 'S3' ELSE 'S1' END AS scenario FROM edges""", "edges")
def _(t):
    w = t.edges.select("window_key").distinct()
    return w.withColumn("scenario", times.scenario_for_window(F.col("window_key"), [("S2", "2024-01-04", "2024-01-09"), ("S3", "2024-01-09", "2024-01-14")], "S1"))


@query("top_seeds", "SELECT node, score FROM (SELECT node, max(score) AS score FROM scores GROUP BY node) ORDER BY score DESC, node LIMIT 15", "scores")
def _(t):
    return W.top_seeds(t.scores.groupBy("node").agg(F.max("score").alias("score")), 15)


@query("stratified_sample", """
SELECT id, action FROM (SELECT log_idx AS id, action, row_number() OVER (PARTITION BY action ORDER BY md5(log_idx || '|42'), log_idx) AS rn FROM edges) WHERE rn <= 1000""", "edges")
def _(t):
    return W.sample_per_group(t.edges.select(F.col("log_idx").alias("id"), "action"), ["action"], 1000, "42", "id")


@query("sample_distinct_names", "SELECT name FROM (SELECT DISTINCT name FROM names) ORDER BY md5(name || '|7') LIMIT 20", "names")
def _(t):
    return W.sample_distinct(t.names, "name", 20, "7")


@query("edge_pairs", "SELECT DISTINCT src AS a, dst AS b FROM edges", "edges")
def _(t):
    return W.edge_pairs(t.edges.select(F.concat(F.lit("("), "src", F.lit(", "), "dst", F.lit(") A: ["), "action", F.lit("]")).alias("line")))
