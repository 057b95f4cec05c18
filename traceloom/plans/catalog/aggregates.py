"""Aggregation and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import names as N
from traceloom.operators import aggregates as A
from traceloom.operators import cleaning as C
from traceloom.operators import lookup as J
from traceloom.plans.catalog.cleaning import PATH_SQL, known_extensions
from traceloom.plans.registry import query

DUP = """(SELECT log_idx // 8 AS log_idx, 'i' || src AS source_id, src AS source_name, 'i' || dst AS dest_id, dst AS dest_name,
  CASE WHEN log_idx % 9 = 0 THEN ' ' ELSE ' ' || action || ' ' END AS action, log_type, (value > 100)::BIGINT AS label, ts_ns::VARCHAR AS timestamp, log_idx AS seq FROM
  (SELECT * REPLACE ('U' || (log_idx % 2) AS src, 'K' || (log_idx % 3) AS dst) FROM edges))"""


def _dups(t):
    i = F.col("log_idx")
    e = t.edges.withColumns({"src": F.concat(F.lit("U"), i % 2), "dst": F.concat(F.lit("K"), i % 3)})
    return e.select(F.floor(i / 8).alias("log_idx"), F.concat(F.lit("i"), "src").alias("source_id"), F.col("src").alias("source_name"),
                    F.concat(F.lit("i"), "dst").alias("dest_id"), F.col("dst").alias("dest_name"),
                    F.when(i % 9 == 0, " ").otherwise(F.concat(F.lit(" "), "action", F.lit(" "))).alias("action"), "log_type",
                    (F.col("value") > 100).cast("long").alias("label"), F.col("ts_ns").cast("string").alias("timestamp"), i.alias("seq"))


for _name, _by in (("merge_duplicate_edges", False), ("merge_duplicate_edges_by_type", True)):
    _k = "log_idx, source_id, source_name, dest_id, dest_name" + (", log_type" if _by else "")
    _lt = "" if _by else "min_by(log_type, seq) AS log_type, "
    query(_name, f"""
SELECT {_k}, {_lt}coalesce(string_agg(trim(action), ' ' ORDER BY seq) FILTER (trim(action) <> ''), '') AS action, max(label) AS label,
 min_by(timestamp, seq) AS timestamp FROM {DUP} GROUP BY {_k}""", "edges")(
        lambda t, by=_by: A.merge_duplicate_edges(_dups(t), "seq", by))


@query("merge_actions", f"""
SELECT log, src, dst, CASE WHEN n > 1 THEN array_to_string(list_sort([lower(w) for w in ws]), ' ') ELSE a END AS action, ts FROM (
 SELECT log_idx // 8 AS log, 'U' || (log_idx % 2) AS src, 'K' || (log_idx % 3) AS dst, count(*) AS n, min_by(action || ' Done', log_idx) AS a,
  list_distinct(flatten(list([action, 'Done']))) AS ws, min_by(ts_ns::VARCHAR, log_idx) AS ts FROM edges GROUP BY 1, 2, 3)""", "edges")
def _(t):
    i = F.col("log_idx")
    e = t.edges.select(F.floor(i / 8).alias("log"), F.concat(F.lit("U"), i % 2, F.lit(":")).alias("src"), F.concat(F.lit("K"), i % 3).alias("dst"),
                       F.concat("action", F.lit(" Done")).alias("action"), F.col("ts_ns").cast("string").alias("ts"), i.alias("seq"))
    return A.merge_actions(e, "log", "seq")


@query("merge_actions_smart", f"""
SELECT log, src, dst, CASE WHEN n > 1 THEN array_to_string(list_sort([lower(w) for w in ws]), ' ') ELSE a END AS action, ts FROM (
 SELECT log_idx // 8 AS log, min_by(CASE WHEN log_idx % 2 = 0 THEN 'http://h' ELSE 'httph/' END, log_idx) AS src, 'k' || (log_idx % 3) AS dst, count(*) AS n,
  min_by(action, log_idx) AS a, list_distinct(list(action)) AS ws, min_by(ts_ns::VARCHAR, log_idx) AS ts FROM edges GROUP BY log_idx // 8, 'k' || (log_idx % 3))""", "edges")
def _(t):
    i = F.col("log_idx")
    e = t.edges.select(F.floor(i / 8).alias("log"), F.when(i % 2 == 0, "http://h").otherwise("httph/").alias("src"), F.concat(F.lit("k"), i % 3).alias("dst"),
                       "action", F.col("ts_ns").cast("string").alias("ts"), i.alias("seq"))
    return A.merge_actions(e, "log", "seq", smart=True)


@query("action_frequencies", "SELECT action, count(*) AS n FROM edges_big GROUP BY action", "edges_big")
def _(t):
    return A.action_frequencies(t.edges_big)


@query("frequency_classes", """
SELECT count(*) AS actions, count(*) FILTER (n = 1) AS once, count(*) FILTER (n < 1000) AS below_floor, count(*) FILTER (n >= 1000) AS kept
FROM (SELECT src, count(*) * 10 AS n FROM edges GROUP BY src)""", "edges")
def _(t):
    f = t.edges.groupBy("src").agg((F.count(F.lit(1)) * 10).alias("n"))
    return A.frequency_classes(f)


@query("window_metadata", """
SELECT window_key, count(*) AS total_edges, sum(y)::BIGINT AS malicious_edges, (count(*) - sum(y))::BIGINT AS benign_edges, bool_or(y = 1) AS is_test,
 string_agg(DISTINCT attack, ',' ORDER BY attack) AS attack_types FROM scores GROUP BY window_key""", "scores")
def _(t):
    return A.window_metadata(t.scores.withColumnRenamed("y", "label"), "window_key")


@query("majority_value", """
SELECT id, arg_max(value, (n, -f)) AS value, max(n) AS votes FROM (SELECT id, lower(value) AS value, count(*) AS n, min(seq) AS f FROM votes GROUP BY 1, 2) GROUP BY id""",
       "votes")
def _(t):
    return A.majority_value(t.votes, "id", "value", "seq")


@query("edge_consensus", """
WITH p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, ts, action, count(*) FILTER ((direction = '->') = (src = least(src, dst))) AS f,
 count(*) FILTER ((direction = '->') <> (src = least(src, dst))) AS r, min(seq) AS s FROM votes GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY a, b, ts ORDER BY f + r DESC, s) AS rn FROM p)
SELECT a AS src, b AS dst, ts, action, CASE WHEN f > r THEN '->' ELSE '<-' END AS direction FROM w WHERE rn = 1""", "votes")
def _(t):
    return A.edge_consensus(t.votes, "seq")


TYPE_ROWS = """(SELECT log_idx // 4 AS log, src, dst, CASE WHEN value > 60 THEN 'NO LABEL' ELSE action END AS action, ['T' || (log_idx % 3), 'proc'] AS sv,
  CASE WHEN log_idx % 5 = 0 THEN [] ELSE ['t' || (log_idx % 4)] END AS dv FROM edges)"""


@query("resolve_types", f"""
WITH l AS (SELECT *, bool_or(action <> 'NO LABEL' AND action <> 'EVENT_OPEN') OVER (PARTITION BY log) AS live FROM {TYPE_ROWS}),
n AS (SELECT src AS node, live, unnest(sv) AS x FROM l UNION ALL SELECT dst, live, unnest(dv) FROM l),
g AS (SELECT node, list_sort(list_distinct(list(lower(x)) FILTER (NOT live))) AS idle, list_sort(list_distinct(list(lower(x)) FILTER (live))) AS act FROM n GROUP BY node)
SELECT node, array_to_string(CASE WHEN len(idle) > 0 THEN idle ELSE act END, '+') AS vtype FROM g""", "edges")
def _(t):
    i = F.col("log_idx")
    e = t.edges.select(F.floor(i / 4).alias("log"), "src", "dst", F.when(F.col("value") > 60, "NO LABEL").otherwise(F.col("action")).alias("action"),
                       F.array(F.concat(F.lit("T"), i % 3), F.lit("proc")).alias("src_vtypes"),
                       F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("t"), i % 4))).alias("dst_vtypes"))
    v = t.named.select(F.col("kind").alias("action")).distinct().filter("action = 'EVENT_OPEN'").withColumn("status", F.lit("INVALID"))
    return A.resolve_types(e, v, ["log"])


@query("encode_labels", "SELECT vtype, dense_rank() OVER (ORDER BY vtype) - 1 AS code FROM (SELECT DISTINCT vtype FROM types)", "types")
def _(t):
    return A.encode_labels(t.types, "vtype")


@query("encode_labels_fixed", """
SELECT action, CASE action WHEN 'EVENT_CONNECT' THEN 0 WHEN 'EVENT_EXECUTE' THEN 1 WHEN 'EVENT_OPEN' THEN 2
 ELSE 2 + row_number() OVER (PARTITION BY action IN ('EVENT_CONNECT', 'EVENT_EXECUTE', 'EVENT_OPEN') ORDER BY action) END AS code
FROM (SELECT DISTINCT action FROM edges)""", "edges")
def _(t):
    # new values follow the whole fixed vocabulary, used or not
    return A.encode_labels(t.edges, "action", fixed=["EVENT_CONNECT", "EVENT_EXECUTE", "EVENT_OPEN"])


@query("node_label_codes", """
SELECT n.node, coalesce(c.code, 0) AS code FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) n LEFT JOIN types t ON t.node = n.node
LEFT JOIN (SELECT vtype, dense_rank() OVER (ORDER BY vtype) - 1 AS code FROM (SELECT DISTINCT vtype FROM types)) c ON c.vtype = t.vtype""", "edges types")
def _(t):
    n = J.nodes_of(t.edges).join(t.types.select("node", "vtype"), "node", "left")
    return A.code_or_zero(n, A.encode_labels(t.types, "vtype"), "vtype").select("node", "code")


@query("group_types", """
SELECT node, vtype, CASE vtype WHEN 'type_0' THEN 'g0' WHEN 'type_1' THEN 'g0' WHEN 'type_2' THEN 'g1' ELSE 'other' END AS "group" FROM types""", "types")
def _(t):
    m = t.types.select("vtype").distinct().filter("vtype IN ('type_0', 'type_1', 'type_2')").withColumn(
        "group", F.when(F.col("vtype") == "type_2", "g1").otherwise("g0"))
    return A.group_values(t.types.select("node", "vtype"), m, "vtype", "other")


@query("group_codes", """
SELECT g AS "group", dense_rank() OVER (ORDER BY g) - 1 AS code FROM (SELECT DISTINCT CASE WHEN vtype IN ('type_0', 'type_1') THEN 'g0' ELSE vtype END AS g FROM types)""", "types")
def _(t):
    m = t.types.select("vtype").distinct().filter("vtype IN ('type_0', 'type_1')").withColumn("group", F.lit("g0"))
    return A.encode_labels(A.group_values(t.types, m, "vtype"), "group")


@query("unlabelled_type_pairs", """
SELECT DISTINCT s.vtype AS src_vtype, d.vtype AS dst_vtype FROM edges e JOIN types s ON s.node = e.src JOIN types d ON d.node = e.dst WHERE e.value > 200""", "edges types")
def _(t):
    e = t.edges.select("src", "dst", F.when(F.col("value") > 200, "NO LABEL").otherwise(F.col("action")).alias("action"))
    return A.unlabelled_type_pairs(e, t.types)


@query("type_distribution", "SELECT vtype, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM types GROUP BY vtype", "types")
def _(t):
    return A.distribution(t.types, "vtype")


@query("edge_type_distribution", "SELECT action, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM edges GROUP BY action", "edges")
def _(t):
    return A.distribution(t.edges, "action")


IDF = """(SELECT node, count(DISTINCT window_key) AS df, (SELECT count(DISTINCT window_key) FROM edges) AS windows FROM
  (SELECT src AS node, window_key FROM edges UNION ALL SELECT dst, window_key FROM edges) GROUP BY node)"""


def _idf(t):
    e = t.edges.select(F.explode(F.array("src", "dst")).alias("node"), "window_key")
    return A.inverse_frequency(e, "node", "window_key")


@query("inverse_frequency", f"SELECT node, df, windows, round(ln(windows / (df + 1)), 6) AS idf FROM {IDF}", "edges")
def _(t):
    return _idf(t).withColumn("idf", F.round("idf", 6))


@query("rare_nodes", f"SELECT node, df FROM {IDF} WHERE ln(windows / (df + 1)) > ln(windows * 0.01)", "edges")
def _(t):
    return A.rare_nodes(_idf(t), 0.01).select("node", "df")


@query("anomaly_threshold", """
SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(var_pop(score), 4) AS var, round(avg(score) + 1.5 * stddev_pop(score), 6) AS threshold FROM scores""", "scores")
def _(t):
    a = A.anomaly_threshold(t.scores, "score")
    return a.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("var", 4).alias("var"), F.round("threshold", 6).alias("threshold"))


@query("log_scores", """
SELECT log_idx // 5 AS log_idx, log_type, max(value) AS score, count(*) AS edges FROM edges GROUP BY 1, 2""", "edges")
def _(t):
    s = t.edges.select("window_key", F.col("log_idx").alias("edge_seq"), F.col("value").alias("score"))
    m = t.edges.select("window_key", F.col("log_idx").alias("edge_seq"), F.floor(F.col("log_idx") / 5).alias("log_idx"), "log_type")
    return A.log_scores(s, m, ["window_key", "edge_seq"])


@query("node_scores_to_logs", """
WITH n AS (SELECT node, max(score) AS score FROM scores GROUP BY node)
SELECT log_idx // 5 AS log_idx, log_type, max(score) AS score FROM (SELECT log_idx, log_type, src AS node FROM edges UNION ALL SELECT log_idx, log_type, dst FROM edges) e
JOIN n ON n.node = e.node GROUP BY 1, 2""", "edges scores")
def _(t):
    e = t.edges.select(F.floor(F.col("log_idx") / 5).alias("log_idx"), "log_type", "src", "dst")
    return A.node_scores_to_logs(e, A.node_max_scores(t.scores))


@query("node_max_scores", "SELECT node, max(score) AS score FROM scores GROUP BY node", "scores")
def _(t):
    return A.node_max_scores(t.scores)


@query("node_scores_by_type", """
SELECT n.node, coalesce(s.score, 0.0) AS score FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) n
LEFT JOIN (SELECT node, arg_max(score, log_type) AS score FROM (SELECT node, log_type, max(score) AS score FROM scores GROUP BY 1, 2) GROUP BY node) s ON s.node = n.node""",
       "edges scores")
def _(t):
    s = t.scores.groupBy("node", F.col("log_type").alias("vtype")).agg(F.max("score").alias("score"))
    return A.node_scores_by_type(J.nodes_of(t.edges), s)


@query("node_days", """
SELECT node, count(DISTINCT day) AS days, count(DISTINCT window_key) AS windows, min(day) AS first_day, max(day) AS last_day FROM
 (SELECT src AS node, window_key, substr(window_key, 1, 10) AS day FROM edges UNION ALL SELECT dst, window_key, substr(window_key, 1, 10) FROM edges) GROUP BY node""", "edges")
def _(t):
    return A.node_days(t.edges.withColumn("day", F.substring("window_key", 1, 10)))


@query("node_sightings", """
SELECT node, string_agg(DISTINCT substr(window_key, 1, 10), ',' ORDER BY substr(window_key, 1, 10)) AS days, string_agg(DISTINCT window_key, ',' ORDER BY window_key) AS windows FROM
 (SELECT src AS node, window_key FROM edges UNION ALL SELECT dst, window_key FROM edges) GROUP BY node""", "edges")
def _(t):
    s = A.node_sightings(t.edges.withColumn("day", F.substring("window_key", 1, 10)))
    return s.select("node", F.array_join("days", ",").alias("days"), F.array_join("windows", ",").alias("windows"))


@query("name_clusters", "WITH " + PATH_SQL.format(src="name") + """
SELECT DISTINCT processed, name AS member FROM out WHERE name <> processed
UNION ALL SELECT DISTINCT processed, NULL FROM out WHERE processed NOT IN (SELECT processed FROM out WHERE name <> processed)""", "names")
def _(t):
    return A.name_clusters(C.normalize_paths(t.names, known_extensions(t)))


@query("reduction_report", "WITH " + PATH_SQL.format(src="name") + """
SELECT is_file, count(*) AS originals, count(DISTINCT processed) FILTER (processed <> '') AS processed,
 round(100.0::DOUBLE * (count(*) - count(DISTINCT processed) FILTER (processed <> '')) / count(*), 6) AS reduction_percent FROM out GROUP BY is_file""", "names")
def _(t):
    m = C.normalize_paths(t.names, known_extensions(t)).withColumn("is_file", N.is_file_path(N.slash_path(F.col("name"))))
    return A.reduction_report(m)


@query("distinct_names", "SELECT DISTINCT lower(name) AS name FROM names WHERE trim(name) <> ''", "names")
def _(t):
    return A.vocabulary(t.names.filter("trim(name) <> ''").select(F.lower("name").alias("name")), column="name")


@query("graph_statistics", """
SELECT count(DISTINCT node) AS nodes, (count(*) // 2)::BIGINT AS edges, count(DISTINCT action) AS edge_types, round(2.0::DOUBLE * (count(*) // 2) / count(DISTINCT node), 6) AS avg_degree
FROM (SELECT src AS node, action FROM edges UNION ALL SELECT dst, action FROM edges)""", "edges")
def _(t):
    return A.graph_statistics(t.edges)


@query("end_validity", """
SELECT count(*) AS edges, count(*) FILTER (src NOT IN (SELECT node FROM types)) AS bad_src, count(*) FILTER (dst NOT IN (SELECT node FROM types)) AS bad_dst FROM edges""", "edges types")
def _(t):
    return A.end_validity(t.edges, t.types)


@query("common_record_keys", """
SELECT 'com.bbn.tc.schema.avro.cdm18.Event' AS key, count(*) AS n FROM events UNION ALL SELECT 'com.bbn.tc.schema.avro.cdm18.Subject', count(*) FROM customer
UNION ALL SELECT 'com.bbn.tc.schema.avro.cdm18.FileObject', count(*) FROM part UNION ALL SELECT 'com.bbn.tc.schema.avro.cdm18.NetFlowObject', count(*) FROM supplier""")
def _(t):
    return A.common_record_keys(t.cdm_lines)


@query("target_templates", """
SELECT regexp_replace(regexp_replace('(' || src || ', ' || dst || ') A: [' || action || '] ' || ts_ns, '[0-9]{19}', '<TIMESTAMP>', 'g'), '[0-9]+', '<NUMBER>', 'g') AS template,
 count(*) AS n FROM edges GROUP BY 1""", "edges")
def _(t):
    return A.target_templates(t.edges.select(F.concat(F.lit("("), "src", F.lit(", "), "dst", F.lit(") A: ["), "action", F.lit("] "), F.col("ts_ns").cast("string")).alias("target")))


@query("first_assignments", "SELECT src, min_by(dst, log_idx) AS dst, min(log_idx) AS log_idx FROM edges GROUP BY src", "edges")
def _(t):
    return A.first_assignments(t.edges.select("src", "dst", "log_idx"), "src", "log_idx")


@query("match_statistics", """
WITH m AS (SELECT DISTINCT src AS name, CASE WHEN src IN (SELECT 'U' || id FROM vecs) THEN 'exact' ELSE 'fallback' END AS match_kind FROM edges)
SELECT match_kind, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM m GROUP BY match_kind""", "edges vecs")
def _(t):
    v = t.vecs.select(F.concat(F.lit("U"), "id").alias("name"), "v")
    return A.match_statistics(J.align_embeddings(t.edges.select(F.col("src").alias("name")), v, 64))


# --- set operations ------------------------------------------------------------------------

@query("union_log_types", """
SELECT log_idx, CASE WHEN log_type = 'audit' THEN 'i' || src ELSE '' END AS source_id, src AS source_name, dst AS dest_name, log_type FROM edges""", "edges")
def _(t):
    e = t.edges.select("log_idx", F.col("src").alias("source_name"), F.col("dst").alias("dest_name"), "log_type")
    audit = e.filter("log_type = 'audit'").withColumn("source_id", F.concat(F.lit("i"), "source_name"))
    return A.union_log_types([audit, e.filter("log_type = 'dns'"), e.filter("log_type = 'firefox'")])


OLD = "(SELECT src || ' A: [' || action || '] ' || dst AS line, log_idx AS seq, CASE WHEN value > 80 THEN 'A' || log_idx % 3 END AS label FROM edges WHERE log_type <> 'firefox')"
NEW = "(SELECT src || ' A: [' || action || '] ' || dst AS line, log_idx AS seq, CASE WHEN value > 80 THEN 'B' || log_idx % 3 END AS label FROM edges WHERE log_type <> 'audit')"


@query("upsert_window", f"""
WITH l AS (SELECT line, max(seq) AS last, arg_max(coalesce(label, ''), seq) AS old FROM {OLD} GROUP BY line),
r AS (SELECT line, arg_max(label, seq) AS re FROM {NEW} WHERE label IS NOT NULL GROUP BY line)
SELECT o.line, o.seq, CASE WHEN o.seq = l.last AND o.label IS NULL THEN r.re ELSE o.label END AS label, 'stored' AS origin FROM {OLD} o JOIN l ON l.line = o.line LEFT JOIN r ON r.line = o.line
UNION ALL SELECT n.line, n.seq, n.label, 'new' FROM {NEW} n LEFT JOIN l ON l.line = n.line WHERE l.line IS NULL OR (l.old <> '' AND n.label IS NOT NULL)""", "edges")
def _(t):
    line = F.concat("src", F.lit(" A: ["), "action", F.lit("] "), "dst")

    def part(drop, tag):
        return t.edges.filter(F.col("log_type") != drop).select(line.alias("line"), F.col("log_idx").alias("seq"), F.when(
            F.col("value") > 80, F.concat(F.lit(tag), F.col("log_idx") % 3)).alias("label"))
    return A.upsert_window(part("firefox", "A"), part("audit", "B"))


@query("vocabulary", "SELECT action FROM edges UNION SELECT action FROM edges_big", "edges edges_big")
def _(t):
    return A.vocabulary(t.edges, t.edges_big, column="action")


@query("common_values", "SELECT node FROM types INTERSECT SELECT node FROM scores", "types scores")
def _(t):
    return A.common_values(t.types, t.scores, "node")


@query("missing_values", "SELECT node FROM scores EXCEPT SELECT node FROM types", "types scores")
def _(t):
    return A.missing_values(t.scores, t.types, "node")


@query("distinct_first", "SELECT src, dst, action, min(log_idx) AS log_idx FROM edges GROUP BY ALL", "edges")
def _(t):
    return A.distinct_first(t.edges, ["src", "dst", "action"], "log_idx")
