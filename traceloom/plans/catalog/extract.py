"""Extraction of edges, names and CDM records from log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import times
from traceloom.operators import extract as X
from traceloom.plans.registry import query

AUDIT_PATTERNS = [
    {"source": r"Subject ID: (\w+)", "dest": r"Object ID: (\w+)", "action": r"(?s)Accesses: (.*?) Time:",
     "timestamp": r"Time: (\S+)$"},
]
AUDIT_NAMES = [{"id": r"Object ID: (\w+)", "name": r"Object Name: (\S+)"}]
DNS_PATTERNS = [
    {"source": r"(U\d+) A+:", "dest": r"(A+: \S+) resolve", "action": r"(resolve)", "timestamp": r"^(\S+ \S+)"},
    {"source": r"(U\d+) A+:", "dest": r"(A+: \S+) resolve", "action": r"resolve (.*)$", "timestamp": r"^(\S+ \S+)"},
    {"source": r"nothing (\w+)", "dest": r"(A+: \S+) resolve", "action": "NO LABEL", "timestamp": "NO TIMESTAMP"},
]
WEB_PATTERNS = [
    {"source": r"from (\S+)", "dest": r"uri=(\S+) alt=(\S+)", "action": r"(https GET \w+)", "timestamp": "NO TIMESTAMP"},
]


def text_logs(t, log_type: str):
    """Audit, DNS or browser text lines, one per event."""
    k = F.col("k").cast("string")
    clock = F.date_format(F.timestamp_seconds(times.seconds(F.col("ts_ns"))), "HH:mm:ss")
    day = F.date_format(F.timestamp_seconds(times.seconds(F.col("ts_ns"))), "yyyy-MM-dd")
    act = (F.when(F.col("k") % 5 == 0, "ReadData:WriteData 4416").when(F.col("k") % 5 == 1, "DELETE").when(F.col("k") % 5 == 2, "12")
           .when(F.col("k") % 5 == 3, "Open\tClose:").otherwise(F.concat(F.lit("tool"), k, F.lit(".exe"))))
    lines = {
        "audit": F.concat(F.lit("4663 Subject ID: U"), "user_id", F.lit(" Object ID: H"), k, F.lit(" Object Name: tool"), k,
                          F.lit(".exe Accesses: "), act, F.lit(" Time: "),
                          F.when(F.col("k") % 9 == 0, "PM").otherwise(F.concat(clock, F.lit(":PM")))),
        "dns": F.concat(day, F.lit(" "), clock, F.lit(" U"), "user_id", F.when(F.col("k") % 2 == 0, " A: host").otherwise(" AAAA: host"),
                        k, F.lit(".net resolve Lookup "), k),
        "firefox": F.concat(F.lit("D uri=http://h"), k, F.lit("/ alt=http://h"), k, F.lit(" from page"), "user_id",
                            F.lit(".html https GET "), "event_type"),
    }
    return t.named.select(F.col("event_id").alias("log_idx"), lines[log_type].alias("line"))


DAY = "strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d')"
CLOCK = "strftime(make_timestamp(ts_ns // 1000), '%H:%M:%S')"


@query("extract_audit_edges", f"""
SELECT log_idx, source_id, '' AS source_name, dest_id, dest_name, action, timestamp FROM (
 SELECT event_id AS log_idx, 'U' || user_id AS source_id, 'H' || k AS dest_id, 'tool' || k || '.exe' AS dest_name,
  unnest(CASE k % 5 WHEN 0 THEN ['ReadData', 'WriteData'] WHEN 1 THEN ['DELETE'] WHEN 3 THEN ['Open', 'Close'] ELSE [] END) AS action,
  {CLOCK} AS timestamp FROM ev WHERE k % 9 <> 0) WHERE levenshtein(source_id, dest_id) <> 1""", "ev")
def _(t):
    return X.extract_edges(text_logs(t, "audit"), AUDIT_PATTERNS, AUDIT_NAMES)


@query("extract_dns_edges", f"""
SELECT event_id AS log_idx, NULL::VARCHAR AS source_id, 'U' || user_id AS source_name, NULL::VARCHAR AS dest_id, 'host' || k || '.net' AS dest_name,
 'lookup resolve' AS action, {DAY} || ' ' || {CLOCK} AS timestamp FROM ev""", "ev")
def _(t):
    return X.extract_edges(text_logs(t, "dns"), DNS_PATTERNS, merge="plain", builtin_ids=False)


@query("extract_browser_edges", """
SELECT event_id AS log_idx, NULL::VARCHAR AS source_id, 'page' || user_id || '.html' AS source_name, NULL::VARCHAR AS dest_id,
 'http://h' || k || '/' AS dest_name, 'http' AS action, '...' AS timestamp FROM ev""", "ev")
def _(t):
    return X.extract_edges(text_logs(t, "firefox"), WEB_PATTERNS, merge="smart", builtin_ids=False)


@query("match_patterns", f"""
SELECT event_id AS log_idx, 'U' || user_id AS src, CASE WHEN k % 2 = 0 THEN 'A: host' ELSE 'AAAA: host' END || k || '.net' AS dst,
 unnest(['resolve', 'Lookup ' || k]) AS action, {DAY} || ' ' || {CLOCK} AS ts FROM ev""", "ev")
def _(t):
    m = text_logs(t, "dns").select("log_idx", F.explode(X.match_patterns(F.col("line"), DNS_PATTERNS)).alias("e"))
    return m.select("log_idx", "e.*")


@query("match_patterns_python", f"""
SELECT event_id AS log_idx, 'U' || user_id AS src, CASE WHEN k % 2 = 0 THEN 'A: host' ELSE 'AAAA: host' END || k || '.net' AS dst,
 unnest(['resolve', 'Lookup ' || k]) AS action, {DAY} || ' ' || {CLOCK} AS ts FROM ev""", "ev")
def _(t):
    return X.match_with_python(text_logs(t, "dns"), DNS_PATTERNS)


def many_rules(n: int = 1000) -> list[dict]:
    """Rules of single tools, hosts and pages: about ``n``, of which a line meets a few."""
    rules: list[dict] = []
    for i in range(n // 4):
        rules += [
            {"source": r"Subject ID: (\w+)", "dest": rf"Object Name: (tool{i}\.exe)", "action": r"(?s)Accesses: (.*?) Time:", "timestamp": r"Time: (\S+)$"},
            {"source": r"(U\d+) A+:", "dest": rf"A+: (host{i}\.net) resolve", "action": r"(resolve)", "timestamp": r"^(\S+ \S+)"},
            {"source": r"from (\S+)", "dest": rf"uri=(http://h{i}/) alt=(\S+)", "action": rf"https (GET) \w+"},
            {"source": (r"Subject ID: (\w+)", rf"Object ID: (H{i}) "), "dest": ("NOT APPLICABLE", r"Object Name: (\S+)"), "action": "NO LABEL"}]
    return rules


@query("match_patterns_many", """
SELECT e.event_id AS log_idx, u.src, u.dst, u.action, u.ts FROM ev e, LATERAL (
 SELECT 'U' || user_id AS src, 'tool' || k || '.exe' AS dst,
  CASE k % 5 WHEN 0 THEN 'ReadData:WriteData 4416' WHEN 1 THEN 'DELETE' WHEN 2 THEN '12' WHEN 3 THEN 'Open' || chr(9) || 'Close:' ELSE 'tool' || k || '.exe' END AS action,
  CASE WHEN k % 9 = 0 THEN 'PM' ELSE """ + CLOCK + """ || ':PM' END AS ts WHERE k < 250 AND log_type = 'audit'
 UNION ALL SELECT 'U' || user_id || ':H' || k, 'tool' || k || '.exe', 'NO LABEL', '...' WHERE k < 250 AND log_type = 'audit'
 UNION ALL SELECT 'U' || user_id, 'host' || k || '.net', 'resolve', """ + DAY + """ || ' ' || """ + CLOCK + """ WHERE k < 250 AND log_type = 'dns'
 UNION ALL SELECT 'page' || user_id || '.html', unnest(['http://h' || k || '/', 'http://h' || k]), 'GET', '...' WHERE k < 250 AND log_type = 'firefox') u""", "ev")
def _(t):
    lines = text_logs(t, "audit").withColumn("log_type", F.lit("audit")).union(text_logs(t, "dns").withColumn("log_type", F.lit("dns"))).union(
        text_logs(t, "firefox").withColumn("log_type", F.lit("firefox")))
    kept = t.ev.select(F.col("event_id").alias("log_idx"), "log_type")
    return X.match_with_python(lines.join(kept, ["log_idx", "log_type"]), many_rules())


@query("extract_many_patterns", f"""
SELECT event_id AS log_idx, 'U' || user_id AS source_id, '' AS source_name, 'H' || k AS dest_id, 'tool' || k || '.exe' AS dest_name, action, {CLOCK} AS timestamp FROM (
 SELECT *, unnest(CASE k % 5 WHEN 0 THEN ['ReadData', 'WriteData'] WHEN 1 THEN ['DELETE'] WHEN 3 THEN ['Open', 'Close'] ELSE [] END) AS action
 FROM ev WHERE k % 9 <> 0 AND k < 500) WHERE levenshtein('U' || user_id, 'H' || k) <> 1""", "ev")
def _(t):
    rules = [{**AUDIT_PATTERNS[0], "dest": rf"Object ID: (H{i}) "} for i in range(500)]
    return X.extract_edges(text_logs(t, "audit"), rules, AUDIT_NAMES)


@query("match_tuple_patterns", """
SELECT event_id AS log_idx, 'U' || user_id || ':H' || k AS src, 'tool' || k || '.exe' AS dst, 'NO LABEL' AS action, '...' AS ts FROM ev""", "ev")
def _(t):
    p = [{"source": (r"Subject ID: (\w+)", r"Object ID: (\w+)"), "dest": ("NOT APPLICABLE", r"Object Name: (\S+)"),
          "action": "NO LABEL", "timestamp": "NO TIMESTAMP"}]
    return text_logs(t, "audit").select("log_idx", F.explode(X.match_patterns(F.col("line"), p)).alias("e")).select("log_idx", "e.*")


@query("match_group_ends", """
SELECT event_id AS log_idx, unnest(['U' || user_id, 'H' || k, 'U' || user_id, 'H' || k]) AS src,
 unnest(['tool' || k || '.exe', 'tool' || k || '.exe', 'Object', 'Object']) AS dst, 'NO LABEL' AS action, '...' AS ts FROM ev""", "ev")
def _(t):
    p = [{"source": r"Subject ID: (\w+) Object ID: (\w+)", "dest": r"Name: (\S+)|(Object)"},
         {"source": r"Subject ID: (\w+) Object ID: (\w+)", "dest": r"Name: (\S+) Accesses", "action": "NO LABEL"},
         {"source": r"Subject ID: (\w+) Object ID: (\w+)", "dest": r"(Object) ID", "timestamp": "NO TIMESTAMP"}][1:]
    return text_logs(t, "audit").select("log_idx", F.explode(X.match_patterns(F.col("line"), p)).alias("e")).select("log_idx", "e.*")


@query("entity_names", """
SELECT event_id AS log_idx, 'H' || k AS entity, 'tool' || k || '.exe' AS name FROM ev""", "ev")
def _(t):
    n = text_logs(t, "audit").select("log_idx", F.explode(X.name_pairs(F.col("line"), AUDIT_NAMES)).alias("p"))
    return n.select("log_idx", "p.*")


NODES_SQL = """
SELECT 'U' || c_custkey AS uuid, 'Subject' AS kind, {subj} AS property, c_custkey + 1000000000 AS seq FROM customer {ws}
UNION ALL SELECT 'K' || p_partkey, 'FileObject', {file}, p_partkey + 2000000000 FROM part {wf}
UNION ALL SELECT 'N' || s_suppkey, 'NetFlowObject', {net}, s_suppkey + 3000000000 FROM supplier {wn}"""
STRICT_SQL = NODES_SQL.format(
    subj="c_name || ',' || c_nationkey || ',/bin/' || lower(c_mktsegment)", ws="WHERE c_custkey % 7 <> 0",
    file="p_name", wf="WHERE p_partkey % 6 <> 0",
    net="'10.0.0.' || s_nationkey || ',' || s_suppkey || ',192.168.1.' || s_nationkey || ',\"443\"'", wn="WHERE s_suppkey % 5 <> 0")
LENIENT_SQL = NODES_SQL.format(
    subj="CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE 'null' END || ',' || c_nationkey || ',/bin/' || lower(c_mktsegment)", ws="",
    file="CASE WHEN p_partkey % 6 <> 0 THEN p_name ELSE 'null' END", wf="",
    net="'10.0.0.' || s_nationkey || ',' || s_suppkey || ',' || CASE WHEN s_suppkey % 5 <> 0 THEN '192.168.1.' || s_nationkey || ',443' ELSE 'null,null' END",
    wn="")


@query("cdm_nodes_strict", f"SELECT uuid, kind, property, sha256(property) AS node, seq FROM ({STRICT_SQL})")
def _(t):
    return X.cdm_nodes(t.cdm_lines, "strict")


@query("cdm_nodes_lenient", f"SELECT uuid, kind, property, sha256(property) AS node, seq FROM ({LENIENT_SQL})")
def _(t):
    return X.cdm_nodes(t.cdm_lines, "lenient")


@query("cdm_events", "SELECT event_id AS log_idx, ts_ns, subj AS subject, obj AS object, kind AS action FROM named WHERE kind <> 'EVENT_FLOWS_TO'", "named")
def _(t):
    return X.cdm_events(t.cdm_lines)


@query("cdm_edges", f"""
SELECT e.log_idx, CASE WHEN e.action = 'EVENT_READ' THEN sha256(o.property) ELSE sha256(s.property) END AS src,
 CASE WHEN e.action = 'EVENT_READ' THEN sha256(s.property) ELSE sha256(o.property) END AS dst, e.action, e.ts_ns
FROM (SELECT event_id AS log_idx, subj, obj, kind AS action, ts_ns FROM named WHERE kind <> 'EVENT_FLOWS_TO') e
JOIN ({LENIENT_SQL}) s ON s.uuid = e.subj JOIN ({LENIENT_SQL}) o ON o.uuid = e.obj""", "named")
def _(t):
    return X.cdm_edges(t.cdm_lines, X.cdm_nodes(t.cdm_lines))


@query("cdm_node_types", """
SELECT 'U' || c_custkey AS uuid, 'SUBJECT_PROCESS' AS type FROM customer UNION ALL SELECT 'K' || p_partkey, 'FILE_OBJECT_BLOCK' FROM part
UNION ALL SELECT 'N' || s_suppkey, 'NetFlowObject' FROM supplier""")
def _(t):
    return X.cdm_node_types(t.cdm_lines)


TWO = """(SELECT event_id AS log_idx, subj AS actor, kind AS action, ts_ns, event_type, unnest([obj, CASE WHEN k % 5 = 0 THEN 'K' || (k + 1) END]) AS object,
  unnest(['/srv/' || event_type || '/file' || k || '.log', '/srv/alt' || k]) AS path FROM named)"""
TYPES = """(SELECT 'U' || c_custkey AS uuid, 'SUBJECT_PROCESS' AS type FROM customer UNION ALL SELECT 'K' || p_partkey, 'FILE_OBJECT_BLOCK' FROM part
 UNION ALL SELECT 'N' || s_suppkey, 'NetFlowObject' FROM supplier)"""


@query("cdm_typed_edges", f"""
SELECT e.log_idx, e.actor, a.type AS actor_type, e.object, o.type AS object_type, e.action, e.ts_ns
FROM {TWO} e JOIN {TYPES} a ON a.uuid = e.actor JOIN {TYPES} o ON o.uuid = e.object""", "named")
def _(t):
    return X.typed_edges(t.cdm_lines, X.cdm_node_types(t.cdm_lines))


@query("cdm_event_attributes", f"""
SELECT DISTINCT e.log_idx, e.actor, e.object, e.action, e.ts_ns, a.type AS actor_type, o.type AS object_type, 'run ' || e.event_type AS exec, e.path
FROM {TWO} e JOIN {TYPES} a ON a.uuid = e.actor JOIN {TYPES} o ON o.uuid = e.object""", "named")
def _(t):
    e = X.typed_edges(t.cdm_lines, X.cdm_node_types(t.cdm_lines))
    return X.add_event_attributes(e, t.cdm_lines)
