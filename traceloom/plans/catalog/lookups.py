"""Lookup and membership queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import names as N
from traceloom.operators import lookup as J
from traceloom.plans.registry import query


def _edges(t, *cols):
    return t.edges.select("log_idx", "src", "dst", *cols)


def _labels(t):
    """Malicious substrings: lower-cased names of suppliers and nations."""
    return t.read("supplier").select(F.concat(F.lit("k"), "s_suppkey").alias("label")).unionAll(
        t.read("nation").select(F.lower("n_name").alias("label")))


LABELS = "(SELECT 'k' || s_suppkey AS label FROM supplier UNION ALL SELECT lower(n_name) FROM nation)"


@query("label_edges", f"""
WITH ends AS (SELECT src AS name FROM edges UNION SELECT dst FROM edges),
bad AS (SELECT DISTINCT name FROM ends, {LABELS} WHERE contains(lower(name), label))
SELECT log_idx, src, dst, (src IN (SELECT name FROM bad) OR dst IN (SELECT name FROM bad))::BIGINT AS label FROM edges""", "edges")
def _(t):
    return J.label_edges(_edges(t), _labels(t))


MORE_LABELS = """(SELECT 'k' || s_suppkey AS label FROM supplier UNION ALL SELECT lower(n_name) FROM nation
 UNION ALL SELECT lower(c_name) FROM customer WHERE c_nationkey = 3 UNION ALL SELECT replace(lower(p_brand), '#', '-') FROM part WHERE p_size = 7)"""


@query("names_containing_labels", f"SELECT DISTINCT name FROM names, {MORE_LABELS} WHERE contains(lower(name), label)", "names")
def _(t):
    extra = t.read("customer").filter("c_nationkey = 3").select(F.lower("c_name").alias("label")).unionAll(
        t.read("part").filter("p_size = 7").select(F.translate(F.lower("p_brand"), "#", "-").alias("label")))
    return J.names_containing(t.names, _labels(t).unionAll(extra))


@query("edge_messages", """
SELECT log_idx, src, dst, coalesce(s.functionality, '') AS exec, coalesce(d.functionality, '') AS path
FROM edges e LEFT JOIN types s ON e.src = s.node LEFT JOIN types d ON e.dst = d.node""", "edges types")
def _(t):
    return J.add_messages(_edges(t), t.types.select(F.col("node").alias("id"), F.col("functionality").alias("message")))


@query("node_messages", "SELECT node, functionality AS message FROM types WHERE node IN (SELECT src FROM edges UNION SELECT dst FROM edges)", "types edges")
def _(t):
    return J.node_messages(_edges(t), t.types.select(F.lower("node").alias("id"), F.col("functionality").alias("message")))


@query("edge_names", """
SELECT e.log_idx // 5 AS log, e.log_idx, e.src, e.dst, coalesce(s.nm, '') AS src_name, coalesce(d.nm, '') AS dst_name FROM edges e
LEFT JOIN (SELECT event_id // 5 AS log, obj, max_by(event_type, event_id) AS nm FROM named GROUP BY ALL) s ON s.log = e.log_idx // 5 AND s.obj = e.src
LEFT JOIN (SELECT event_id // 5 AS log, obj, max_by(event_type, event_id) AS nm FROM named GROUP BY ALL) d ON d.log = e.log_idx // 5 AND d.obj = e.dst""",
       "edges named")
def _(t):
    e = t.edges.select(F.floor(F.col("log_idx") / 5).alias("log"), "log_idx", "src", "dst")
    n = t.named.select(F.floor(F.col("event_id") / 5).alias("log"), F.col("obj").alias("entity"), F.col("event_type").alias("name"),
                       F.col("event_id").alias("seq"))
    return J.add_names(e, n, "log")


@query("induced_edges", """
SELECT log_idx, src, dst FROM edges WHERE src IN (SELECT node FROM types) AND dst IN (SELECT node FROM types)""", "edges types")
def _(t):
    return J.induced_edges(_edges(t), t.types)


@query("nodes_of_edges", "SELECT src AS node FROM edges UNION SELECT dst FROM edges", "edges")
def _(t):
    return J.nodes_of(t.edges)


@query("resume_logs", "SELECT log_idx, log_type FROM edges WHERE (log_idx, log_type) NOT IN (SELECT (event_id, log_type) FROM ev WHERE value < 30)", "edges ev")
def _(t):
    done = t.ev.filter("value < 30").select(F.col("event_id").alias("log_idx"), "log_type")
    return J.not_done(t.edges.select("log_idx", "log_type"), done, ["log_idx", "log_type"])


VEC_NAMES = """(SELECT 'v' || id AS raw, label FROM vecs)"""


@query("align_embeddings", """
WITH want AS (SELECT DISTINCT CASE WHEN event_id % 4 = 0 THEN 'App_' || (k * 7) WHEN event_id % 4 = 1 THEN 'APP_' || (k + 1000) WHEN event_id % 4 = 2 THEN 'connection_' || k
  ELSE 'other' || k END AS name FROM ev),
have AS (SELECT CASE WHEN id % 2 = 0 THEN 'App_' || id ELSE 'connection_' || id END AS name, v FROM vecs)
SELECT w.name, CASE WHEN h.name IS NOT NULL THEN 'exact' WHEN starts_with(w.name, 'A') OR starts_with(w.name, 'c') THEN 'normalized' ELSE 'fallback' END AS match_kind,
 round(CASE WHEN h.name IS NOT NULL THEN h.v[1] WHEN starts_with(w.name, 'A') THEN (SELECT min_by(v, name)[1] FROM have WHERE starts_with(name, 'App'))
  WHEN starts_with(w.name, 'c') THEN (SELECT min_by(v, name)[1] FROM have WHERE starts_with(name, 'conn')) ELSE 0 END::DOUBLE, 6) AS v1
FROM want w LEFT JOIN have h ON h.name = w.name""", "ev vecs")
def _(t):
    k, i = F.col("k"), F.col("event_id")
    want = t.ev.select(F.when(i % 4 == 0, F.concat(F.lit("App_"), k * 7)).when(i % 4 == 1, F.concat(F.lit("APP_"), k + 1000))
                       .when(i % 4 == 2, F.concat(F.lit("connection_"), k)).otherwise(F.concat(F.lit("other"), k)).alias("name"))
    have = t.vecs.select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("App_"), "id")).otherwise(F.concat(F.lit("connection_"), "id")).alias("name"), "v")
    out = J.align_embeddings(want, have, 64)
    return out.select("name", "match_kind", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("v1"))


@query("group_embeddings", """
SELECT n.node, n.g AS "group", round(coalesce(o.v[1], g.v[1])::DOUBLE, 6) AS v1, o.v IS NULL AS from_group
FROM (SELECT 'U' || c_custkey AS node, (c_nationkey % 10)::BIGINT AS g FROM customer) n LEFT JOIN vecs o ON n.node = 'U' || o.id
LEFT JOIN (SELECT label, min_by(v, id) AS v FROM vecs GROUP BY label) g ON g.label = n.g""", "vecs")
def _(t):
    nodes = t.read("customer").select(F.concat(F.lit("U"), "c_custkey").alias("node"), (F.col("c_nationkey") % 10).cast("long").alias("group"))
    own = t.vecs.select(F.concat(F.lit("U"), "id").alias("name"), "v")
    grp = t.vecs.groupBy(F.col("label").alias("group")).agg(F.min_by("v", "id").alias("v"))
    out = J.embeddings_with_group_fallback(nodes, own, grp)
    return out.select("node", "group", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("v1"), "from_group")


def _untyped(t):
    n = F.substring("node", 2, 20).cast("long")
    return J.nodes_of(t.edges).filter(n % 2 == 0).select(
        "node", F.when(n % 10 == 0, "NO LABEL").otherwise(F.concat(F.lit("u_"), n % 3)).alias("vtype"), F.lit("uf").alias("functionality"))


UNTYPED = """(SELECT node, CASE WHEN n % 10 = 0 THEN 'NO LABEL' ELSE 'u_' || (n % 3) END AS vtype, 'uf' AS functionality FROM
 (SELECT node, substr(node, 2)::BIGINT AS n FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)) WHERE n % 2 = 0)"""

for _side, _a, _b in (("typed", "types", f"(SELECT * FROM {UNTYPED} WHERE vtype <> 'NO LABEL')"),
                      ("untyped", f"(SELECT * FROM {UNTYPED} WHERE vtype <> 'NO LABEL')", "types")):
    query(f"merge_type_tables_{_side}", f"""
SELECT coalesce(a.node, b.node) AS node, coalesce(a.vtype, b.vtype) AS vtype, coalesce(a.functionality, b.functionality) AS functionality
FROM {_a} a FULL JOIN {_b} b ON a.node = b.node""", "types edges")(
        lambda t, side=_side: J.merge_type_tables(t.types, _untyped(t), side))


@query("entity_info", f"""
SELECT n.node, coalesce(a.vtype, b.vtype, 'unknown') AS vtype, coalesce(a.functionality, b.functionality, 'N/A') AS functionality
FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) n LEFT JOIN types a ON a.node = n.node LEFT JOIN {UNTYPED} b ON b.node = n.node""",
       "types edges")
def _(t):
    return J.entity_info(J.nodes_of(t.edges), t.types, _untyped(t))


@query("edge_log_map", """
SELECT log_idx AS edge_seq, log_idx, log_type FROM edges WHERE log_idx % 6 <> 0 AND log_type <> 'dns'""", "edges")
def _(t):
    rows = t.edges.select(F.col("log_idx").alias("edge_seq"),
                          F.when(F.col("log_idx") % 6 == 0, "n/a").otherwise(F.col("log_idx").cast("string")).alias("log_idx"),
                          F.when(F.col("log_type") == "dns", "").otherwise(F.col("log_type")).alias("log_type"))
    return J.edge_to_log_map(rows)


@query("nodes_on_attack_date", """
SELECT DISTINCT g.node, g.attack, g.day FROM (SELECT node, attack, '2024-01-' || lpad((1 + substr(node, 2)::BIGINT % 30)::VARCHAR, 2, '0') AS day FROM scores) g
WHERE (g.node, g.day) IN (SELECT (node, day) FROM scores)""", "scores")
def _(t):
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.substring("node", 2, 20).cast("long") % 30).cast("string"), 2, "0"))
    return J.nodes_on_date(t.scores.select("node", "day"), t.scores.select("node", "attack", day.alias("day")))


@query("fill_unknown_actions", """
SELECT log_idx, src_vtype, dst_vtype, CASE WHEN action = 'NO LABEL' THEN coalesce(CASE WHEN substr(src_vtype, 6)::BIGINT % 2 = 0 THEN 'acts_on_' || dst_vtype END, action)
 ELSE action END AS action FROM (SELECT e.log_idx, s.vtype AS src_vtype, d.vtype AS dst_vtype, CASE WHEN e.log_idx % 3 = 0 THEN 'NO LABEL' ELSE e.action END AS action
 FROM edges e JOIN types s ON e.src = s.node JOIN types d ON e.dst = d.node)""", "edges types")
def _(t):
    e = t.edges.select("log_idx", "src", "dst", F.when(F.col("log_idx") % 3 == 0, "NO LABEL").otherwise(F.col("action")).alias("action"))
    s = t.types.select(F.col("node").alias("src"), F.col("vtype").alias("src_vtype"))
    d = t.types.select(F.col("node").alias("dst"), F.col("vtype").alias("dst_vtype"))
    e = e.join(s, "src").join(d, "dst").select("log_idx", "src_vtype", "dst_vtype", "action")
    known = e.select("src_vtype", "dst_vtype").distinct().filter(F.substring("src_vtype", 6, 9).cast("long") % 2 == 0).withColumn(
        "action", F.concat(F.lit("acts_on_"), "dst_vtype"))
    return J.fill_unknown_actions(e, known)


@query("inherit_parent_names", """
SELECT log_idx, CASE WHEN sp AND NOT dp AND sn = '' THEN dn ELSE sn END AS src_names, CASE WHEN dp AND NOT sp AND dn = '' THEN sn ELSE dn END AS dst_names
FROM (SELECT log_idx, log_idx % 3 = 0 AS sp, log_idx % 5 = 0 AS dp, CASE WHEN log_idx % 2 = 0 THEN '' ELSE src END AS sn, CASE WHEN log_idx % 7 = 0 THEN '' ELSE dst END AS dn FROM edges)""",
       "edges")
def _(t):
    i = F.col("log_idx")
    e = t.edges.select(
        "log_idx", F.array(F.when(i % 3 == 0, "ParentProc").otherwise("File")).alias("src_vtypes"),
        F.array(F.when(i % 5 == 0, "the parent").otherwise("File")).alias("dst_vtypes"),
        F.array(F.when(i % 2 == 0, "datum").otherwise(F.col("src"))).alias("src_names"),
        F.array(F.when(i % 7 == 0, "x").otherwise(F.col("dst"))).alias("dst_names"))
    out = J.inherit_parent_names(e)
    return out.select("log_idx", F.array_join("src_names", "|").alias("src_names"), F.array_join("dst_names", "|").alias("dst_names"))


@query("resolve_ids", """
SELECT event_id AS id, CASE WHEN k % 4 = 0 THEN 'NONE' WHEN k % 4 = 1 THEN 'name' || k WHEN k % 4 = 2 THEN 'none' ELSE 'plain' || k END AS resolved,
 CASE WHEN k % 4 = 3 THEN 'plain' || k ELSE 'id-' || k END AS entity FROM ev""", "ev")
def _(t):
    k = F.col("k").cast("string")
    ents = t.ev.select(F.col("event_id").alias("id"), F.when(F.col("k") % 4 == 3, F.concat(F.lit("plain"), k)).otherwise(F.concat(F.lit("id-"), k)).alias("entity"))
    names = t.ev.select("k").distinct().filter("k % 4 <> 0").select(
        F.concat(F.lit("id-"), k).alias("entity"),
        F.when(F.col("k") % 4 == 1, F.array(F.lit("NONE"), F.concat(F.lit("id-"), k), F.concat(F.lit("name"), k)))
        .otherwise(F.array(F.lit("none"), F.concat(F.lit("id-"), k))).alias("names"))
    return J.resolve_ids(ents, names)


@query("hash_to_uuid", """
SELECT sha256(c_mktsegment) AS node, max_by('U' || c_custkey, c_custkey) AS uuid FROM customer GROUP BY c_mktsegment""")
def _(t):
    return J.hash_to_uuid(t.read("customer").select(N.property_hash(F.col("c_mktsegment")).alias("node"),
                                                    F.concat(F.lit("U"), "c_custkey").alias("uuid"), F.col("c_custkey").alias("seq")))


@query("reindex_features", """
SELECT n.node, coalesce(f.n, 0) AS n, coalesce(f.top, 0) AS top, (n.node IN (SELECT node FROM scores WHERE y = 1 AND score > 200))::BIGINT AS malicious
FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) n LEFT JOIN (SELECT node, count(*) AS n, max(score) AS top FROM scores GROUP BY node) f ON n.node = f.node""",
       "edges scores")
def _(t):
    f = t.scores.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    return J.reindex_features(J.nodes_of(t.edges), f, t.scores.filter("y = 1 AND score > 200"))


@query("seed_vectors", """
SELECT 'S' || (label % 3) AS scenario, 'audit' AS log_type, 'w' || (id // 100) AS window_key, id AS log_pos, round(v[1]::DOUBLE, 6) AS v1 FROM vecs""", "vecs")
def _(t):
    v = t.vecs.select(F.concat(F.lit("S"), F.col("label") % 3).alias("scenario"), F.lit("audit").alias("log_type"),
                      F.concat(F.lit("w"), F.floor(F.col("id") / 100)).alias("window_key"), F.col("id").alias("log_pos"), "v", "label")
    out = J.seed_vectors(v.drop("v", "label"), v.drop("label"), 64)
    return out.select("scenario", "log_type", "window_key", "log_pos", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("v1"))
