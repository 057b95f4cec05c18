"""Graph, profile and cluster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import clusters as K
from traceloom.operators import graph as G
from traceloom.operators import profiles as P
from traceloom.operators import time_windows as W
from traceloom.operators import extract as X
from traceloom.operators.ordered import row_index
from traceloom.plans.catalog.extract import LENIENT_SQL
from traceloom.plans.registry import query


def _e(t):
    return t.edges.select("log_idx", "src", "dst", "action", "ts_ns", "window_key")


@query("node_table", "SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)", "edges")
def _(t):
    return G.node_table(t.edges)


@query("typed_node_table", f"""
SELECT node, kind, row_number() OVER (ORDER BY r, node) - 1 AS idx FROM (SELECT sha256(property) AS node, max_by(kind, r) AS kind, max(r) AS r FROM
 (SELECT *, CASE kind WHEN 'FileObject' THEN 0 WHEN 'Subject' THEN 1 ELSE 2 END AS r FROM ({LENIENT_SQL})) GROUP BY 1)""")
def _(t):
    return G.typed_node_table(X.cdm_nodes(t.cdm_lines).select("node", "kind"))


LIST_ROWS = """(SELECT log_idx, src, dst, CASE WHEN log_idx % 3 = 0 THEN 'NO LABEL' ELSE action END AS action, 'p' || (log_idx % 4) AS sv, 'f' || (log_idx % 5) AS dv, 'n' || log_idx AS sn, 'm' || log_idx AS dn FROM edges)"""


def _list_rows(t):
    i = F.col("log_idx")
    return t.edges.select("log_idx", "src", "dst", F.when(i % 3 == 0, "NO LABEL").otherwise(F.col("action")).alias("action"), "ts_ns",
                          F.array(F.concat(F.lit("P"), i % 4)).alias("src_vtypes"), F.array(F.concat(F.lit("F"), i % 5)).alias("dst_vtypes"),
                          F.array(F.lit("datum"), F.concat(F.lit("n"), i)).alias("src_names"), F.array(F.concat(F.lit("m"), i)).alias("dst_names"))


@query("list_rows_nodes", f"""
WITH n AS (SELECT src AS node, action IN ('NO LABEL', 'EVENT_OPEN') AS bad, log_idx * 2 AS p, sv AS vtype, sn AS attr FROM {LIST_ROWS} UNION ALL
 SELECT dst, action IN ('NO LABEL', 'EVENT_OPEN'), log_idx * 2 + 1, dv, dn FROM {LIST_ROWS})
SELECT node, CASE WHEN t IN ('p0', 'p1') THEN 'proc' ELSE t END AS vtype, attr FROM (SELECT node, coalesce(max_by(vtype, p) FILTER (bad), min_by(vtype, p) FILTER (NOT bad)) AS t, coalesce(max_by(attr, p) FILTER (bad), min_by(attr, p) FILTER (NOT bad)) AS attr FROM n GROUP BY node)""", "edges")
def _(t):
    inv = t.edges.select("action").distinct().filter("action = 'EVENT_OPEN'")
    groups = t.spark.createDataFrame([("p0", "proc"), ("p1", "proc")], "vtype string, group string")
    return G.nodes_and_edges(_list_rows(t), "log_idx", inv, groups)[0]


@query("list_rows_edges", f"SELECT src, dst, action, log_idx FROM {LIST_ROWS} WHERE action NOT IN ('NO LABEL', 'EVENT_OPEN')", "edges")
def _(t):
    inv = t.edges.select("action").distinct().filter("action = 'EVENT_OPEN'")
    return G.nodes_and_edges(_list_rows(t), "log_idx", inv)[1].drop("ts_ns")


@query("simple_window_graph", """
WITH p AS (SELECT DISTINCT substr(window_key, 1, 10) AS day, src, dst FROM edges)
SELECT day, (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM p q WHERE q.day = p.day UNION SELECT dst FROM p q WHERE q.day = p.day)) AS num_nodes, count(*) AS num_edges FROM p GROUP BY day""", "edges")
def _(t):
    return G.simple_window_graph(t.edges.withColumn("day", F.substring("window_key", 1, 10)), "day", "log_idx")


@query("global_multigraph", "SELECT window_key, log_idx AS edge_seq, src, dst, CASE WHEN value < 100 THEN ts_ns END AS ts_ns FROM edges", "edges")
def _(t):
    e = t.edges.select("window_key", F.col("log_idx").alias("edge_seq"), "src", "dst")
    at = t.edges.filter("value < 100").select("window_key", F.col("log_idx").alias("edge_seq"), "ts_ns")
    return G.global_multigraph(e, at, ["window_key", "edge_seq"])


@query("undirected_edges", "SELECT log_idx, src, dst FROM edges UNION ALL SELECT log_idx, dst, src FROM edges", "edges")
def _(t):
    return G.undirected(t.edges.select("log_idx", "src", "dst"))


@query("induced_by_type", "SELECT e.log_idx, e.src, e.dst, s.vtype FROM edges e JOIN types s ON s.node = e.src JOIN types d ON d.node = e.dst WHERE s.vtype = d.vtype", "edges types")
def _(t):
    return G.induced_by_type(t.edges.select("log_idx", "src", "dst"), t.types)


@query("trainable_types", """
WITH tr AS (SELECT * FROM types WHERE substr(node, 2)::BIGINT % 2 = 0)
SELECT n.vtype, n.train_nodes, m.train_edges FROM (SELECT vtype, count(*) AS train_nodes FROM tr GROUP BY 1) n JOIN
 (SELECT s.vtype, count(*) AS train_edges FROM edges e JOIN tr s ON s.node = e.src JOIN tr d ON d.node = e.dst WHERE s.vtype = d.vtype GROUP BY 1) m ON m.vtype = n.vtype""", "edges types")
def _(t):
    split = t.types.filter(F.substring("node", 2, 20).cast("long") % 2 == 0).select("node", F.lit("train").alias("split"))
    return G.trainable_types(t.edges, t.types, split)


@query("type_mask", "SELECT node, vtype, functionality, vtype = 'type_2' AS target FROM types", "types")
def _(t):
    return G.type_mask(t.types, "type_2")


@query("graph_halves", """
WITH n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i, count(*) OVER () AS c FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)),
h AS (SELECT node, CASE WHEN i < ceil(c / 2) THEN 0 ELSE 1 END::BIGINT AS half FROM n)
SELECT e.log_idx, e.src, e.dst, s.half FROM edges e JOIN h s ON s.node = e.src JOIN h d ON d.node = e.dst WHERE s.half = d.half""", "edges")
def _(t):
    return G.halves(t.edges.select("log_idx", "src", "dst"))


# --- profiles ------------------------------------------------------------------------------

NAME_ROWS = """(SELECT log_idx AS seq, src AS node, unnest(['/n' || (log_idx % 6) || '.x', 'n' || (log_idx % 7)]) AS name, unnest([0, 1]) AS pos FROM edges)"""


def _assigned(t):
    i = F.col("log_idx")
    rows = t.edges.select(F.col("src").alias("node"), i.alias("seq"), F.array(F.concat(F.lit("/n"), i % 6, F.lit(".x")), F.concat(F.lit("n"), i % 7)).alias("names"))
    val = t.edges.select(F.explode(F.array(F.concat(F.lit("/n"), i % 6, F.lit(".x")), F.concat(F.lit("n"), i % 7))).alias("name")).distinct()
    val = val.filter("name <> '/n5.x'").withColumn("class", F.when(F.col("name").isin("n0", "n3", "/n0.x"), "INVALID").otherwise("VALID"))
    feats = val.filter("name IN ('/n1.x', 'n1', 'n2', 'n3', '/n2.x')").select(
        "name", F.when(F.col("name") == "n2", "NO LABEL").otherwise(F.concat(F.lit("T"), F.length("name"))).alias("vtype"), F.concat(F.lit("does "), "name").alias("functionality"))
    return P.assign_types(rows, val, feats)


ASSIGN = f"""
v AS (SELECT DISTINCT name, CASE WHEN name IN ('n0', 'n3', '/n0.x') THEN 'INVALID' ELSE 'VALID' END AS class FROM {NAME_ROWS} WHERE name <> '/n5.x'),
r AS (SELECT n.node, n.seq, n.pos, n.name, class, CASE WHEN class = 'VALID' AND n.name IN ('/n1.x', 'n1', '/n2.x') THEN 't' || length(n.name) END AS ty,
  CASE WHEN class = 'VALID' AND n.name IN ('/n1.x', 'n1', 'n2', '/n2.x') THEN 'does ' || n.name END AS fu FROM {NAME_ROWS} n JOIN v ON v.name = n.name
  WHERE class <> 'INVALID'),
p AS (SELECT node, seq, string_agg(ty, '|' ORDER BY pos) AS ty, string_agg(fu, '|' ORDER BY pos) AS fu, count(DISTINCT ty) AS nt FROM r GROUP BY 1, 2),
f AS (SELECT *, min(seq) FILTER (ty IS NOT NULL) OVER (PARTITION BY node) AS first FROM p)"""


@query("assign_types", f"""
WITH {ASSIGN} SELECT node, CASE WHEN nt = 1 THEN split_part(ty, '|', 1) ELSE ty END AS vtype, fu AS functionality FROM f WHERE seq = first""", "edges")
def _(t):
    return _assigned(t)[0]


@query("untyped_nodes", f"WITH {ASSIGN} SELECT DISTINCT node FROM f WHERE ty IS NULL AND (first IS NULL OR seq < first)", "edges")
def _(t):
    return _assigned(t)[1]


ONE_HOP = """
SELECT DISTINCT node, pattern FROM (SELECT e.src AS node, lower(e.action) || '_' || d.vtype AS pattern FROM edges e JOIN types d ON d.node = e.dst
 UNION SELECT e.dst, lower(e.action) || '_by_' || s.vtype FROM edges e JOIN types s ON s.node = e.src) """


@query("one_hop_profiles", ONE_HOP + " WHERE node IN (SELECT node FROM types) OR substr(node, 2)::BIGINT % 6 = 0", "edges types")
def _(t):
    un = W_nodes(t).filter(F.substring("node", 2, 20).cast("long") % 6 == 0)
    return P.one_hop_profiles(t.edges, t.types, un)


def W_nodes(t):
    from traceloom.operators.lookup import nodes_of
    return nodes_of(t.edges)


@query("profile_matrix", "SELECT node, " + ", ".join(
    f"count(*) FILTER (pattern = 'event_{a}_{b}type_{i}') AS event_{a}_{b}type_{i}" for a in ("execute", "open", "read", "sendto", "write") for b in ("", "by_") for i in range(5))
    + f" FROM ({ONE_HOP}) WHERE node IN (SELECT node FROM types) GROUP BY node", "edges types")
def _(t):
    return P.profile_matrix(P.one_hop_profiles(t.edges, t.types, None))


@query("causal_paths_short", """
WITH adj AS (SELECT e.src, e.dst, lower(e.action) || '_' || d.vtype AS step, min(e.log_idx) AS s FROM edges e JOIN types d ON d.node = e.dst GROUP BY ALL),
st AS (SELECT DISTINCT src AS start FROM adj WHERE src IN (SELECT node FROM types)),
l1 AS (SELECT start, dst AS node, step AS path, s FROM st JOIN adj ON adj.src = st.start),
v1 AS (SELECT start, node, arg_min(path, (s, path)) AS path FROM l1 WHERE node <> start GROUP BY 1, 2)
SELECT start AS node, path AS pattern FROM l1 UNION SELECT v1.start, v1.path || '|' || a.step FROM v1 JOIN adj a ON a.src = v1.node""", "edges types")
def _(t):
    return P.causal_profiles(t.edges, t.types, "log_idx", max_depth=2)


def _levels(n: int) -> str:
    """A breadth-first search of up to ``n`` levels; it ends by itself where a level finds nothing new."""
    sql = """
WITH adj AS MATERIALIZED (SELECT e.src, e.dst, lower(e.action) || '_' || d.vtype AS step, min(e.log_idx) AS s FROM edges e JOIN types d ON d.node = e.dst GROUP BY ALL),
f0 AS MATERIALIZED (SELECT DISTINCT src AS start, src AS node, '' AS path, 0::BIGINT AS pos FROM adj WHERE src IN (SELECT node FROM types)),
v0 AS MATERIALIZED (SELECT start, node FROM f0)"""
    for i in range(1, n + 1):
        sql += f""",
r{i} AS MATERIALIZED (SELECT f.start, a.dst AS node, f.node AS parent, f.pos, a.s, a.step, CASE WHEN path = '' THEN step ELSE path || '|' || step END AS path
 FROM f{i - 1} f JOIN adj a ON a.src = f.node),
f{i} AS MATERIALIZED (SELECT start, node, b.path AS path, (SELECT max(pos) FROM f{i - 1}) + row_number() OVER (PARTITION BY start ORDER BY b.pos, b.s, b.step, node) AS pos FROM
 (SELECT start, node, arg_min({{'path': path, 'pos': pos, 's': s, 'step': step}}, (pos, s, step, parent)) AS b FROM r{i} r ANTI JOIN v{i - 1} v USING (start, node) GROUP BY 1, 2)),
v{i} AS MATERIALIZED (SELECT * FROM v{i - 1} UNION ALL SELECT start, node FROM f{i})"""
    return sql + "\n" + " UNION ".join(f"SELECT start AS node, path AS pattern FROM r{i}" for i in range(1, n + 1))


@query("causal_paths", _levels(12), "edges types")
def _(t):
    return P.causal_profiles(t.edges, t.types, "log_idx")


# --- attack graphs ---------------------------------------------------------------------------

@query("expand_seeds", """
WITH an AS (SELECT node FROM scores GROUP BY node HAVING max(score) >= 250 UNION SELECT 'K' || s_suppkey FROM supplier WHERE s_nationkey < 5),
nb AS (SELECT src AS node, dst AS nb FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
sd AS (SELECT node AS seed FROM (SELECT node, max(score) AS s FROM scores GROUP BY node) ORDER BY s DESC, node LIMIT 15),
near AS (SELECT seed, nb AS node FROM sd JOIN nb ON nb.node = sd.seed),
f AS (SELECT seed, node FROM near WHERE node IN (SELECT node FROM an)),
far AS (SELECT n.seed, n.node AS via, x.nb AS node FROM near n JOIN nb x ON x.node = n.node WHERE x.nb <> n.seed AND x.nb IN (SELECT node FROM an) AND (n.seed, x.nb) NOT IN (SELECT (seed, node) FROM f)),
b AS (SELECT seed, node, min(via) AS via FROM far GROUP BY 1, 2)
SELECT seed, seed AS node FROM sd UNION SELECT * FROM f UNION SELECT seed, node FROM b UNION SELECT seed, via FROM b""", "edges scores")
def _(t):
    mx = t.scores.groupBy("node").agg(F.max("score").alias("score"))
    an = mx.filter("score >= 250").select("node").union(t.read("supplier").filter("s_nationkey < 5").select(F.concat(F.lit("K"), "s_suppkey").alias("node")))
    return G.expand_seeds(t.edges, W.top_seeds(mx, 15), an)


@query("attack_subgraphs")
def _(t):
    mx = t.scores.groupBy("node").agg(F.max("score").alias("score"))
    out = G.extract_subgraphs(t.edges.select("log_idx", "src", "dst", "action"), mx, 200.0, seeds=5, max_edges=400, top=4)
    return out.withColumn("anomaly_score", F.round("anomaly_score", 6))


@query("distinct_subgraphs", """
WITH g AS (SELECT log_type || (log_idx % 30) AS subgraph, string_agg(src || dst || action, ',' ORDER BY src, dst, action) AS sig FROM (SELECT log_type, log_idx, src, dst, action FROM edges
 UNION ALL SELECT 'copy', log_idx, src, dst, action FROM edges WHERE log_type = 'dns') GROUP BY 1)
SELECT min(subgraph) AS subgraph FROM g GROUP BY sig""", "edges")
def _(t):
    e = t.edges.select("log_type", F.col("log_idx").alias("m"), "src", "dst", "action")
    e = e.unionByName(e.filter("log_type = 'dns'").withColumn("log_type", F.lit("copy")))
    return G.drop_duplicate_subgraphs(e.withColumn("subgraph", F.concat("log_type", F.col("m") % 30))).select("subgraph").distinct()


@query("rank_subgraphs", """
WITH s AS (SELECT node, max(score) AS score FROM scores GROUP BY node), n AS (SELECT log_type AS subgraph, src AS node FROM edges UNION SELECT log_type, dst FROM edges)
SELECT subgraph, round(0.7 * avg(coalesce(score, 0)) + 0.3 * max(coalesce(score, 0)), 6) AS anomaly_score, count(*) AS num_nodes FROM n LEFT JOIN s ON s.node = n.node GROUP BY subgraph""", "edges scores")
def _(t):
    mx = t.scores.groupBy("node").agg(F.max("score").alias("score"))
    e = t.edges.select(F.col("log_type").alias("subgraph"), "src", "dst")
    return G.rank_subgraphs(e, mx).withColumn("anomaly_score", F.round("anomaly_score", 6))


def _day_graphs(t):
    return t.edges.select(F.substring("window_key", 1, 10).alias("graph"), "log_idx", "src", "dst", "action")


def _parts_sql(rounds: int = 12) -> str:
    sql = """
WITH de AS MATERIALIZED (SELECT substr(window_key, 1, 10) AS graph, log_idx, src, dst, action FROM edges),
nb AS MATERIALIZED (SELECT graph, src AS node, dst AS nb FROM de UNION SELECT graph, dst, src FROM de),
s0 AS MATERIALIZED (SELECT DISTINCT graph, node, node AS root, 0::BIGINT AS dist FROM nb)"""
    for i in range(1, rounds + 1):
        sql += f""",
s{i} AS MATERIALIZED (SELECT graph, node, arg_min(root, (root, dist)) AS root, arg_min(dist, (root, dist)) AS dist FROM (SELECT * FROM s{i - 1} UNION ALL
 SELECT n.graph, n.node, s.root, s.dist + 1 FROM nb n JOIN s{i - 1} s ON s.graph = n.graph AND s.node = n.nb) GROUP BY 1, 2)"""
    return sql + f""",
pt AS MATERIALIZED (SELECT graph, node, (row_number() OVER (PARTITION BY graph ORDER BY root, dist, node) - 1) // 40 AS part FROM s{rounds})
"""


@query("split_parts", _parts_sql() + """SELECT n.graph, n.node, a.part, bool_or(b.part < a.part) AS incoming, bool_or(b.part > a.part) AS outgoing
FROM nb n JOIN pt a ON a.graph = n.graph AND a.node = n.node JOIN pt b ON b.graph = n.graph AND b.node = n.nb GROUP BY ALL""", "edges")
def _(t):
    return G.split_parts(_day_graphs(t), "graph", 40)


@query("part_edges", _parts_sql() + """SELECT e.graph, e.log_idx, e.src, e.dst, e.action, greatest(a.part, b.part) AS part
FROM de e JOIN pt a ON a.graph = e.graph AND a.node = e.src JOIN pt b ON b.graph = e.graph AND b.node = e.dst""", "edges")
def _(t):
    e = _day_graphs(t)
    return G.part_edges(e, G.split_parts(e, "graph", 40), "graph")


# links lead from earlier to later parts, so the smallest part left is always free
@query("part_order", _parts_sql() + "SELECT graph, part, row_number() OVER (PARTITION BY graph ORDER BY part) - 1 AS position FROM (SELECT DISTINCT graph, part FROM pt)", "edges")
def _(t):
    e = _day_graphs(t)
    parts = G.split_parts(e, "graph", 40)
    return G.part_order(G.part_links(e, parts, "graph"), parts, "graph")


@query("first_functions", "SELECT node, min_by(i, p) AS info FROM (SELECT src AS node, action AS i, log_idx * 2 AS p FROM edges UNION ALL SELECT dst, log_type, log_idx * 2 + 1 FROM edges) GROUP BY node", "edges")
def _(t):
    return G.first_functions(t.edges.select("log_idx", "src", "dst", F.col("action").alias("src_info"), F.col("log_type").alias("dst_info")), "log_idx")


@query("nodes_from_sentences", "SELECT src AS node FROM edges UNION SELECT dst FROM edges", "edges")
def _(t):
    s = t.edges.select(F.concat("src", F.lit(" --"), "action", F.lit("--> "), "dst", F.when(F.col("log_idx") % 2 == 0, " (x3)").otherwise("")).alias("sentence"))
    return G.nodes_from_sentences(s)


def _dot(t):
    i = F.col("log_idx")
    red = F.when(F.col("value") > 100, "red").otherwise("blue")
    numbered = row_index(t.edges, ["log_type"], ["log_idx"], "r")
    body = numbered.select(F.col("log_type").alias("graph"), "r", F.posexplode(F.array(
        F.concat(F.lit('\t"a" [color='), red, F.lit(' label="'), "src", F.lit('"]')),
        F.concat(F.lit('\t"b" [color='), F.when(i % 5 == 0, "red").otherwise("blue"), F.lit(' label="'), "dst", F.lit('"]')),
        F.concat(F.lit('\t"a" -> "b" [label='), "action", F.lit(" color=blue]")))).alias("p", "line"))
    body = body.select("graph", (F.col("r") * 3 + F.col("p") + 3).cast("long").alias("no"), "line")
    head = t.edges.select(F.col("log_type").alias("graph")).distinct().select("graph", F.posexplode(F.array(F.lit("digraph {"), F.lit("a"), F.lit("b"))).alias("no", "line"))
    tail = body.groupBy("graph").agg((F.max("no") + 1).alias("no")).withColumn("line", F.lit("}"))
    return body.unionByName(head).unionByName(tail)


@query("coloured_edges", "SELECT log_type AS graph, src, dst, action, value > 100 AS src_red, log_idx % 5 = 0 AS dst_red, value > 100 OR log_idx % 5 = 0 AS any_red, row_number() OVER (PARTITION BY log_type ORDER BY log_idx) - 1 AS \"no\" FROM edges", "edges")
def _(t):
    return G.coloured_edges(_dot(t).withColumnRenamed("no", "line_no"), "graph", "line_no")


@query("coloured_nodes", """
SELECT src AS node, value > 100 AS malicious FROM edges WHERE value > 100 OR log_idx % 5 = 0 UNION SELECT dst, log_idx % 5 = 0 FROM edges WHERE value > 100 OR log_idx % 5 = 0""", "edges")
def _(t):
    return G.coloured_nodes(G.coloured_edges(_dot(t).withColumnRenamed("no", "line_no"), "graph", "line_no"))


# --- clusters ----------------------------------------------------------------------------------

def _seeds(t):
    return t.vecs.select("id", F.concat(F.lit("t"), F.col("label") % 3).alias("log_type"), F.concat(F.lit("w"), F.lpad(F.floor(F.col("id") / 100).cast("string"), 3, "0")).alias("window_key"), "v")


@query("continual_clusters")
def _(t):
    return K.continual_clusters(_seeds(t), threshold=1.2)


@query("cluster_candidates")
def _(t):
    s = _seeds(t)
    members = K.continual_clusters(s, threshold=1.2)
    return K.candidate_logs(members, s.select("log_type", "window_key", "id", F.concat(F.lit("log "), "id").alias("line")), 3, "k")


@query("cluster_members", """
WITH m AS (SELECT log_type, window_key, log_idx AS id, log_idx * 7 % 211 AS cluster, src || ' ' || dst AS line FROM edges),
t AS (SELECT log_type, window_key, count(*) AS total_points, count(DISTINCT cluster) AS num_clusters FROM m GROUP BY 1, 2)
SELECT m.*, count(*) OVER (PARTITION BY m.log_type, m.window_key, cluster) AS cluster_points, total_points, num_clusters
FROM m JOIN t ON t.log_type = m.log_type AND t.window_key = m.window_key""", "edges")
def _(t):
    return K.cluster_members(t.edges.select("log_type", "window_key", F.col("log_idx").alias("id"), (F.col("log_idx") * 7 % 211).alias("cluster"),
                                            F.concat_ws(" ", "src", "dst").alias("line")))


@query("cluster_table", """
SELECT log_type, cluster, count(*) AS n, min(window_key) AS first_window, max(window_key) AS last_window FROM (SELECT log_type, log_idx * 7 % 211 AS cluster, window_key FROM edges) GROUP BY 1, 2""", "edges")
def _(t):
    return K.cluster_table(t.edges.select("log_type", (F.col("log_idx") * 7 % 211).alias("cluster"), "window_key"))
