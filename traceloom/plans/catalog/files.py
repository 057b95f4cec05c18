"""Round trips through files: what a writer stores, a reader gives back."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from traceloom.plans.registry import query
from traceloom.session import shared_dir
from traceloom.sources import readers as R
from traceloom.sources import writers as Wr


def _place(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("read_log_tree", """
SELECT CASE WHEN k % 2 = 0 THEN 'S1' ELSE 'M2_h1' END AS scenario, CASE WHEN k % 2 = 0 THEN '' ELSE 'h1' END AS host, log_type,
 '2024-01-01 0' || (k % 2) || ':00:00_2024-01-01 0' || (k % 2 + 1) || ':00:00' AS "window", '2024-01-01_0' || (k % 2) AS window_key,
 row_number() OVER (PARTITION BY k % 2, log_type ORDER BY event_id) AS log_idx, event_id || ' ' || event_type AS line FROM ev""", "ev")
def _(t):
    root = _place(t, "logs")
    lines = t.ev.select("log_type", "k", "event_id", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("line"))
    for odd, folder in ((0, "S1"), (1, "M2/h1")):
        for lt in ("audit", "dns", "firefox"):
            part = lines.filter((F.col("k") % 2 == odd) & (F.col("log_type") == lt)).orderBy("event_id").select("line")
            part.coalesce(1).write.text(f"{root}/{folder}/{lt}/2024-01-01 0{odd}:00:00_2024-01-01 0{odd + 1}:00:00")
    return R.read_logs(t.spark, root)


RUNS = "(SELECT DISTINCT log_type, window_key, CASE WHEN log_idx % 2 = 0 THEN 'S1' ELSE 'M1_h1' END AS scenario, CASE WHEN log_idx % 3 = 0 THEN '_dbstream' ELSE '' END AS method FROM edges)"


def _runs(t):
    e = F.col("log_idx")
    return t.edges.select("log_type", "window_key", F.when(e % 2 == 0, "S1").otherwise("M1_h1").alias("scenario"),
                          F.when(e % 3 == 0, "_dbstream").otherwise("").alias("method")).distinct()


@query("seed_file_names", f"""
SELECT DISTINCT scenario, log_type, window_key AS timestamp, '/x/emb/' || log_type || '/seeds_' || scenario || '_' || window_key || '_k1000.pkl' AS path FROM {RUNS}""", "edges")
def _(t):
    path = F.concat(F.lit("/x/emb/"), "log_type", F.lit("/seeds_"), "scenario", F.lit("_"), "window_key", F.lit("_k1000.pkl"))
    paths = _runs(t).select(path.alias("path")).distinct()
    return R.seed_files(paths.union(paths.select(F.concat("path", F.lit(".bak")))).union(paths.select(F.replace("path", F.lit("_2"), F.lit("_n")))))


@query("cluster_file_names", f"""
SELECT scenario, log_type, window_key AS timestamp, '/x/emb/' || log_type || '/continual_clusters_' || scenario || '_' || window_key || method || '.json' AS path FROM {RUNS}""", "edges")
def _(t):
    path = F.concat(F.lit("/x/emb/"), "log_type", F.lit("/continual_clusters_"), "scenario", F.lit("_"), "window_key", "method", F.lit(".json"))
    return R.cluster_files(_runs(t).select(path.alias("path")))


@query("attack_graph_file_names", """
SELECT DISTINCT action AS attack, log_idx % 90 AS number, '/g/' || log_type || '/' || action || '/subgraph_' || log_idx % 90 || '.json' AS path FROM edges""", "edges")
def _(t):
    n = (F.col("log_idx") % 90).cast("string")
    paths = t.edges.select(F.concat(F.lit("/g/"), "log_type", F.lit("/"), "action", F.lit("/subgraph_"), n, F.lit(".json")).alias("path")).distinct()
    return R.attack_graph_files(paths.union(paths.select(F.replace("path", F.lit("subgraph_"), F.lit("graph_")))))


@query("log_windows", "SELECT DISTINCT log_type AS scenario, window_key || ':00:00' AS \"window\", window_key FROM edges", "edges")
def _(t):
    return R.windows_of(t.edges.select(F.col("log_type").alias("scenario"), F.concat("window_key", F.lit(":00:00")).alias("window"), "window_key"))


@query("edges_csv", "SELECT log_idx::VARCHAR AS log_idx, log_type, NULL::VARCHAR AS source_id, src AS source_name, NULL::VARCHAR AS dest_id, dst AS dest_name, action, ts_ns::VARCHAR AS timestamp, '0' AS label FROM edges", "edges")
def _(t):
    p = _place(t, "csv")
    null = F.lit(None).cast("string")
    t.edges.select("log_idx", "log_type", null.alias("source_id"), F.col("src").alias("source_name"), null.alias("dest_id"), F.col("dst").alias("dest_name"),
                   "action", F.col("ts_ns").alias("timestamp"), F.lit(0).alias("label")).write.option("header", "true").csv(p)
    return R.read_edges_csv(t.spark, p)


@query("edges_zip", """
SELECT CASE WHEN log_type = 'audit' THEN 'train' ELSE 'test' END || '/' || log_type || '/' || window_key || '.csv' AS member, log_idx::VARCHAR AS log_idx, src, dst
FROM edges WHERE log_type <> 'firefox'""", "edges")
def _(t):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        lt, w = pdf["log_type"].iloc[0], pdf["window_key"].iloc[0]
        folder = {"audit": "train", "dns": "test"}.get(lt, "other")
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr(f"{folder}/{lt}/{w}.csv", pdf[["log_idx", "src", "dst"]].to_csv(index=False))
        return pd.DataFrame({"content": [buf.getvalue()]})

    # one small archive per log type and hour, made only to have some to read
    blobs = t.edges.select("log_type", "window_key", "log_idx", "src", "dst").groupBy("log_type", "window_key").applyInPandas(pack, "content binary")
    return R.zip_rows(blobs, ["log_idx", "src", "dst"])


@query("typed_edge_files", """
SELECT src AS actor, 'a' AS actor_type, dst AS object, 'o' AS object_type, action, ts_ns, substr(window_key, 1, 10) AS day FROM edges WHERE substr(window_key, 1, 10) BETWEEN '2024-01-05' AND '2024-01-09'""", "edges")
def _(t):
    p = _place(t, "tsv")
    e = t.edges.select(F.substring("window_key", 1, 10).alias("file_day"), F.col("src").alias("actor"), F.lit("a").alias("actor_type"), F.col("dst").alias("object"),
                       F.lit("o").alias("object_type"), "action", "ts_ns")
    e.repartition("file_day").write.option("sep", "\t").partitionBy("file_day").csv(p)
    return R.read_typed_edges(t.spark, p, "2024-01-05", "2024-01-09").select("actor", "actor_type", "object", "object_type", "action", "ts_ns", "day")


GRAPH_LINES = "(SELECT log_idx AS line_no, CASE WHEN log_idx % 10 = 0 THEN 'broken' ELSE src || ' A: [' || action || '] ' || dst END AS line, src, action, dst FROM edges)"


@query("graph_lines_ruled", f"SELECT line_no, src, action, dst FROM {GRAPH_LINES} WHERE line <> 'broken'", "edges")
def _(t):
    line = F.when(F.col("log_idx") % 10 == 0, "broken").otherwise(F.concat("src", F.lit(" A: ["), "action", F.lit("] "), "dst"))
    return R.parse_graph_lines(t.edges.select(F.col("log_idx").alias("line_no"), line.alias("line")), True)


@query("graph_lines_plain", """
SELECT log_idx AS line_no, CASE WHEN m = 1 THEN src || ' b' ELSE src END AS src, CASE m WHEN 1 THEN 'read' WHEN 2 THEN action ELSE action || ' x' END AS action, CASE WHEN m = 1 THEN 'c ' || dst ELSE dst END AS dst
FROM (SELECT *, log_idx % 4 AS m FROM edges) WHERE m <> 0""", "edges")
def _(t):
    m = F.col("log_idx") % 4
    line = (F.when(m == 0, "two tokens").when(m == 1, F.concat("src", F.lit(" b read c "), "dst")).when(m == 2, F.concat_ws(" ", "src", "action", "dst"))
            .otherwise(F.concat_ws(" ", "src", "action", F.lit("x"), "dst")))
    return R.parse_graph_lines(t.edges.select(F.col("log_idx").alias("line_no"), line.alias("line")), False)


@query("numbered_lines", "SELECT row_number() OVER (ORDER BY log_idx) - 1 AS line_no, log_idx || ' ' || src AS line FROM edges", "edges")
def _(t):
    p = _place(t, "txt")
    t.edges.orderBy("log_idx").select(F.concat_ws(" ", F.col("log_idx").cast("string"), "src")).coalesce(1).write.text(p)
    return R.numbered_lines(t.spark, p).drop("file")


def _subgraphs(t):
    # a graph of each log type and day, so that a file stays as small as a day
    return t.edges.select(
        F.concat("log_type", F.lit("-"), F.substring("window_key", 1, 10)).alias("subgraph"), "src", "dst", "action", "ts_ns", F.col("log_idx").alias("edge_key"), F.lit(0.5).alias("anomaly_score"),
        (F.col("log_idx") % 2 == 0).alias("enriched"))


@query("node_link_files", "SELECT log_type || '-' || substr(window_key, 1, 10) AS subgraph, src, dst, action, ts_ns::VARCHAR AS timestamp, log_idx AS key FROM edges", "edges")
def _(t):
    p = _place(t, "nodelink")
    Wr.write_subgraphs(_subgraphs(t), p)
    g = t.spark.read.schema(R.NODE_LINK).json(p + "/graphs")
    return R.graph_links(g.select(F.regexp_extract("_metadata.file_path", "subgraph=([^/]+)", 1).alias("graph_id"), "links")).withColumnRenamed("graph_id", "subgraph")


@query("node_link_nodes", "SELECT subgraph, node FROM (SELECT log_type || '-' || substr(window_key, 1, 10) AS subgraph, src AS node FROM edges UNION SELECT log_type || '-' || substr(window_key, 1, 10), dst FROM edges)", "edges")
def _(t):
    p = _place(t, "nodelink")
    Wr.write_subgraphs(_subgraphs(t), p)
    g = t.spark.read.schema(R.NODE_LINK).json(p + "/graphs")
    return R.graph_nodes(g.select(F.regexp_extract("_metadata.file_path", "subgraph=([^/]+)", 1).alias("graph_id"), "nodes")).withColumnRenamed("graph_id", "subgraph")


@query("subgraph_summary", """
SELECT subgraph, 0.5::DOUBLE AS anomaly_score, count(DISTINCT node) AS num_nodes, (count(*) // 2)::BIGINT AS num_edges, (count(*) FILTER (log_idx % 2 = 0) // 2)::BIGINT AS enriched_edges
FROM (SELECT log_type || '-' || substr(window_key, 1, 10) AS subgraph, src AS node, log_idx FROM edges UNION ALL SELECT log_type || '-' || substr(window_key, 1, 10), dst, log_idx FROM edges) GROUP BY subgraph""", "edges")
def _(t):
    return Wr.subgraph_summary(_subgraphs(t))


@query("enriched_records", """
WITH r AS (SELECT src, dst, log_idx, action || '!' AS edge_action FROM edges WHERE log_idx % 2 = 0),
p AS (SELECT src, dst, arg_min(edge_action, log_idx) AS a FROM r GROUP BY 1, 2)
SELECT e.log_idx AS key, e.src, e.dst, coalesce(r.edge_action, p.a) AS edge_action FROM edges e LEFT JOIN r ON r.log_idx = e.log_idx LEFT JOIN p ON p.src = e.src AND p.dst = e.dst""", "edges")
def _(t):
    links = t.edges.select("src", "dst", F.col("log_idx").alias("key"))
    rec = t.edges.filter("log_idx % 2 = 0").select(
        F.col("src").alias("source_uuid"), F.col("dst").alias("target_uuid"), F.lit(None).cast("string").alias("source_node_name"), F.lit(None).cast("string").alias("target_node_name"),
        F.array("src").alias("source_enames"), F.array("dst").alias("target_enames"), F.lit("t").alias("source_type"), F.lit("t").alias("target_type"),
        F.concat("action", F.lit("!")).alias("edge_action"), F.col("src").alias("src_head"), F.col("dst").alias("dst_head"), F.col("log_idx").alias("key"))
    return R.find_enriched(links, rec).select("key", "src", "dst", "edge_action")


@query("label_list", "SELECT lower(c_name) AS label FROM customer")
def _(t):
    p = _place(t, "labels")
    t.read("customer").select(F.explode(F.array(F.concat(F.lit("  "), F.upper("c_name"), F.lit("\t")), F.lit(" ")))).write.text(p)
    return R.read_label_list(t.spark, p)


@query("truth_nodes", "SELECT 'U' || c_custkey AS node FROM customer")
def _(t):
    p = _place(t, "truth")
    t.read("customer").select(F.concat(F.lit("U"), "c_custkey", F.lit(",\"{'a': 'x,y'}\","), "c_nationkey")).write.text(p)
    return R.read_truth_nodes(t.spark, p)


@query("extension_list", "SELECT DISTINCT '.' || lower(p_type) AS extension FROM part WHERE p_size % 2 = 0")
def _(t):
    p = _place(t, "ext")
    t.read("part").select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("."), F.lower("p_type"))).otherwise(F.concat(F.lit("# "), "p_type"))).write.text(p)
    return R.read_extensions(t.spark, p)


@query("lookup_json", "SELECT s_name AS key, CASE WHEN s_nationkey % 2 = 0 THEN 'VALID' ELSE 'INVALID' END AS value FROM supplier")
def _(t):
    p = _place(t, "lookup")
    item = F.format_string('"%s": "%s"', F.col("s_name"), F.when(F.col("s_nationkey") % 2 == 0, "VALID").otherwise("INVALID"))
    # documents of a hundred entries each, with the stray comma the reader forgives
    doc = F.concat(F.lit("{"), F.array_join(F.collect_list(item), ",\n"), F.lit(",\n}"))
    docs = t.read("supplier").groupBy(F.floor(F.col("s_suppkey") / 100).alias("doc")).agg(doc.alias("value"))
    docs.write.partitionBy("doc").text(p)
    return R.read_lookup(t.spark, p).select("key", "value")


@query("truth_with_totals", "SELECT id, window_key, log_type, y, count(*) OVER (PARTITION BY window_key, log_type) AS total FROM scores", "scores")
def _(t):
    s = t.scores.select("id", "window_key", "log_type", "y")
    return R.truth_with_totals(s, s.groupBy("window_key", "log_type").agg(F.count(F.lit(1)).alias("total")))


def _labelled(t):
    return t.edges.select("window_key", "src", "dst", "action", "ts_ns", "log_idx", "log_type", (F.col("value") > 300).cast("long").alias("label"), F.lit("A1").alias("attack"))


@query("graph_files", """
SELECT window_key, split, line, edge_seq FROM (SELECT *, CASE WHEN bool_or(value > 300) OVER (PARTITION BY window_key) THEN 'test' ELSE 'train' END AS split, src || ' A: [' || action || '] ' || dst AS line,
 row_number() OVER (PARTITION BY window_key ORDER BY ts_ns, log_idx) - 1 AS edge_seq FROM edges)""", "edges")
def _(t):
    p = _place(t, "graph")
    Wr.write_graph_files(_labelled(t), p)
    return t.spark.read.parquet(p + "/edges").select("window_key", "split", "line", "edge_seq")


@query("graph_file_metadata", """
SELECT window_key, CASE WHEN bool_or(value > 300) THEN 'test' ELSE 'train' END AS split, count(*) AS total_edges, count(*) FILTER (value > 300) AS malicious_edges,
 count(*) FILTER (value <= 300) AS benign_edges, bool_or(value > 300) AS is_test, 'A1' AS attack_types FROM edges GROUP BY window_key""", "edges")
def _(t):
    p = _place(t, "graph")
    Wr.write_graph_files(_labelled(t), p)
    return t.spark.read.json(p + "/metadata")


@query("type_partitions", "SELECT node, vtype, functionality, CASE WHEN substr(node, 2)::BIGINT % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM types", "types")
def _(t):
    p = _place(t, "bytype")
    Wr.write_by_type(t.types.withColumn("split", F.when(F.substring("node", 2, 20).cast("long") % 2 == 0, "train").otherwise("test")), p)
    return t.spark.read.parquet(p).select("node", "vtype", "functionality", F.col("split").cast("string").alias("split"))


@query("embedding_files", "SELECT id, round(v[1]::DOUBLE, 6) AS v1, CASE WHEN label < 5 THEN 'train' ELSE 'test' END AS split FROM vecs", "vecs")
def _(t):
    p = _place(t, "emb")
    Wr.write_embeddings(t.vecs.select("id", "v", F.when(F.col("label") < 5, "train").otherwise("test").alias("split")), p)
    return t.spark.read.parquet(p).select("id", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("v1"), "split")


@query("result_files", "SELECT log_type, format('{:.4f}', max(score)) AS top FROM scores GROUP BY log_type", "scores")
def _(t):
    p = _place(t, "results")
    Wr.write_results(t.scores.groupBy("log_type").agg(F.max("score").alias("top")), ["top"], p)
    return t.spark.read.option("header", "true").schema("log_type string, top string").csv(p)
