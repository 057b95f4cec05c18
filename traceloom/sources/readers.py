"""Readers for logs, edges, graphs, labels and lookups.

All readers are splittable file scans with a fixed schema. Facts that live in
directory names become columns, so date and type conditions prune files.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.edge_text import trim_all
from traceloom.operators.ordered import row_index

EDGE_SCHEMA = ("log_idx string, log_type string, source_id string, source_name string, dest_id string, dest_name string, "
               "action string, timestamp string, label string")
TYPED_EDGE_SCHEMA = "actor string, actor_type string, object string, object_type string, action string, ts_ns bigint"

# Verbs that split a plain graph line, and the layout of log folders.
KNOWN_VERBS = ["resolve", "web_request", "read", "connect"]
LOG_PATH = r"/([SM]\d+)(?:/(h\d+))?/([^/]+)/(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}_\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})/[^/]*$"


def numbered_lines(spark: SparkSession, path: str, name: str = "line_no", start: int = 0) -> DataFrame:
    """Text lines with their number in the file: (file, line_no, line).

    A line's order is its split offset plus its place in the split, so large files
    are still read in parallel.
    """
    t = spark.read.option("recursiveFileLookup", "true").text(path)
    t = t.select(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file"),
                 F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"), F.col("value").alias("line"))
    return row_index(t, ["file"], ["_b", "_m"], name, start).select("file", name, "line")


def log_folders(df: DataFrame, file: str = "file") -> DataFrame:
    """Add scenario, host, log_type and window from a log folder path; multi-host scenarios read 'scenario_host'."""
    def part(i: int):
        return F.regexp_extract(file, LOG_PATH, i)
    return df.withColumns({
        "scenario": F.when(part(2) == "", part(1)).otherwise(F.concat_ws("_", part(1), part(2))), "host": part(2),
        "log_type": part(3), "window": part(4),
        "window_key": F.regexp_replace(F.substring(part(4), 1, 13), " ", "_")})


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """Raw logs of a scenario tree, with 1-based log numbers per window and type."""
    return log_folders(numbered_lines(spark, root, "log_idx", start=1)).drop("file")


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Paths of the files below ``root`` whose name fits the glob ``pattern``: (path). Spark lists the folders; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"))


def _run_files(paths: DataFrame, core: str) -> DataFrame:
    """Scenario, log type and timestamp of run files: the folder is the log type, the name holds scenario and a dated timestamp."""
    name = F.regexp_extract("path", core, 2)
    dated = r"^(?:(.*?)_)?(\d{4}-\d{2}-\d{2}.*)$"
    out = paths.select(F.regexp_extract(name, dated, 1).alias("scenario"), F.regexp_extract("path", core, 1).alias("log_type"),
                       F.regexp_extract(name, dated, 2).alias("timestamp"), "path")
    return out.filter("timestamp <> ''")


def seed_files(paths: DataFrame) -> DataFrame:
    """``…/{log type}/seeds_{scenario}_{timestamp}_k{n}.pkl`` as (scenario, log_type, timestamp, path); other paths are left out."""
    return _run_files(paths, r"([^/]+)/seeds_(.+?)_k\d+\.pkl$")


def cluster_files(paths: DataFrame) -> DataFrame:
    """``…/{log type}/continual_clusters_{scenario}_{timestamp}[_method].json`` likewise; a known method is no part of the timestamp."""
    return _run_files(paths, r"([^/]+)/continual_clusters_(.+?)(?:_dbstream|_denstream)?\.json$")


def attack_graph_files(paths: DataFrame) -> DataFrame:
    """``…/{attack}/subgraph_{number}.json`` as (attack, number, path)."""
    form = r"([^/]+)/subgraph_(\d+)\.json$"
    out = paths.select(F.regexp_extract("path", form, 1).alias("attack"), F.regexp_extract("path", form, 2).try_cast("bigint").alias("number"), "path")
    return out.filter("number IS NOT NULL")


def windows_of(logs: DataFrame) -> DataFrame:
    """Union of the windows of all log types per scenario."""
    return logs.select("scenario", "window", "window_key").distinct()


def read_edges_csv(spark: SparkSession, path: str, schema: str = EDGE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").csv(path)


def zip_rows(blobs: DataFrame, columns: list[str], only: str = "(train|test)") -> DataFrame:
    """CSV members of zip archives (``content`` column) whose path matches ``only``, as text columns plus ``member``.

    An archive cannot be split, so one archive is the unit of work; members are
    streamed in batches.
    """
    keep = re.compile(only)

    def rows(batches):
        for pdf in batches:
            for blob in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for m in z.namelist():
                        if not m.endswith(".csv") or not keep.search(m):
                            continue
                        with z.open(m) as f:
                            reader = csv.DictReader(io.TextIOWrapper(f, "utf-8"))
                            while chunk := list(itertools.islice(reader, 10_000)):
                                yield pd.DataFrame([[m] + [r.get(c) for c in columns] for r in chunk], columns=["member", *columns])

    schema = "member string, " + ", ".join(f"`{c}` string" for c in columns)
    return blobs.select("content").mapInPandas(rows, schema)


def read_edges_zip(spark: SparkSession, path: str, columns: list[str], only: str = "(train|test)") -> DataFrame:
    return zip_rows(spark.read.format("binaryFile").load(path), columns, only)


def read_typed_edges(spark: SparkSession, path: str, first_day: str, last_day: str) -> DataFrame:
    """Tab-separated typed edges from files whose name starts with a day in the range."""
    e = spark.read.schema(TYPED_EDGE_SCHEMA).option("sep", "\t").csv(path)
    day = F.regexp_extract("_metadata.file_path", r"(\d{4}-\d{2}-\d{2})[^/]*(?:/part-[^/]*)?$", 1)
    return e.select("*", day.alias("day")).filter(F.col("day").between(first_day, last_day))


def parse_graph_lines(lines: DataFrame, ruled: bool) -> DataFrame:
    """Edges of graph text lines (src, action, dst), the line number kept.

    ``ruled`` lines read 'src A: [action] dst'. Others are split at the first known
    verb, else at the middle token(s).
    """
    line = trim_all(F.col("line"))
    if ruled:
        form = r"^(.*?) A: \[(.*?)\]\s*(.*)$"
        d = lines.withColumns({n: trim_all(F.regexp_extract(line, form, i)) for i, n in ((1, "src"), (2, "action"), (3, "dst"))})
        return d.filter("src <> '' AND action <> '' AND dst <> ''").drop("line")
    p = F.split(line, r"\s+")
    hits = F.filter(F.transform(p, lambda x, i: F.when(x.isin(KNOWN_VERBS), i)), lambda x: x.isNotNull())
    d = lines.withColumns({"_p": p, "_v": F.get(hits, F.lit(0)), "_n": F.size(p)})

    def words(a, n):
        return F.array_join(F.slice("_p", a, F.greatest(n, F.lit(0))), " ")

    known = F.col("_v").isNotNull()
    src = F.when(known, words(F.lit(1), F.col("_v"))).otherwise(F.get("_p", F.lit(0)))
    act = F.when(known, F.get("_p", F.col("_v"))).otherwise(words(F.lit(2), F.col("_n") - 2))
    dst = F.when(known, words(F.col("_v") + 2, F.col("_n") - F.col("_v") - 1)).otherwise(F.element_at("_p", -1))
    d = d.filter("_n >= 3").withColumns({"src": src, "action": act, "dst": dst}).drop("_p", "_v", "_n", "line")
    return d.filter("src <> '' AND action <> '' AND dst <> ''")


LINK = "struct<action:string,type:string,timestamp:string,source:string,target:string,key:bigint>"
NODE_LINK = f"directed boolean, multigraph boolean, graph struct<anomaly_score:double>, nodes array<struct<id:string>>, links array<{LINK}>"


def read_node_link(spark: SparkSession, path: str) -> DataFrame:
    """Node-link JSON graphs, one row per file, with a ``graph_id`` from the file name."""
    g = spark.read.schema(NODE_LINK).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return g.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json[^/]*$", 1).alias("graph_id"), "*")


def graph_links(g: DataFrame) -> DataFrame:
    e = g.select("graph_id", F.inline("links"))
    return e.select("graph_id", F.col("source").alias("src"), F.col("target").alias("dst"),
                    F.coalesce("action", "type").alias("action"), "timestamp", "key")


def graph_nodes(g: DataFrame) -> DataFrame:
    return g.select("graph_id", F.explode("nodes.id").alias("node"))


ENRICHED = ("source_uuid string, target_uuid string, source_node_name string, target_node_name string, source_enames array<string>, "
            "target_enames array<string>, source_type string, target_type string, source_functionality string, "
            "target_functionality string, edge_action string, edge_type string, timestamp string")


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    """Enriched edge records with the pair and key that their file name states."""
    e = spark.read.schema(ENRICHED).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    name = F.col("_metadata.file_path")
    form = r"edge_([^/]*)_to_([^/]*)_(\d+)[^/]*$"
    return e.select("*", F.regexp_extract(name, form, 1).alias("src_head"), F.regexp_extract(name, form, 2).alias("dst_head"),
                    F.regexp_extract(name, form, 3).cast("long").alias("key"))


def find_enriched(links: DataFrame, enriched: DataFrame) -> DataFrame:
    """Enriched record of each link: same id heads and key, else the first of the same pair."""
    rec = F.struct("source_enames", "target_enames", "source_type", "target_type", "edge_action")
    exact = enriched.groupBy("src_head", "dst_head", "key").agg(F.min_by(rec, F.struct("source_uuid", "target_uuid")).alias("_x"))
    src = F.coalesce("source_node_name", "source_uuid").alias("src")
    dst = F.coalesce("target_node_name", "target_uuid").alias("dst")
    pair = enriched.select(src, dst, "key", rec.alias("_r")).groupBy("src", "dst").agg(F.min_by("_r", "key").alias("_y"))
    l = links.withColumns({"src_head": F.get(F.split("src", "-"), F.lit(0)), "dst_head": F.get(F.split("dst", "-"), F.lit(0))})
    l = l.join(exact, ["src_head", "dst_head", "key"], "left").join(pair, ["src", "dst"], "left")
    return l.select(*links.columns, F.coalesce("_x", "_y").alias("r")).select(*links.columns, "r.*")


def read_label_list(spark: SparkSession, path: str) -> DataFrame:
    """One lower-cased substring per non-empty line."""
    return spark.read.text(path).select(F.lower(trim_all(F.col("value"))).alias("label")).filter("label <> ''")


def read_truth_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Malicious node ids: the text before the first comma of each line."""
    return spark.read.text(path).select(F.trim(F.get(F.split("value", ",", 2), F.lit(0))).alias("node")).filter("node <> ''")


def read_extensions(spark: SparkSession, path: str) -> DataFrame:
    """Known file extensions: lines that start with a dot."""
    return spark.read.text(path).select(trim_all(F.col("value")).alias("extension")).filter("extension LIKE '.%'").distinct()


def read_lookup(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """A JSON object file as (key, value) rows; commas before a closing bracket are forgiven.

    Lookup files are small documents by nature; each is one row.
    """
    t = spark.read.text(path, wholetext=True)
    fixed = F.regexp_replace("value", r",(\s*[}\]])", "$1")
    return t.select(F.explode(F.from_json(fixed, f"map<string,{value}>")).alias("key", "value"))


def truth_with_totals(labels: DataFrame, totals: DataFrame) -> DataFrame:
    """Log-level labels with the number of logs of their window and type."""
    return labels.join(totals, ["window_key", "log_type"])
