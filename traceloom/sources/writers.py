"""Writers for graphs, features, subgraphs and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.aggregates import window_metadata
from traceloom.operators.metrics import results_table
from traceloom.operators.time_windows import edge_sequence, split_windows


def write_graph_files(e: DataFrame, root: str, order: Sequence[str] = ("ts_ns", "log_idx")) -> None:
    """Per window: graph text, edge rows, labels and metadata, in train and test folders.

    Columns: ``window_key, src, dst, action, ts_ns, log_idx, log_type, label, attack``.
    Windows are folders, so the files of many windows are written in parallel.
    """
    s = edge_sequence(split_windows(e), ["window_key"], list(order))
    line = F.concat("src", F.lit(" A: ["), "action", F.lit("] "), "dst")
    rows = s.withColumn("line", line).repartition("split", "window_key", F.floor(F.col("edge_seq") / 1_000_000))
    rows = rows.sortWithinPartitions("split", "window_key", "edge_seq")
    rows.write.mode("overwrite").partitionBy("split", "window_key").parquet(f"{root}/edges")
    rows.select("split", "window_key", "line").write.mode("overwrite").partitionBy("split", "window_key").text(f"{root}/graph_txt")
    rows.select("split", "window_key", "edge_seq", F.when(F.col("label") == 1, F.col("attack")).alias("attack")).write.mode(
        "overwrite").partitionBy("split", "window_key").option("header", "true").csv(f"{root}/labels")
    window_metadata(s, "split", "window_key").write.mode("overwrite").json(f"{root}/metadata")


def write_by_type(features: DataFrame, root: str) -> None:
    """Feature rows in one folder per split and node type."""
    features.write.mode("overwrite").partitionBy("split", "vtype").parquet(root)


def write_embeddings(vectors: DataFrame, root: str) -> None:
    """Vectors in one folder per split; reading the root gives all of them."""
    vectors.write.mode("overwrite").partitionBy("split").parquet(root)


def subgraph_json(e: DataFrame, subgraph: str = "subgraph") -> DataFrame:
    """Node-link JSON text per subgraph. Subgraphs were cut to a bounded edge count before."""
    link = F.struct(F.col("action"), F.col("ts_ns").cast("string").alias("timestamp"), F.col("src").alias("source"),
                    F.col("dst").alias("target"), F.col("edge_key").alias("key"))
    links = e.groupBy(subgraph, "anomaly_score").agg(F.array_sort(F.collect_list(link)).alias("links"))
    nodes = e.select(subgraph, F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy(subgraph).agg(
        F.array_sort(F.collect_list(F.struct("id"))).alias("nodes"))
    doc = F.struct(F.lit(True).alias("directed"), F.lit(True).alias("multigraph"), F.struct("anomaly_score").alias("graph"), "nodes", "links")
    return links.join(nodes, subgraph).select(subgraph, F.to_json(doc).alias("json"))


def subgraph_summary(e: DataFrame, subgraph: str = "subgraph") -> DataFrame:
    ends = e.select(subgraph, "anomaly_score", "enriched", F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy(subgraph, "anomaly_score").agg(
        F.count_distinct("node").alias("num_nodes"), (F.count(F.lit(1)) / 2).cast("long").alias("num_edges"),
        (F.count_if("enriched") / 2).cast("long").alias("enriched_edges"))


def write_subgraphs(e: DataFrame, root: str, subgraph: str = "subgraph") -> None:
    subgraph_json(e, subgraph).write.mode("overwrite").partitionBy(subgraph).text(f"{root}/graphs")
    subgraph_summary(e, subgraph).write.mode("overwrite").option("header", "true").csv(f"{root}/summary")


def write_results(m: DataFrame, columns: Sequence[str], root: str) -> None:
    results_table(m, columns).write.mode("overwrite").option("header", "true").csv(root)
