"""Continual clustering of seed vectors, window after window."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions import vectors as V
from traceloom.operators.ordered import row_index
from traceloom.operators.time_windows import new_clusters, sample_per_group
from traceloom.session import cut

CENTRES = "log_type string, cluster long, v array<double>, weight double, step long"


def _absorb(seeds: pd.DataFrame, centres: pd.DataFrame, threshold: float, fading: float):
    """Give each seed to its nearest centre within the threshold, else open a new cluster.

    Seeds come in the order of their ``step``; weights fade once for every step that begins.
    """
    ids = list(centres["cluster"])
    n, nxt = len(ids), max(ids, default=-1) + 1
    first = int(seeds["step"].iloc[0]) if len(seeds) else 0
    step = int(centres["step"].max()) if n else first
    weight = np.append(np.asarray(centres["weight"], dtype=float), np.zeros(len(seeds)))
    vecs = np.stack([np.asarray(v, dtype=float) for v in centres["v"]]) if n else None
    labels = []
    for v, at in zip(seeds["v"], seeds["step"]):
        v = np.asarray(v, dtype=float)
        while step < at:
            weight[:n] *= 2.0 ** -fading
            step += 1
        d = np.linalg.norm(vecs[:n] - v, axis=1) if n else np.array([np.inf])
        i = int(d.argmin())
        if d[i] <= threshold:
            vecs[i] = (vecs[i] * weight[i] + v) / (weight[i] + 1.0)
            weight[i] += 1.0
        else:
            if vecs is None or n == len(vecs):
                vecs = np.concatenate([np.zeros((0, len(v))) if vecs is None else vecs, np.zeros((max(n, 16), len(v)))])
            i, n = n, n + 1
            vecs[i], weight[i] = v, 1.0
            ids.append(nxt)
            nxt += 1
        labels.append(ids[i])
    return labels, ids, vecs if n else [], weight[:n], step


def _absorbed(seeds: DataFrame, centres: DataFrame, threshold: float, fading: float) -> DataFrame:
    """Members and updated centres of every log type; ``seeds(id, log_type, v, step)``."""
    kind = dict(seeds.dtypes)["id"]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["step", "id"])
        labels, ids, vecs, weight, step = _absorb(left, right, threshold, fading)
        a = pd.DataFrame({"log_type": key[0], "id": left["id"].values, "cluster": labels, "step": left["step"].values})
        b = pd.DataFrame({"log_type": [key[0]] * len(ids), "cluster": ids, "v": [list(map(float, v)) for v in vecs[:len(ids)]], "weight": weight, "step": step})
        return pd.concat([a.assign(v=None, weight=np.nan), b.assign(id=None)])[["log_type", "id", "cluster", "v", "weight", "step"]]

    return seeds.select("id", "log_type", "v", "step").groupBy("log_type").cogroup(centres.groupBy("log_type")).applyInPandas(
        run, f"log_type string, id {kind}, cluster long, v array<double>, weight double, step long")


def cluster_step(seeds: DataFrame, centres: DataFrame, step: int, threshold: float = 0.6, fading: float = 0.005) -> DataFrame:
    """One window: members and updated centres of every log type, in one table.

    ``seeds(id, log_type, v)``; log types run side by side. A row has ``id`` for a
    member, or ``v``/``weight`` for a centre.
    """
    return _absorbed(seeds.withColumn("step", F.lit(step).cast("long")), centres, threshold, fading)


def continual_clusters(seeds: DataFrame, threshold: float = 0.6, fading: float = 0.005, chunk_rows: int = 5000) -> DataFrame:
    """Cluster seeds in window order per log type, with centres carried forward: (id, log_type, window_key, cluster).

    The assignment is sequential, so the seeds of a log type, in the order of windows and ids, are worked off in chunks of
    ``chunk_rows``, all log types together: small windows share a chunk and a large one takes several, with the same result.
    A task holds one chunk and the centres. The driver learns the number of chunks only.
    """
    unit = seeds.select("id", "log_type", "window_key", V.l2_normalized(F.col("v")).alias("v"))
    windows = row_index(unit.select("window_key").distinct(), [], ["window_key"], "step").withColumnRenamed("window_key", "_w")
    unit = unit.join(windows, F.col("window_key").eqNullSafe(F.col("_w"))).drop("_w")
    unit = row_index(unit, ["log_type"], ["step", "id"], "_pos")
    unit = cut(unit.withColumn("_chunk", F.floor(F.col("_pos") / chunk_rows)))
    chunks = unit.agg(F.coalesce(F.max("_chunk") + 1, F.lit(0))).first()[0]
    centres = unit.sparkSession.createDataFrame([], CENTRES)
    out = unit.sparkSession.createDataFrame([], f"id {dict(unit.dtypes)['id']}, log_type string, cluster long, step long")
    for no in range(chunks):
        res = cut(_absorbed(unit.filter(F.col("_chunk") == no), centres, threshold, fading))
        out = out.unionByName(res.filter("v IS NULL").select("id", "log_type", "cluster", "step"))
        centres = res.filter("v IS NOT NULL").select("log_type", "cluster", "v", "weight", "step")
        if no % 32 == 31:  # a long run keeps its plan short
            out = cut(out)
    return out.join(windows, "step").select("id", "log_type", F.col("_w").alias("window_key"), "cluster")


def cluster_table(members: DataFrame) -> DataFrame:
    """Cluster sizes and spans; members stay rows of the input."""
    return members.groupBy("log_type", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("window_key").alias("first_window"),
                                                      F.max("window_key").alias("last_window"))


def cluster_members(members: DataFrame) -> DataFrame:
    """Every member row with the facts of its clustering run: (…, total_points, num_clusters, cluster_points).

    A run is a log type and window; ``members`` keeps its own columns. Facts are aggregates joined back, so a large run stays
    spread and a cluster's members stay rows.
    """
    run = ["log_type", "window_key"]
    size = members.groupBy(*run, "cluster").agg(F.count(F.lit(1)).alias("cluster_points"))
    total = size.groupBy(*run).agg(F.sum("cluster_points").alias("total_points"), F.count(F.lit(1)).alias("num_clusters"))
    return members.join(size, [*run, "cluster"]).join(total, run)


def candidate_logs(members: DataFrame, logs: DataFrame, n: int, seed: str, keys: Sequence[str] = ("log_type", "window_key", "id")) -> DataFrame:
    """Log text of up to ``n`` members of each cluster in the window where it is new."""
    picked = sample_per_group(new_clusters(members, ["log_type"]), ["log_type", "cluster"], n, seed, "id")
    return picked.join(logs, list(keys))
