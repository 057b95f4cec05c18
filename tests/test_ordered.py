"""Sliced scans on skewed keys, with more slices than keys, against pandas."""

import numpy as np
import pandas as pd
import pytest

from traceloom.operators import ordered as O


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 4000
    # one key holds most rows, some keys have one row
    key = np.where(rng.random(n) < 0.6, "hot", ["k%d" % i for i in rng.integers(0, 200, n)])
    return pd.DataFrame({"key": key, "seq": rng.permutation(n).astype("int64"), "x": rng.integers(0, 9, n).astype("int64"),
                         "ts": np.where(rng.random(n) < 0.9, np.nan, rng.integers(1, 100, n))})


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(k, int(s), int(x), None if np.isnan(t) else int(t)) for k, s, x, t in rows.itertuples(index=False)],
                                 "key string, seq long, x long, ts long")


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("desc", [False, True])
def test_running_sum(rows, frame, keys, desc):
    order = [("seq", "desc")] if desc else ["seq"]
    got = O.running_sum(O.slice_by(frame, keys, order, partitions=11), keys, order, s="x").toPandas()
    assert got["_slice"].nunique() > 5
    want = rows.sort_values("seq", ascending=not desc)
    want["s"] = want.groupby("key")["x"].cumsum() if keys else want["x"].cumsum()
    m = got.merge(want[["seq", "s"]], on="seq")
    assert len(m) == len(rows) and (m["s_x"] == m["s_y"]).all()


def test_row_index(rows, frame):
    got = O.row_index(frame, [], ["seq"], "i", partitions=9).toPandas().sort_values("seq")
    assert list(got["i"]) == list(range(len(rows)))


def test_lagged(rows, frame):
    got = O.lagged(O.slice_by(frame, ["key"], ["seq"], partitions=11), ["key"], ["seq"], p="x", q="ts").toPandas()
    want = rows.sort_values("seq")
    want["p"] = want.groupby("key")["x"].shift()
    want["q"] = want.groupby("key")["ts"].shift()
    m = got.merge(want[["seq", "p", "q"]], on="seq")
    for c in "pq":
        assert ((m[c + "_x"] == m[c + "_y"]) | (m[c + "_x"].isna() & m[c + "_y"].isna())).all()


def test_filled(rows, frame):
    got = O.filled(O.slice_by(frame, ["key"], ["seq"], partitions=11), ["key"], ["seq"], "ts", "f").toPandas()
    want = rows.sort_values("seq")
    want["f"] = want.groupby("key")["ts"].bfill()
    want["f"] = want["f"].fillna(want.groupby("key")["ts"].ffill())
    m = got.merge(want[["seq", "f"]], on="seq")
    assert ((m["f_x"] == m["f_y"]) | (m["f_x"].isna() & m["f_y"].isna())).all()


def test_runs_over_slices(spark):
    from traceloom.operators import time_windows as W
    from pyspark.sql import functions as F
    e = spark.range(3000).select(F.col("id").alias("n"), F.floor(F.col("id") / 700).cast("string").alias("src"), F.lit("d").alias("dst"),
                                 F.lit("a").alias("action"), F.lit("s").alias("sentence"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = W.collapse_runs(e, ["n"]).orderBy("run").toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert list(got["n"]) == [700, 700, 700, 700, 200]
    assert got["sentence"].iloc[0] == "s (x700)"
