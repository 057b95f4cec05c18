"""Neighbour search, seeds and projections against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.operators import vectors as V
from traceloom.operators import clusters as K
from traceloom.session import cut


def frame(spark, m, first=0):
    return spark.createDataFrame([(i + first, [float(x) for x in r]) for i, r in enumerate(m)], "id long, v array<double>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8)) * 4
    train = centre[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8))
    train[:100] = train[0]  # a group of copies holds a third of the rows
    return train, centre[rng.integers(0, 6, 80)] + rng.normal(size=(80, 8))


def test_nearest_many_cells(spark, data):
    train, q = data
    got = V.nearest(frame(spark, q), frame(spark, train), 5, block_rows=20, query_rows=7).toPandas()
    d = np.sqrt(((q[:, None] - train[None]) ** 2).sum(-1))
    for i in range(len(q)):
        mine = got[got.qid == i].sort_values(["distance", "tid"])
        best = np.lexsort((np.arange(len(train)), d[i]))[:5]
        assert list(mine.tid) == list(best)
        assert np.allclose(mine.distance, d[i][best])


def test_knn_scores(spark, data):
    train, q = data
    got = V.knn_scores(frame(spark, train), frame(spark, q), k=4).toPandas().sort_values("id")
    m, s = train.mean(0), train.std(0)
    a, b = (train - m) / (s + 1e-6), (q - m) / (s + 1e-6)

    def mean_near(x):
        return np.sort(np.sqrt(((x[:, None] - a[None]) ** 2).sum(-1)), axis=1)[:, :4].mean(1)

    assert np.allclose(got.score, mean_near(b) / mean_near(a).mean(), rtol=1e-6)


def test_most_similar_counts_copies(spark, data):
    train, q = data
    got = V.most_similar(frame(spark, q), frame(spark, train)).toPandas().sort_values("qid")
    u = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u(q) @ u(train).T
    for i, r in enumerate(got.itertuples()):
        tied = np.flatnonzero(np.isclose(sim[i], sim[i].max(), rtol=1e-9))
        assert (r.tid, r.n_candidates) == (tied[0], len(tied))


@pytest.mark.parametrize("limit", [100_000, 50])
def test_farthest_seeds(spark, data, limit):
    train, _ = data
    d = frame(spark, train).withColumn("w", F.when(F.col("id") < 260, "big").otherwise("small"))
    got = V.farthest_seeds(d, ["w"], 6, max_group_rows=limit).toPandas()
    for w, ids in (("big", np.arange(260)), ("small", np.arange(260, 300))):
        v = train[ids] / (np.linalg.norm(train[ids], axis=1, keepdims=True) + 1e-12)
        picked = [0]
        best = 1 - v @ v[0]
        while len(picked) < 6:
            best[picked] = -1
            picked.append(int(best.argmax()))
            best = np.minimum(best, 1 - v @ v[picked[-1]])
        assert list(got[got.w == w].sort_values("seed_no").id) == list(ids[picked])


def test_pca(spark, data):
    train, q = data
    out, var = V.pca_project(frame(spark, train), frame(spark, q), 3)
    got = np.array([r[0] for r in out.orderBy("id").select("v").collect()])
    c = train - train.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    w = vt[:3].T
    w = w * np.sign(w[np.abs(w).argmax(0), np.arange(3)])
    assert np.allclose(np.abs(got), np.abs((q - train.mean(0)) @ w), atol=1e-6)
    assert 0 < sum(var) <= 1 + 1e-9


def test_clusters_persist(spark):
    rows = [(i, "audit", f"w{i // 4}", [1.0, 0.01 * i] if i % 2 else [0.01 * i, 1.0]) for i in range(12)]
    d = spark.createDataFrame(rows, "id long, log_type string, window_key string, v array<double>")
    a = K.continual_clusters(d).toPandas().sort_values("id")
    b = K.continual_clusters(d, chunk_rows=3).toPandas().sort_values("id")
    assert list(a.cluster) == list(b.cluster)
    assert a.groupby(a.id % 2).cluster.nunique().tolist() == [1, 1] and a.cluster.nunique() == 2


def test_small_windows_share_a_chunk(spark, monkeypatch):
    """Many windows take few steps, and fading counts windows, not steps; checked against the windows one by one."""
    rows = [(i, "ab"[i % 2], f"w{i // 4:02d}", [float(np.cos(i * 0.37)), float(np.sin(i * 0.37))]) for i in range(96)]
    d = spark.createDataFrame(rows, "id long, log_type string, window_key string, v array<double>")
    written = []
    monkeypatch.setattr(K, "cut", lambda df: written.append(1) or cut(df))
    got = {r.id: r.cluster for r in K.continual_clusters(d, threshold=0.5, fading=0.2).collect()}
    assert len(written) <= 3
    want = {}
    for kind in "ab":
        vecs, weight = [], []
        for w in range(24):
            weight = [x * 2.0 ** -0.2 for x in weight]
            for i, _, _, v in [r for r in rows if r[1] == kind and r[2] == f"w{w:02d}"]:
                v = np.array(v)
                far = [np.linalg.norm(c - v) for c in vecs]
                k = int(np.argmin(far)) if vecs else -1
                if vecs and far[k] <= 0.5:
                    vecs[k], weight[k] = (vecs[k] * weight[k] + v) / (weight[k] + 1), weight[k] + 1
                else:
                    k = len(vecs)
                    vecs.append(v)
                    weight.append(1.0)
                want[i] = k
    assert got == want


def test_blocks_grow_with_the_tables(spark, monkeypatch):
    """A query is written for some 32 blocks at most, however small the blocks may be."""
    m = np.random.default_rng(6).normal(size=(2000, 6))
    written = []
    monkeypatch.setattr(V, "cut", lambda df: written.append(cut(df)) or written[-1])
    got = V.nearest(frame(spark, m[:100]), frame(spark, m), 3, block_rows=4, query_rows=2).toPandas()
    assert written[1].count() <= 100 * 70
    for i in (0, 57):
        d = np.sqrt(((m - m[i]) ** 2).sum(1))
        assert list(got[got.qid == i].sort_values(["distance", "tid"]).tid) == list(np.lexsort((np.arange(len(m)), d))[:3])
