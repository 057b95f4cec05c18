"""Hard negatives by a multiway hyperplane tree with distance ranges (in the manner of GNAT).

A node has up to ``fanout`` split points; a vector goes to the nearest one, so the bisecting hyperplanes of the points part the
node. Every split point keeps, for the subtree of every sibling, the smallest and the largest distance to a vector in it. A window
of inner products with an anchor is an annulus of distances around it, because the squared distance is the sum of both squared
lengths less twice the product. Where the distances that the annulus allows to a split point do not meet the range stored for a
sibling, the sibling's subtree is left out. What remains are leaves, which are compared exactly.

The split points are fitted on a bounded sample; all vectors are routed, and the ranges are minima and maxima over all of them.
Neighbouring leaves are put into bundles of a bounded number of vectors, so a leaf of copies is many bundles. An anchor is written
once for every bundle with a leaf that is open to it, and vectors are dealt by bundle once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import by_text, cut
from traceloom.operators.common import top_rows
from traceloom.session import bucketed, keep, scratch

LIMIT = 1 << 26  # components from here on (after scaling) are not searchable
LOWEST, HIGHEST = -(1 << 62), 1 << 62  # beyond every score
BUNDLE = 8 << 20  # bytes of vectors that a task holds at once


def whole_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str, anchors: Column) -> DataFrame:
    """Usable rows as (row, id, label, anchor, v, top): v the bytes of floor(scale * component) as 32-bit integers, top the largest
    of their amounts, row a number of its own that ascends with the id, nulls last."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        at, out, top = [], [], []
        for i, v in enumerate(b.column(3).to_pylist()):
            if None in v:
                continue
            x = np.floor(np.array(v, np.float64) * scale)
            if (np.abs(x) < LIMIT).all():  # false for what is not finite
                at.append(i)
                out.append(x.astype("<i4").tobytes())
                top.append(int(np.abs(x).max(initial=0)))
        take = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*[b.column(i).take(take) for i in range(3)], pa.array(out, pa.binary()), pa.array(top, pa.int64())],
                                          ["id", "label", "anchor", "v", "top"])

    base = rows.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).alias("v"))
    kind = dict(base.dtypes)["id"]
    whole = by_text(base, run, f"id {kind}, label string, anchor boolean, v binary, top bigint")
    # the hash spreads rows of one id over the parts of the sort
    return cut(whole.orderBy(F.asc_nulls_last("id"), F.xxhash64("v")).withColumn("row", F.monotonically_increasing_id()))


def _matrix(column: Iterable[bytes], dim: int, exact: bool) -> np.ndarray:
    """Vectors as rows of one length; what a shorter vector lacks is zero. Doubles where all sums are exact in them."""
    column = [bytes(c) for c in column]
    out = np.zeros((len(column), dim), np.float64 if exact else np.int64)
    if column and all(len(c) == 4 * dim for c in column):
        out[:] = np.frombuffer(b"".join(column), "<i4").reshape(-1, dim)
    else:
        for i, c in enumerate(column):
            out[i, :len(c) // 4] = np.frombuffer(c, "<i4")
    return out


@dataclass
class Tree:
    """Split points of every node, its children (a node, or ~leaf), and what was measured over all vectors."""
    dim: int
    exact: bool
    points: list[np.ndarray] = field(default_factory=list)
    children: list[np.ndarray] = field(default_factory=list)
    near: list[np.ndarray] = field(default_factory=list)  # near[node][i, j]: smallest distance from point i to the subtree of j
    far: list[np.ndarray] = field(default_factory=list)
    short: list[np.ndarray] = field(default_factory=list)  # smallest squared length in the subtree of j
    long: list[np.ndarray] = field(default_factory=list)
    leaves: int = 0

    def distances(self, x: np.ndarray, node: int) -> np.ndarray:
        p = self.points[node]
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T), 0).astype(np.float64))

    @classmethod
    def fit(cls, sample: np.ndarray, exact: bool, rows: int, leaf_rows: int, fanout: int) -> Tree:
        """Parts the sample until a leaf stands for at most ``leaf_rows`` of ``rows``, or its sample is too small to part."""
        tree = cls(sample.shape[1], exact)
        share = rows / max(len(sample), 1)

        def grow(own: np.ndarray) -> int:
            distinct = np.unique(own, axis=0) if len(own) else own
            if len(own) * share <= leaf_rows or len(distinct) < 2 * fanout:
                tree.leaves += 1
                return ~(tree.leaves - 1)
            node = len(tree.points)
            # farthest-first among three times as many candidates as points
            some = distinct[np.linspace(0, len(distinct) - 1, min(len(distinct), 3 * fanout)).astype(int)]
            chosen, gap = [0], np.full(len(some), np.inf)
            while len(chosen) < fanout:
                gap = np.minimum(gap, ((some - some[chosen[-1]]) ** 2).sum(1).astype(np.float64))
                chosen.append(int(np.argmax(gap)))
            tree.points.append(some[np.unique(chosen)])
            tree.children.append(np.zeros(0, np.int64))
            to = tree.distances(own, node).argmin(1)
            if np.bincount(to).max() == len(own):  # nothing was parted
                tree.points.pop(), tree.children.pop()
                tree.leaves += 1
                return ~(tree.leaves - 1)
            tree.children[node] = np.array([grow(own[to == j]) for j in range(len(tree.points[node]))])
            return node

        grow(sample)
        for p in tree.points:
            k = len(p)
            tree.near.append(np.full((k, k), np.inf)), tree.far.append(np.full((k, k), -np.inf))
            tree.short.append(np.full(k, np.inf)), tree.long.append(np.full(k, -np.inf))
        return tree

    def route(self, x: np.ndarray, measured: dict | None = None) -> np.ndarray:
        """The leaf of each vector; ``measured`` gathers the ranges of what passes, per (node, child)."""
        leaf, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))] if self.points and len(x) else []
        while todo:
            node, at = todo.pop()
            d = self.distances(x[at], node)
            to = d.argmin(1)
            length = (x[at] * x[at]).sum(1).astype(np.float64)
            for j in np.unique(to):
                own = to == j
                if measured is not None:
                    new = (d[own].min(0), d[own].max(0), length[own].min(), length[own].max())
                    old = measured.get((node, j))
                    measured[node, j] = new if old is None else (np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), min(old[2], new[2]), max(old[3], new[3]))
                child = self.children[node][j]
                if child < 0:
                    leaf[at[own]] = ~child
                else:
                    todo.append((child, at[own]))
        return leaf

    def open_leaves(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, leaf) pairs that may hold a vector whose product with anchor i is in a window [low[i, w], high[i, w]]."""
        if not self.points:
            return (at := np.flatnonzero((low <= high).any(1))), np.zeros(len(at), np.int64)
        length, found, todo = (x * x).sum(1).astype(np.float64), [], [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            d = self.distances(x[at], node)
            # squared radii of the annulus for each anchor, child and window; rounding may only widen it
            base, lo, hi = length[at][:, None, None], 2.0 * low[at][:, None, :], 2.0 * high[at][:, None, :]
            inner, outer = base + self.short[node][:, None] - hi, base + self.long[node][:, None] - lo
            inner, outer = inner - 1e-9 * (base + np.abs(hi) + 1), outer + 1e-9 * (base + np.abs(lo) + 1)
            alive = (outer >= 0) & (lo <= hi)
            r1, r2 = np.sqrt(np.maximum(inner, 0)), np.sqrt(np.maximum(outer, 0))
            for i in range(d.shape[1]):  # by every split point
                di = d[:, i][:, None, None]
                alive &= (self.far[node][i][:, None] * (1 + 1e-9) >= np.maximum(di - r2, r1 - di)) & (self.near[node][i][:, None] * (1 - 1e-9) <= di + r2)
            for j, child in enumerate(self.children[node]):
                go = at[alive[:, j].any(1)]
                if len(go) and child < 0:
                    found.append((go, np.full(len(go), ~child)))
                elif len(go):
                    todo.append((child, go))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = zip(*found, strict=True)
        return np.concatenate(a), np.concatenate(b)


class Index:
    """Every vector in a leaf of the tree and a bundle of leaves, and the tree with the ranges of all vectors."""

    def __init__(self, vectors: DataFrame, sample_rows: int = 16_384, leaf_rows: int = 512, fanout: int = 16, block: int = 1024):
        facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("v")).alias("d"), F.max("top").alias("top")).first()
        dim, largest = (facts["d"] or 0) // 4, facts["top"] or 0
        exact = dim * largest ** 2 < 1 << 51
        if dim * largest ** 2 >= 1 << 54:
            raise ValueError("inner products of these vectors do not fit 64 bits")
        self.kind, self.vectors = dict(vectors.dtypes)["id"], vectors
        # at most sample_rows rows, drawn by hash
        drawn = [bytes(r["v"]) for r in low_hashes(vectors, facts["n"], sample_rows).orderBy("h").limit(sample_rows).select("v").collect()]
        self.tree = Tree.fit(_matrix(drawn, dim, exact), exact, facts["n"], leaf_rows, fanout)
        placed = self._placed()
        self._measure(placed)
        self._bundle(placed, facts["n"], dim, block)

    def _placed(self) -> DataFrame:
        """Vectors with their leaf, and beside them one row of ranges for each (node, child) that a task has met."""
        tree, kind = self.tree, self.kind

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            measured: dict = {}
            for b in batches:
                leaf = tree.route(_matrix(b.column(4).to_pylist(), tree.dim, tree.exact), measured)
                none = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 2)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32)), *none], names)
                held = b.schema
            if measured:
                keys, values = zip(*measured.items(), strict=True)
                n = len(keys)
                ranges = [pa.array([[*v[c], v[c + 2]] for v in values], pa.list_(pa.float64())) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(n, f.type) for f in held], pa.nulls(n, pa.int32()), pa.array([k[0] for k in keys], pa.int32()),
                                                  pa.array([k[1] for k in keys], pa.int32()), *ranges], names)
        names = ["row", "id", "label", "anchor", "v", "leaf", "node", "child", "low", "high"]
        schema = (f"row bigint, id {kind}, label string, anchor boolean, v binary, leaf int, node int, child int, "
                  "low array<double>, high array<double>")
        return cut(self.vectors.select(*names[:5]).mapInArrow(run, schema))

    def _measure(self, placed: DataFrame) -> None:
        """Minima and maxima over all tasks; as many rows as the tree has pairs of a point and a subtree."""
        rows = placed.filter("node is not null").select("node", "child", F.posexplode(F.arrays_zip("low", "high")).alias("i", "r"))
        for r in rows.groupBy("node", "child", "i").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high")).toLocalIterator():
            node, child, i = r["node"], r["child"], r["i"]
            if i < len(self.tree.points[node]):
                self.tree.near[node][i, child], self.tree.far[node][i, child] = r["low"], r["high"]
            else:
                self.tree.short[node][child], self.tree.long[node][child] = r["low"], r["high"]

    def _bundle(self, placed: DataFrame, n: int, dim: int, block: int) -> None:
        """Deal the vectors by bundle: neighbouring leaves of about ``block`` rows at least, and a larger leaf as many bundles as it needs.

        A probe is written once for every bundle, so bundles grow with the table, to as many rows as fill ``BUNDLE``.
        """
        spark = placed.sparkSession
        rows = placed.filter("node is null")
        most = max(block, min(BUNDLE // (4 * max(dim, 1)), -(-n // (4 * spark.sparkContext.defaultParallelism))))
        self.first, self.parts = np.zeros(self.tree.leaves, np.int64), np.ones(self.tree.leaves, np.int64)
        full, own = 0, 0  # bundles that are closed, rows in the open one
        for leaf, size in sorted(map(tuple, rows.groupBy("leaf").count().collect())):  # as many rows as the tree has leaves
            if own and own + size > most:
                full, own = full + 1, 0
            self.first[leaf] = full
            if size > most:
                self.parts[leaf] = -(-size // most)
                full += int(self.parts[leaf])
            else:
                own += size
        self.bundles = full + (own > 0)
        at = spark.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(self.first, self.parts, strict=True))], "leaf int, first int, parts int")
        dealt = rows.join(at, "leaf").withColumn("bundle", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int"))
        buckets = max(1, min(self.bundles, 10_000))
        self.blocks = bucketed(dealt.select("bundle", "leaf", "row", "label", "v").repartition(buckets, "bundle"), "bundle", buckets)
        own = F.explode(F.expr("sequence(first, first + parts - 1)"))
        self.homes = rows.filter("anchor").select("row", "label", "v", "leaf")
        self.at_home = self.homes.join(at, "leaf").select("row", "label", "v", own.alias("bundle"), F.array("leaf").alias("leaves"))

    def best(self, probes: DataFrame, same: bool, n: int) -> DataFrame:
        """The first ``n`` rows by (score descending, row) of every window of every probe, in the leaves named.

        ``probes``: row, label, v, low, high (arrays of bigint, one entry for each window), bundle, leaves (those open in the bundle).
        ``same``: rows of the probe's label other than itself, else rows of other labels. Returns probe, window, score, row.
        """
        tree = self.tree
        names = ["probe", "window", "score", "row"]

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64),) * 4]
            if a.num_rows and b.num_rows:
                x, y = (_matrix(t.column("v").to_pylist(), tree.dim, tree.exact) for t in (a, b))
                code = np.unique(a.column("label").to_pylist() + b.column("label").to_pylist(), return_inverse=True)[1]
                number, row, leaf = a.column("row").to_numpy(), b.column("row").to_numpy(), b.column("leaf").to_numpy()
                low, high, leaves = (a.column(c).to_pylist() for c in ("low", "high", "leaves"))
                most = max(map(len, low))
                low, high = (np.array([[*w, *[none] * (most - len(w))] for w in side], np.int64).reshape(len(side), most) for side, none in ((low, HIGHEST), (high, LOWEST)))
                together = sorted(range(len(x)), key=lambda i: leaves[i])
                for at in range(0, len(x), 128):
                    p = np.array(together[at:at + 128])
                    cols = np.flatnonzero(np.isin(leaf, np.unique(np.concatenate([leaves[i] for i in p]))))
                    score = x[p] @ y[cols].T
                    fits = (code[p][:, None] == code[len(x):][cols]) == same
                    if same:
                        fits &= number[p][:, None] != row[cols]
                    for w in range(most):
                        ok = fits & (score >= low[p, w][:, None]) & (score <= high[p, w][:, None])
                        i, j = first_scores(score, ok, row[cols], n)
                        out.append((number[p[i]], np.full(len(i), w), score[i, j].astype(np.int64), row[cols[j]]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            return pa.table([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int32, np.int64, np.int64), strict=True)], names)

        vectors = self.blocks.groupBy("bundle")
        found = probes.select("bundle", "row", "label", "v", "low", "high", "leaves").groupBy("bundle").cogroup(vectors).applyInArrow(
            run, "probe bigint, window int, score bigint, row bigint")
        return top_rows(found, ["probe", "window"], [F.desc("score"), F.col("row")], n)

    def reach(self, probes: DataFrame) -> DataFrame:
        """Probes (row, label, v, low, high) repeated for every bundle with leaves that the ranges leave open for one of their windows."""
        tree, first, parts, bundles = self.tree, self.first, self.parts, max(self.bundles, 1)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            low, high = b.column(3).to_pylist(), b.column(4).to_pylist()
            most = max(map(len, low), default=0)
            lo, hi = (np.array([[*w, *[none] * (most - len(w))] for w in side], np.float64).reshape(len(side), most)
                      for side, none in ((low, HIGHEST), (high, LOWEST)))
            x = _matrix(b.column(2).to_pylist(), tree.dim, tree.exact)
            keys, sizes, leaves = [], [], []
            for i in range(0, len(x), 256):
                at, leaf = tree.open_leaves(x[i:i + 256], lo[i:i + 256], hi[i:i + 256])
                times = parts[leaf]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                key = np.repeat((at + i) * bundles + first[leaf], times) + part
                order = np.argsort(key, kind="stable")
                key, size = np.unique(key[order], return_counts=True)
                keys.append(key)
                sizes.append(size)
                leaves.append(np.repeat(leaf, times)[order])
            keys, ends = np.concatenate(keys), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            take = pa.array(keys // bundles)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(leaves).astype(np.int32)))
            return pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns], pa.array((keys % bundles).astype(np.int32)), lists], [*b.schema.names, "bundle", "leaves"])
        return by_text(probes.select("row", "label", "v", "low", "high"), run,
                       "row bigint, label string, v binary, low array<bigint>, high array<bigint>, bundle int, leaves array<int>")


def low_hashes(vectors: DataFrame, n: int, most: int) -> DataFrame:
    """Vectors (v, h) of ``n`` whose hash h is among the lowest: ``most`` of them and a margin.

    Of an ordered ``limit`` alone the driver gets as many rows as the limit from every split.
    """
    hashed = vectors.select("v", F.pmod(F.xxhash64("v", "row"), F.lit(1 << 40)).alias("h"))
    return hashed.filter(F.col("h") < int((most + 8 * most ** .5) / n * (1 << 40))) if n > most else hashed


def first_scores(score: np.ndarray, ok: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the first ``n`` scores of every line by (score descending, row) among those that are ``ok``."""
    if ok.shape[1] > n and ok.sum() > 8 * n * len(ok):
        least = -np.inf if score.dtype.kind == "f" else np.iinfo(score.dtype).min
        ok = ok & (score >= np.partition(np.where(ok, score, least), -n, axis=1)[:, -n][:, None])  # all that tie with the last one stay
    i, j = np.nonzero(ok)
    order = np.lexsort((row[j], -score[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < n], j[place < n]


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **tree: int) -> DataFrame:
    """For each anchor and each of its positives the first negatives whose score is near below the positive's.

    A component x counts as floor(scale * x), a score is the inner product; higher scores stand first, ties by smaller id (a null id
    last, then by row). Positives: the anchor's first other rows of its label. Negatives of a positive: the first rows of another
    label with low * positive_score <= 100 * score <= high * positive_score. All are found: a subtree is left out only where its
    stored ranges prove that it holds none. Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null label, a null vector, or a component that is null, not finite or 2**26 or more after scaling take no part.
    Vectors of unequal length are compared as if the shorter one ended in zeros; an empty vector is zero. Repeated ids and repeated
    rows are rows of their own, so an anchor's copy may be its positive. A null anchor condition is no anchor. Fewer positives or
    negatives give fewer rows, none of them a null row. Other columns are not read; an empty table gives no rows.
    """
    with scratch(rows.sparkSession):
        vectors = whole_vectors(rows, scale, id_col, vector_col, label_col, anchors)
        index = Index(vectors, **tree)
        least, most = F.lit(LOWEST), F.array(F.lit(HIGHEST))
        # the last positive found at home bounds the first search
        home = index.best(index.at_home.select("*", F.array(least).alias("low"), most.alias("high")), True, positives)
        bound = cut(home.groupBy("probe").agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == positives))
        probes = index.homes.join(bound.select(F.col("probe").alias("row"), "bound"), "row", "left").select(
            "row", "label", "v", F.array(F.coalesce("bound", least)).alias("low"), most.alias("high"))
        first = cut(index.best(index.reach(probes), True, positives))
        # one window for each positive; a negative score leaves none open unless the bounds are equal or crossed
        pair = F.struct(F.col("score").alias("s"), F.col("row").alias("r"))
        wanted = first.groupBy("probe").agg(F.array_sort(F.collect_list(pair)).alias("positives"))
        # whole numbers: the next above low * s / 100 and the next below high * s / 100
        up = F.expr(f"transform(positives, p -> (p.s * {low}) div 100 + if((p.s * {low}) % 100 > 0, 1, 0))")
        down = F.expr(f"transform(positives, p -> (p.s * {high}) div 100 - if((p.s * {high}) % 100 < 0, 1, 0))")
        wanted = cut(wanted.join(index.homes.select(F.col("row").alias("probe"), "label", "v"), "probe").select(
            F.col("probe").alias("row"), "label", "v", "positives", up.alias("low"), down.alias("high")))
        found = index.best(index.reach(wanted), False, negatives)
        rank = F.row_number().over(Window.partitionBy("probe", "window").orderBy(F.desc("score"), "row")).cast("int")
        positive = F.col("positives")[F.col("window")]
        named = cut(found.withColumn("rank", rank).join(wanted.select(F.col("row").alias("probe"), "positives"), "probe").select(
            "probe", positive["r"].alias("positive"), "rank", "row", positive["s"].cast("long").alias("positive_score"), F.col("score").alias("negative_score")))
        for at, name in (("probe", "anchor_id"), ("positive", "positive_id"), ("row", "negative_id")):
            named = named.join(vectors.select(F.col("row").alias(at), F.col("id").alias(name)), at)
        return keep(named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
