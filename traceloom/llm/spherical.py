"""Near-duplicate embeddings: spherical k-means cells and exact blocked cosine products.

Cells are fitted per label by Lloyd rounds over all vectors. A vector stands in the cell of its nearest centre and visits
every other cell that may hold a neighbour: the bisecting plane of two centres must lie within the chord of the threshold,
which no link can cross otherwise. Cells are packed into blocks of a bounded size and blocks meet in an equi-join by cell, so
what travels are blocks, and what leaves a block pair are counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import by_text, components, cut


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one in double precision, and which rows of the column they are.

    Null, zero and non-finite vectors are left out; so are vectors with a null component.
    """
    kept, rows = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is None or not len(v) or any(x is None for x in v):
            continue
        x = np.array(v, np.float64)
        if not np.isfinite(x).all() or not (top := np.abs(x).max()):
            continue
        x = x / top
        kept.append(x / np.sqrt(x @ x))
        rows.append(i)
    return kept, np.array(rows, np.int64)


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, v): usable vectors of labelled rows, v the bytes of doubles."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        unit, rows = _unit(b.column(2))
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([len(u) for u in unit], pa.int32()),
                                           pa.array([u.tobytes() for u in unit], pa.binary())], ["id", "label", "dim", "v"])
    base = vectors.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    kinds = dict(base.dtypes)
    return by_text(base, run, f"id {kinds['id']}, label {kinds['label']}, dim int, v binary")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def centres(vectors: DataFrame, cell_rows: int, most: int, rounds: int, seed: int = 11) -> dict[tuple, np.ndarray]:
    """Centres per (label, dim) for the large ones, by spherical k-means over all their vectors.

    At most ``most`` centres in all, whatever the input (larger cells are then cut into more blocks); the first are vectors taken by
    hash. Sums of a round are aggregated in the workers, so a round returns at most one row for each centre and task.
    """
    counts = vectors.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows)
    counts = counts.orderBy(F.desc("n"), "label", "dim").limit(most // 2).collect()  # bounded rows
    total = sum(r["n"] for r in counts)
    wanted = {(r["label"], r["dim"]): max(2, min(-(-r["n"] // cell_rows), most * r["n"] // max(total, 1))) for r in counts}
    if not wanted:
        return {}
    # the first vectors by hash of each large label: a partial top-k for each label, at most ``most`` rows in all
    found: dict[tuple, np.ndarray] = {}
    for (label, dim), k in wanted.items():
        own = vectors.filter((F.col("label") == label) & (F.col("dim") == dim))
        rows = own.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).select("v").collect()
        found[label, dim] = np.unique(_matrix([bytes(r["v"]) for r in rows], dim), axis=0)
    for _ in range(rounds):
        def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = {k: (np.zeros_like(c), np.zeros(len(c), np.int64)) for k, c in found.items()}
            for b in batches:
                label, dim = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
                for key, c in found.items():
                    at = np.flatnonzero((label == key[0]) & (dim == key[1]))
                    if len(at):
                        x = _matrix(b.column(2).take(pa.array(at)).to_pylist(), key[1])
                        near = np.argmax(x @ c.T, axis=1)
                        np.add.at(acc[key][0], near, x)
                        acc[key][1][:] += np.bincount(near, minlength=len(c))
            out = [(i, j, int(n), s[j].tobytes()) for i, (s, m) in enumerate(acc.values()) for j, n in enumerate(m) if n]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                                             ["i", "j", "n", "s"])

        def added(t: pd.DataFrame) -> pd.DataFrame:
            s = np.sum([np.frombuffer(x, np.float64) for x in t["s"]], axis=0)
            return pd.DataFrame({"i": t["i"][:1], "j": t["j"][:1], "s": [s.tobytes()]})
        part = vectors.select("label", "dim", "v").mapInArrow(sums, "i int, j int, n bigint, s binary")
        got = part.groupBy("i", "j").applyInPandas(added, "i int, j int, s binary").collect()  # a row for each centre
        keys = list(found)
        new = {k: c.copy() for k, c in found.items()}
        for r in got:
            s = np.frombuffer(bytes(r["s"]), np.float64)
            if (norm := np.sqrt(s @ s)) > 0:
                new[keys[r["i"]]][r["j"]] = s / norm
        found = new
    return found


def visits(vectors: DataFrame, found: dict[tuple, np.ndarray], least: float) -> DataFrame:
    """(label, dim, cell, home, id, v): each vector at home and, before it in number, in the cells where a link may be."""
    chord = float(np.sqrt(max(2 - 2 * least, 0.0))) + 1e-9
    spans = {k: np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-18)) for k, c in found.items()}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        label, dim = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
        row, cell, home = [], [], []
        rest = np.ones(len(label), bool)
        for key, c in found.items():
            at = np.flatnonzero((label == key[0]) & (dim == key[1]))
            if not len(at):
                continue
            rest[at] = False
            near = _matrix(b.column(3).take(pa.array(at)).to_pylist(), key[1]) @ c.T
            own = np.argmax(near, axis=1)
            margin = (near[np.arange(len(at)), own][:, None] - near) / spans[key][own]
            open_ = (margin <= chord) & (np.arange(len(c)) < own[:, None])
            i, j = np.nonzero(open_)
            row += [at, at[i]]
            cell += [own, j]
            home += [np.ones(len(at), bool), np.zeros(len(i), bool)]
        row.append(np.flatnonzero(rest))
        cell.append(np.zeros(rest.sum(), np.int64))
        home.append(np.ones(rest.sum(), bool))
        take = pa.array(np.concatenate(row))
        cols = [b.column(i).take(take) for i in (1, 2)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(home)),
                                           b.column(0).take(take), b.column(3).take(take)], ["label", "dim", "cell", "home", "id", "v"])
    kinds = dict(vectors.dtypes)
    return by_text(vectors, run, f"label {kinds['label']}, dim int, cell int, home boolean, id {kinds['id']}, v binary")


def forest(hit: np.ndarray) -> np.ndarray:
    """Smallest row number (columns follow the rows) in the component of every row and column of a link matrix."""
    n, m = hit.shape
    rows, cols = np.arange(n), np.arange(n, n + m)
    big = n + m
    while True:
        new_r = np.minimum(rows, np.where(hit, cols, big).min(axis=1)) if m else rows
        new_c = np.minimum(cols, np.where(hit, new_r[:, None], big).min(axis=0)) if n else cols
        if (new_r == rows).all() and (new_c == cols).all():
            return np.concatenate([rows, cols])
        rows, cols = new_r, new_c


def near_duplicates(vectors: DataFrame, least: float = 0.93, cell_rows: int = 2048, most_cells: int = 1024, rounds: int = 4, block: int = 512,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per vector: id, n_links (others with equal label and cosine >= least), component_id (smallest id reachable), kept.

    All links are found: a vector skips a cell only where the bound proves that no link can be. Equal vectors of a label are one vertex
    with a weight. Rows with a null label or id, and vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing and are their own component; a null id is not kept. Vectors of different length are never compared. Repeated ids and rows
    are rows of their own: one row in, one row out. Other columns are not read.
    """
    base = cut(vectors.select(F.col(id_col).alias("own"), F.col(label_col).alias("label"), F.col(vector_col).alias("x")).withColumn(
        "row", F.monotonically_increasing_id()))
    unit = cut(unit_vectors(base.filter("own is not null"), "row", "x", "label"))
    # equal vectors: the row of the smallest number stands for all
    copies = cut(unit.groupBy("label", "dim", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    found = centres(copies.select("id", "label", "dim", "v"), cell_rows, most_cells, rounds)
    placed = cut(visits(copies.select("id", "label", "dim", "v"), found, least).join(copies.select("id", "weight"), "id"))
    cell = ["label", "dim", "cell"]
    size = cut(placed.groupBy(*cell, "home").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")))
    packed = cut(placed.join(size, [*cell, "home"]).groupBy(*cell, "home", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).agg(
        F.collect_list(F.struct("id", "weight", "v")).alias("rows")))
    left = packed.filter("home").select(*cell, F.col("part").alias("p"), F.col("rows").alias("a"))
    right = packed.select(*cell, "home", F.col("part").alias("q"), F.col("rows").alias("b"))
    pairs = left.join(right, cell).filter("not home or p <= q").select("dim", (F.col("home") & (F.col("p") == F.col("q"))).alias("same"), "a", "b")
    kind = dict(unit.dtypes)["id"]

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, b = r["a"], r["b"]
                x, y = _matrix([i["v"] for i in a], r["dim"]), _matrix([i["v"] for i in b], r["dim"])
                wa, wb = np.array([i["weight"] for i in a]), np.array([i["weight"] for i in b])
                hit = x @ y.T >= least
                if r["same"]:
                    np.fill_diagonal(hit, False)
                ids = [i["id"] for i in a] + [i["id"] for i in b]
                n = np.concatenate([hit @ wb, np.zeros(len(b), np.int64) if r["same"] else hit.T @ wa])
                root = forest(hit)
                at = np.flatnonzero((n > 0) | (root != np.arange(len(ids))))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], id_type), pa.array(n[at]), pa.array([ids[root[i]] for i in at], id_type)],
                                                     ["id", "n", "root"])
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    old = vectors.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # block pairs are large rows
    linked = cut(pairs.mapInArrow(products, f"id {kind}, n bigint, root {kind}"))
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    group = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("id").agg(F.sum("n").alias("n"))
    vertex = cut(copies.join(links, "id", "left").join(group, "id", "left").select(
        "label", "dim", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("component")))
    known = cut(unit.join(vertex, ["label", "dim", "v"]).select(F.col("id").alias("row"), "n", "component"))
    names = known.join(base.select("row", "own"), "row").groupBy("component").agg(F.min("own").alias("smallest"))
    known = known.join(names, "component").select("row", "n", "smallest")
    out = base.select("row", "own").join(known, "row", "left").select(
        F.col("own").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "own").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
