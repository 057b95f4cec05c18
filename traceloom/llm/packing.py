"""Packing documents into sequences of a fixed number of tokens by a grouping genetic algorithm.

Documents are dealt by hash into groups of a bounded size. Each group is solved by several islands,
one task row each; between rounds every island sends its best packing to the next one. Bins that stay
short of full are dissolved, and their documents are packed again in fewer groups, down to one. The fuller half of a
level stays whatever its fill is, so that every level has at most half the documents of the one before.
"""

from __future__ import annotations

import random
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.bpe import held
from traceloom.llm.common import by_text, chunks, cut
from traceloom.session import keep, scratch

_KNOWN: dict[tuple, dict[bytes, list[tuple]]] = {}


def cut_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Tokenised length of every document with an end id, cut into pieces where it exceeds ``capacity``.

    Rows (id, piece, start, length, ids_crc32). The ids are those of the
    tokenizers library, from the encoder of this package, which the tests hold against it. Only their digest leaves the worker. Null texts are empty and
    yield the end id alone. A worker encodes equal texts once: it remembers the pieces of up to some 200,000 texts by a 128-bit digest.
    """
    def pieces(ids: np.ndarray) -> list[tuple]:
        ids = np.append(ids, np.uint32(end_id)).astype("<u4")
        parts = [(first, ids[first:first + capacity]) for first in range(0, len(ids), capacity)]
        return [(piece, first, len(part), zlib.crc32(part.tobytes())) for piece, (first, part) in enumerate(parts)]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        known = _KNOWN.setdefault((path, capacity, end_id), {})
        if len(known) > 200_000:
            known.clear()
        texts = [t or "" for t in b.column(1).to_pylist()]
        keys = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
        fresh = [(k, t) for k, t in dict(zip(keys, texts, strict=True)).items() if k not in known]
        for lo, hi in chunks([t for _, t in fresh], 4 << 20):
            for (k, _), (ids, _) in zip(fresh[lo:hi], held(path).encode([t for _, t in fresh[lo:hi]]), strict=True):
                known[k] = pieces(ids)
        rows = [(at, *p) for at, k in enumerate(keys) for p in known[k]]
        row, piece, start, length, crc = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([b.column(0).take(row), piece, start, length, crc], [id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return by_text(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint")


class Bins:
    """A packing under construction with best-fit search by free space."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.open: dict[int, list[int]] = {}
        self.mask = 0  # bit f is set when an open bin has f tokens free

    def add(self, items: list[int]) -> None:
        """Take a whole bin."""
        self.bins.append(list(items))
        self.free.append(self.capacity - sum(self.lengths[i] for i in items))
        self._offer(len(self.bins) - 1)

    def _offer(self, b: int) -> None:
        f = self.free[b]
        if f:
            self.open.setdefault(f, []).append(b)
            self.mask |= 1 << f

    def best_fit(self, items: Iterable[int]) -> None:
        for i in items:
            n = self.lengths[i]
            fit = self.mask >> n
            if not fit:
                self.add([i])
                continue
            f = n + (fit & -fit).bit_length() - 1
            b = self.open[f].pop()
            if not self.open[f]:
                self.mask ^= 1 << f
            self.bins[b].append(i)
            self.free[b] = f - n
            self._offer(b)


def quality(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple:
    """Fewer bins first, then fuller bins: smaller is better."""
    return len(bins), -sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(mother: list[list[int]], father: list[list[int]], lengths: list[int], capacity: int, rnd: random.Random) -> list[list[int]]:
    """Whole well-filled bins of the father enter the mother's packing.

    The mother's bins that share a document with them go, and so do a few of her worst;
    documents left over are put back by best fit, longest first.
    """
    fill = [sum(lengths[i] for i in b) for b in father]
    ranked = sorted(range(len(father)), key=lambda b: (-fill[b], rnd.random()))
    chosen = rnd.sample(ranked[:max(1, len(ranked) * 2 // 3)], max(1, len(ranked) // 3))
    child = Bins(lengths, capacity)
    inside: set[int] = set()
    for b in chosen:
        child.add(father[b])
        inside.update(father[b])
    rest = []
    worst = set(sorted(range(len(mother)), key=lambda b: sum(lengths[i] for i in mother[b]))[:2])
    for k, b in enumerate(mother):
        if k in worst or not inside.isdisjoint(b):
            rest += [i for i in b if i not in inside]
        else:
            child.add(b)
    rest.sort(key=lambda i: (-lengths[i], rnd.random()))
    child.best_fit(rest)
    return child.bins


def evolve(lengths: list[int], capacity: int, population: list[list[list[int]]], seed: int, size: int, children: int) -> list[list[list[int]]]:
    """One island's round: steady-state replacement of its worst packing, best first in the result."""
    rnd = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    while len(population) < size:
        b = Bins(lengths, capacity)
        # the first is best-fit decreasing, others start from orders with noise
        b.best_fit(order if not population else sorted(order, key=lambda i: -lengths[i] * rnd.uniform(0.7, 1.0)))
        population = [*population, b.bins]
        if len(b.bins) == least:
            break
    ranked = sorted(((quality(p, lengths, capacity), k, p) for k, p in enumerate(population)))
    for k in range(children):
        if ranked[0][0][0] <= least:
            break
        (_, _, mother), (_, _, father) = rnd.sample(ranked, 2) if len(ranked) > 1 else (ranked[0], ranked[0])
        child = crossover(mother, father, lengths, capacity, rnd)
        ranked = sorted([*ranked, (quality(child, lengths, capacity), len(population) + k, child)])[:size]
    return [p for _, _, p in ranked]


def _labels(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(labels) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(labels):
        out.setdefault(int(k), []).append(i)
    return list(out.values())


def _round(state: DataFrame, capacity: int, number: int, size: int, children: int) -> DataFrame:
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = []
            for r in f.itertuples(index=False):
                lengths = [int(x) for x in r.lengths]
                population = [_bins(p) for p in r.population]
                best = evolve(lengths, capacity, population, hash((r.group, r.island, number)), size, children)
                q = quality(best[0], lengths, capacity)
                done.append((r.group, r.island, r.items, r.lengths, [_labels(p, len(lengths)) for p in best], q[0], q[1]))
            yield pd.DataFrame(done, columns=["group", "island", "items", "lengths", "population", "n_bins", "slack"])
    return state.mapInPandas(run, "group bigint, island int, items array<bigint>, lengths array<bigint>, "
                                  "population array<array<int>>, n_bins bigint, slack double")


def pack_groups(items: DataFrame, groups: int, capacity: int, islands: int, rounds: int, size: int, children: int, level: int) -> DataFrame:
    """One level: rows (item, group, bin, offset, fill), the best packing that the islands of each group found."""
    dealt = items.groupBy(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)).alias("group")).agg(
        F.sort_array(F.collect_list(F.struct("item", "length"))).alias("l"))
    none = F.array().cast("array<array<int>>")
    state = dealt.select("group", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("l.item").alias("items"),
                         F.col("l.length").alias("lengths"), none.alias("population"))
    for k in range(rounds):
        state = cut(_round(state.repartition(F.col("group"), F.col("island")), capacity, k, size, children))
        if k + 1 < rounds:
            elite = state.select("group", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"),
                                 F.slice("population", 1, 1).alias("guest"))
            state = state.join(elite, ["group", "island"]).select(
                "group", "island", "items", "lengths", F.concat("population", "guest").alias("population"))
    best = state.groupBy("group").agg(F.min_by(F.struct("items", "lengths", F.col("population")[0].alias("bins")),
                                               F.struct("n_bins", "slack", "island")).alias("s")).select("group", "s.*")

    def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                d = pd.DataFrame({"item": r.items, "bin": r.bins, "length": r.lengths})
                d["offset"] = d.groupby("bin")["length"].cumsum() - d["length"]
                d["fill"] = d.groupby("bin")["length"].transform("sum")
                yield d.assign(group=r.group)[["item", "group", "bin", "offset", "fill"]]
    return cut(best.mapInPandas(place, "item bigint, group bigint, bin bigint, offset bigint, fill bigint"))


def pack(pieces: DataFrame, capacity: int = 2048, group_items: int = 2000, islands: int = 2, rounds: int = 2, size: int = 4,
         children: int = 6, full: float = 0.99) -> DataFrame:
    """Give every row (length, ...) a ``sequence_id`` and an ``offset``; other columns are kept, whatever their names but those two.

    0 < length <= capacity must hold. Pieces as long as a sequence stand alone. Groups hold about
    ``group_items`` documents whatever the input, so a task's memory is bounded; bins filled below ``full``, or below the median
    fill of the level's pieces where that is less, are packed again in the next level, until one group is left. An empty table gives an empty table. Rows are numbered as they are written once.
    """
    names = pieces.columns
    flat = [c if c == "length" else f"c{i}" for i, c in enumerate(names)]
    with scratch(pieces.sparkSession):
        pieces = keep(pieces.toDF(*flat).withColumn("item", F.monotonically_increasing_id()))
        placed = keep(_placed(pieces, capacity, group_items, islands, rounds, size, children, full))
    return pieces.join(placed, "item").select(*flat, "sequence_id", "offset").toDF(*names, "sequence_id", "offset")


def _placed(pieces: DataFrame, capacity: int, group_items: int, islands: int, rounds: int, size: int, children: int, full: float) -> DataFrame:
    """(item, sequence_id, offset) of written rows (item, length)."""
    alone = pieces.filter(F.col("length") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed, todo, level = alone, pieces.filter(F.col("length") < capacity).select("item", "length"), 0
    while n := todo.count():
        groups = -(-n // group_items)
        got = pack_groups(todo, groups, capacity, islands, rounds, size, children, level)
        name = F.lit(level + 1).cast("long") * (1 << 58) + F.col("group") * (1 << 26) + F.col("bin")
        bound = min(int(full * capacity), got.agg(F.percentile_approx("fill", 0.5)).first()[0])
        keep = F.col("fill") >= bound if groups > 1 else F.lit(True)
        placed = placed.union(got.filter(keep).select("item", name.alias("sequence_id"), "offset"))
        if groups == 1:
            break
        todo = cut(got.filter(~keep).select("item").join(pieces.select("item", "length"), "item"))
        level += 1
    return placed


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Tokenise and pack whole documents: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null ids and repeated rows are packed like any other; other columns of ``docs`` are not read.
    """
    out = pack(cut_pieces(docs, path, capacity, 0, id_col, text_col), capacity, **how)
    return out.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
