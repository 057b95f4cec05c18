"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

One permutation scatters the shingles over a table; a second one, circularly shifted by k places,
gives the k-th coordinate. Both are tables, so all coordinates of a shingle are one run of memory.
Candidates meet in band buckets. A bucket never yields its pairs as rows: it links its members to a hub, in a few
rounds with other hubs, and members still in different groups meet in blocks, which compare whole sets inside a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import by_text, chunks, components, cut, encoded, grams, mix, words
from traceloom.session import bucketed, buckets, keep, scratch

_TABLES: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
_BLOCK = 8192  # shingles of one document that are looked up at once


def tables(bits: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and windows of k values over the circular second one."""
    if (bits, k, seed) not in _TABLES:
        rnd = np.random.default_rng(seed)
        first = rnd.permutation(1 << bits).astype(np.uint32)
        second = rnd.permutation(1 << bits).astype(np.uint32)
        ring = np.concatenate([second, second[:k - 1]])
        _TABLES[bits, k, seed] = first, np.lib.stride_tricks.sliding_window_view(ring, k)
    return _TABLES[bits, k, seed]


def signature(shingles: np.ndarray, bits: int = 20, k: int = 128, seed: int = 7) -> np.ndarray:
    """k coordinates: coordinate j is the least value of the second permutation, shifted by j, over the set."""
    first, ring = tables(bits, k, seed)
    at = first[shingles & np.uint64((1 << bits) - 1)]
    out = None
    for i in range(0, len(at), _BLOCK):
        low = ring[at[i:i + _BLOCK]].min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def _sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    out = []
    for lo, hi in chunks(texts):
        h, at, _, _ = words(texts[lo:hi])
        out += [np.unique(grams(h[i:j], n)) for i, j in zip(at[:-1], at[1:], strict=True)]
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, two fingerprints of the whole set, and a key for each band."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        size, one, two, keys = [], [], [], []
        number = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for s in _sets(encoded(b.column(1)), n):
            size.append(len(s))
            one.append(int(s.sum().astype(np.int64)) if len(s) else 0)
            two.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)) if len(s) else 0)
            if len(s):
                sig = signature(s, k=bands * rows).astype(np.uint64).reshape(bands, rows)
                key = number.copy()
                for r in range(rows):
                    key = mix(key + sig[:, r])
                keys.append(key.astype(np.int64))
            else:
                keys.append(None)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                                           pa.array(keys, pa.list_(pa.int64()))], ["id", "n_shingles", "s1", "s2", "bands"])
    kind = docs.schema[id_col].dataType.simpleString()
    return by_text(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
                   f"id {kind}, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole shingle sets have 100 * |intersection| >= percent * |union|."""
    left, right = (texts.select(F.col("id").alias(c), F.col("text").alias("text_" + c)) for c in "ab")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        one, two = (_sets(encoded(b.column(i)), n) for i in (2, 3))
        keep = []
        for x, y in zip(one, two, strict=True):
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(bool(len(x) and len(y)) and 100 * both >= percent * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))
    kind = pairs.schema["a"].dataType.simpleString()
    # ``texts`` are written in buckets: the pairs go to the texts of a, then with these to those of b
    full = left.join(pairs.hint("shuffle_hash"), "a")
    full = right.join(full.hint("shuffle_hash"), "b").select("a", "b", "text_a", "text_b")
    return by_text(full, run, f"a {kind}, b {kind}")


def crossed(members: DataFrame, texts: DataFrame, sizes: DataFrame, n: int, percent: int, block_rows: int = 1024, block_shingles: int = 1 << 18) -> DataFrame:
    """Links (a, b) that join different groups c among members (band, rep, c) of the same band.

    Each member lives in a block of its fullest bucket. Two blocks meet once, whatever number of buckets they share,
    each with those of its members that lie in a shared bucket. A block holds about ``block_rows`` members or
    ``block_shingles`` shingles (a longer document stands in one all the same), which bounds a task; of the links
    between two blocks a spanning forest is returned.
    """
    full = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    home = members.join(full, "band").groupBy("rep").agg(F.max_by("band", F.struct("n", "band")).alias("home"), F.min("c").alias("c")).join(sizes, "rep")
    home = cut(home)
    split = home.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block_rows, F.sum("n_shingles") / block_shingles)).alias("parts"))
    place = cut(home.join(split, "home").select("rep", "c", F.xxhash64("home", F.pmod(F.xxhash64("rep"), "parts")).alias("block")))
    side = cut(members.select("band", "rep").join(place, "rep").groupBy("band", "block").agg(
        F.collect_list("rep").alias("reps"), F.min("c").alias("lo"), F.max("c").alias("hi")))
    one, two = (side.select("band", *[F.col(c).alias(c + k) for c in ("block", "reps", "lo", "hi")]) for k in "12")
    met = one.join(two, "band").filter("block1 <= block2 and least(lo1, lo2) <> greatest(hi1, hi2)")
    # a member has as many bands as the signature, so the lists of a block are bounded too
    met = cut(met.groupBy("block1", "block2").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("reps1", "reps2")]))
    sides = F.when(F.col("block1") == F.col("block2"), F.array(F.struct(F.lit(3).alias("side"), F.col("reps1").alias("reps")))).otherwise(
        F.array(F.struct(F.lit(1).alias("side"), F.col("reps1").alias("reps")), F.struct(F.lit(2).alias("side"), F.col("reps2").alias("reps"))))
    rows = met.select("block1", "block2", F.inline(sides)).select("block1", "block2", "side", F.explode("reps").alias("rep"))
    rows = texts.select(F.col("id").alias("rep"), "text").join(rows.hint("shuffle_hash"), "rep").join(place.select("rep", "c"), "rep")

    def compare(t: pa.Table) -> pa.Table:
        rep, side = t.column("rep").combine_chunks(), t.column("side").to_numpy()
        label = t.column("c").combine_chunks().dictionary_encode().indices.to_numpy().copy()
        sets = _sets(encoded(t.column("text").combine_chunks()), n)
        size = np.array([len(s) for s in sets])
        at = np.concatenate(([0], np.cumsum(size)))
        _, key = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        listed = np.flatnonzero(side[owner] & 2)
        listed = listed[np.argsort(key[listed], kind="stable")]
        first = np.searchsorted(key[listed], np.arange(key.max() + 2 if len(key) else 1))
        posted, right = owner[listed], np.flatnonzero(side & 2)
        a, b = [], []
        for i in np.flatnonzero(side & 1):
            if not size[i] or (label[right] == label[i]).all():
                continue
            both = np.zeros(len(sets), np.int64)
            for lo in range(at[i], at[i + 1], 1024):
                k = key[lo:min(lo + 1024, at[i + 1])]
                many = first[k + 1] - first[k]
                run = np.repeat(first[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
                both += np.bincount(posted[run], minlength=len(sets))
            hit = np.flatnonzero((both > 0) & (100 * both >= percent * (size + size[i] - both)) & (label != label[i]))
            old, which = np.unique(label[hit], return_index=True)
            a += [i] * len(old)
            b += hit[which].tolist()
            label[np.isin(label, old)] = label[i]
        return pa.table([rep.take(pa.array(a, pa.int64())), rep.take(pa.array(b, pa.int64()))], ["a", "b"])
    kind = members.schema["rep"].dataType.simpleString()
    return rows.groupBy("block1", "block2").applyInArrow(compare, f"a {kind}, b {kind}")


def numbered(docs: DataFrame, outer: bool = False) -> DataFrame:
    """``docs`` with a number ``id`` for each row, written in buckets by it, so that joins with texts move only their other side."""
    n = buckets(docs)
    return bucketed(docs.withColumn("id", F.monotonically_increasing_id()).repartition(n, "id"), "id", n, outer)


def linked(base: DataFrame, n: int = 5, percent: int = 75, bands: int = 64, rows: int = 6, hub_rounds: int = 2) -> DataFrame:
    """(id, n_shingles, component) of rows (id, text) whose ids are unique numbers, as ``numbered`` writes them: the smallest id reachable over links.

    Equal sets are one vertex from the start, known by two 64-bit sums and their size, so copies cost nothing further.
    """
    sig = cut(signatures(base, n, bands, rows, "id", "text"))
    same = ["n_shingles", "s1", "s2"]
    classes = cut(sig.filter("n_shingles > 0").groupBy(*same).agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")))
    band = classes.select("rep", F.explode("bands").alias("band"))
    shared = cut(band.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band"))
    # members of buckets of two or more, with the hub they were linked to (at first themselves)
    member = cut(band.join(shared, "band").withColumn("c", F.col("rep")))
    # whoever meets the most others makes the best hub: an original lies closer to its copies than they to each other
    crowd = cut(member.groupBy("band").agg(F.count(F.lit(1)).alias("n")))
    heavy = member.join(crowd, "band").groupBy("rep").agg(F.sum("n").alias("buckets"))
    group = cut(heavy.join(classes.select("rep", "n_shingles"), "rep").withColumn("c", F.col("rep")))
    texts = base.select("id", "text")
    size_a, size_b = (group.select(F.col("rep").alias(c), F.col("n_shingles").alias("n_" + c)) for c in "ab")
    rank = group.select("rep", "buckets")
    tested = links = None
    for _ in range(hub_rounds):
        hub = cut(member.join(rank, "rep").groupBy("band").agg(F.max_by(F.struct("rep", "c"), F.struct("buckets", F.xxhash64("rep"))).alias("h"))
                  .select("band", F.col("h.rep").alias("a"), F.col("h.c").alias("ca")))
        pairs = hub.join(member.toDF("band", "b", "cb"), "band")
        pairs = pairs.filter("ca <> cb").select("a", "b").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs.join(size_a, "a").join(size_b, "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b"))
        found = cut(verified(pairs, texts, n, percent))
        links = found if links is None else links.union(found)
        both = pairs.union(pairs.select("b", "a"))
        tested = both if tested is None else tested.union(both)
        hubs = hub.select(F.col("a").alias("rep")).distinct()
        to = found.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("to"))
        rank = cut(rank.join(hubs.withColumn("was", F.lit(True)), "rep", "left").select("rep", F.when(F.col("was"), -1).otherwise(F.col("buckets")).alias("buckets")))
        # members follow the hub they are linked to; buckets with several groups go on
        now = member.join(to, "rep", "left").select("band", "rep", F.coalesce("to", "c").alias("c"))
        open_ = cut(now.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("band"))
        if open_.isEmpty():
            break
        member = cut(now.join(open_, "band"))
    else:  # what no hub has joined
        links = links.union(cut(crossed(member, texts, group.select("rep", "n_shingles"), n, percent)))
    group = components(links).select(F.col("id").alias("rep"), F.col("component").alias("c"))
    whole = classes.join(group, "rep", "left").select(*[F.col(c).alias("_" + c) for c in same], F.coalesce("c", "rep").alias("c"))
    cond = (sig.n_shingles == F.col("_n_shingles")) & (sig.s1 == F.col("_s1")) & (sig.s2 == F.col("_s2"))
    return sig.drop("bands").join(cut(whole), cond, "left").select("id", "n_shingles", F.coalesce("c", "id").alias("component"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, bands: int = 64, rows: int = 6, hub_rounds: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable over links), kept.

    With 64 bands of 6 a link of similarity 0.75 is missed once in 280,000 times. Documents without words (null or empty text) link
    with nothing and are their own component. Every row is a vertex of its own, also one whose id is null or repeated. A row whose
    id is null takes the smallest id of its component, null if there is none, and is not kept. An empty table gives an
    empty table. Other columns are not read.
    """
    with scratch(docs.sparkSession):
        base = numbered(docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text")))
        found = cut(linked(base.select("id", "text"), n, percent, bands, rows, hub_rounds).join(base.select("id", "own"), "id"))
        least = cut(found.groupBy("component").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
        out = found.join(least, "component", "left").select(
            F.col("own").alias(id_col), "n_shingles", F.coalesce("least", "own").alias("component_id"))
        return keep(out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))
