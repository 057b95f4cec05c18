"""Repeated passages across documents by collinear chaining of shared word seeds.

Each document is sampled into seeds (the least of the hashes of five words in every window). A seed that stands in
several documents points to its first document, so a passage in thousands of documents gives as many matches and no
pairs among them. Matches of a document with a source are chained in order with gap costs, the best predecessor coming
from a Fenwick tree of prefix maxima; chains are aligned word by word, and those long and alike enough are passages.

The first documents of a passage's seeds need not hold the passage. So, where all seeds are shared and no passage was
found, every run of ``least`` words points to the first document of that very run: no verbatim repeat is lost. For repeats
with differences, pairs of neighbouring seeds outside all passages meet all earlier documents that have them.

Rows are numbered in the order of their ids, and all work is done on these numbers: null and repeated ids are documents like others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import by_text, chunks, cut, encoded, grams, words
from traceloom.session import bucketed, buckets, keep, scratch

K, WINDOW = 5, 12  # words in a seed, seeds in a window: 16 equal words share a seed
GAP = 0.25  # cost of a word that a chain skips on either side
WIDEST = 32  # words between two passages of a chain
SIDE, BLOCK = 64, 512  # words beside a pair of seeds that are compared, more than a passage's least; documents in a block


def minimizers(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least value of every window (the last one on ties); of a shorter list, of its only window."""
    if len(g) <= window:
        return np.array([int(np.argmin(g))]) if len(g) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, window)
    last = window - 1 - np.argmin(view[:, ::-1], axis=1)
    return np.unique(last + np.arange(len(view)))


def spaced(seed: np.ndarray, pos: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Each seed where it stands first, and again wherever ``apart`` words or more lie behind its last place that counts."""
    order = np.lexsort((pos, seed))
    s, p = seed[order], pos[order]
    keep = np.ones(len(s), bool)
    for i in np.flatnonzero(s[1:] == s[:-1]) + 1:
        last = p[i - 1] if keep[i - 1] else last
        keep[i] = p[i] - last >= apart
    return s[keep], p[keep]


def seeds_of(h: np.ndarray, at: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``minimizers`` of many texts at once, whose words begin at ``at``: seeds, their places in their own text, and how many each text has."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    g = grams(h, k)
    size = np.diff(at) - k + 1  # seeds that a text could have
    n = max(len(g) - window + 1, 0)
    best, place = g[:n].copy(), np.arange(n)
    for i in range(1, window):
        less = g[i:i + n] <= best
        best[less] = g[i:i + n][less]
        place[less] = np.flatnonzero(less) + i
    wide = size > window
    # a window counts that begins in a text and ends in it
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[:-1][wide], 1)
    np.add.at(edge, (at[:-1] + size - window + 1)[wide], -1)
    place = place[np.cumsum(edge[:n]) > 0]
    small = [i + int(np.argmin(g[i:i + m])) for i, m in zip(at[:-1][~wide].tolist(), size[~wide].tolist(), strict=True) if m > 0]
    place = np.unique(np.concatenate([place, np.array(small, np.int64)]))
    text = np.searchsorted(at, place, side="right") - 1
    return g[place], place - at[text], np.bincount(text, minlength=len(at) - 1)


def sown(rows: DataFrame) -> DataFrame:
    """The numbered ``rows`` (id, text, m, other columns), with ``first``, the first document of the same text where that is another one, and the places and seeds
    of all texts that are no copies (pos, seed: lists). Texts are dealt by id once and written in buckets; belongs to the scope outside."""
    digests = cut(rows.filter("text is not null").select("id", "m"))
    first = cut(digests.groupBy("m").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    copies = cut(digests.join(first, "m").filter("id <> first").select("id", "first"))
    n = buckets(rows)
    dealt = rows.drop("m").repartition(n, "id").join(copies.hint("shuffle_hash"), "id", "left")
    names = [*dealt.columns, "pos", "seed"]
    at, copy = names.index("text"), names.index("first")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if own else b"" for t, own in zip(encoded(b.column(at)), b.column(copy).is_null().to_pylist(), strict=True)]
        seed, pos, many = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for lo, hi in chunks(texts):
            for out, x in zip((seed, pos, many), seeds_of(*words(texts[lo:hi])[:2]), strict=True):
                out.append(x)
        offsets = pa.array(np.cumsum(np.concatenate(many)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (np.concatenate(pos).astype(np.int32), np.concatenate(seed).view(np.int64))]
        return pa.RecordBatch.from_arrays([*b.columns, *lists], names)
    kinds = ", ".join(f"{c} {t}" for c, t in dealt.dtypes)
    return bucketed(by_text(dealt, run, f"{kinds}, pos array<int>, seed array<bigint>"), "id", n, outer=True)


def runs(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches joined into runs on one diagonal whose seeds overlap or touch: start in both, and length in words."""
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    new = np.append(True, (np.diff(y - x) != 0) | (np.diff(x) > k + WINDOW))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    return x[first], y[first], x[last] - x[first] + k


class Fenwick:
    """Prefix maxima of (value, index)."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(0.0, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def top(self, n: int) -> tuple[float, int]:
        """The greatest of the first ``n``."""
        out = (-1e18, -1)
        while n > 0:
            if self.best[n] > out and self.best[n][1] >= 0:
                out = self.best[n]
            n -= n & -n
        return out


def chains(x: np.ndarray, y: np.ndarray, n: np.ndarray, gap: float = GAP) -> list[list[int]]:
    """Disjoint collinear chains of runs, best first. A run scores its length; a skipped word costs ``gap`` on either side.

    Predecessors end before the run begins on both sides, so ends enter the tree in the order of x and are asked for by y.
    """
    left, out = set(range(len(x))), []
    while left:
        at = sorted(left, key=lambda i: (x[i], y[i]))
        ends = sorted({int(y[i] + n[i]) for i in at})
        rank = {e: r for r, e in enumerate(ends)}
        tree = Fenwick(len(ends))
        waiting = sorted(at, key=lambda i: x[i] + n[i])
        score, before, w = {}, {}, 0
        for i in at:
            while w < len(waiting) and x[waiting[w]] + n[waiting[w]] <= x[i]:
                j = waiting[w]
                tree.put(rank[int(y[j] + n[j])], (score[j] + gap * float(x[j] + n[j] + y[j] + n[j]), j))
                w += 1
            value, j = tree.top(int(np.searchsorted(ends, y[i], side="right")))
            value -= gap * float(x[i] + y[i])
            score[i], before[i] = (float(n[i]) + value, j) if j >= 0 and value > 0 else (float(n[i]), -1)
        i = max(at, key=lambda i: (score[i], -i))
        chain = []
        while i >= 0:
            chain.append(i)
            i = before[i]
        out.append(chain[::-1])
        left -= set(chain)
    return out


def split(chain: list[int], x: np.ndarray, y: np.ndarray, n: np.ndarray, widest: int = WIDEST) -> list[list[int]]:
    """The chain's parts between gaps wider than ``widest`` words on either side: such a gap separates two passages."""
    parts = [[chain[0]]]
    for i, j in zip(chain[:-1], chain[1:], strict=True):
        if max(x[j] - x[i] - n[i], y[j] - y[i] - n[i]) > widest:
            parts.append([])
        parts[-1].append(j)
    return parts


def alike_first(a: np.ndarray, b: np.ndarray, step: int = 32) -> int:
    """Length of the equal beginning of two word sequences, compared in pieces that double."""
    i, n = 0, min(len(a), len(b))
    while i < n:
        differ = np.flatnonzero(a[i:min(i + step, n)] != b[i:min(i + step, n)])
        if len(differ):
            return i + int(differ[0])
        i, step = i + step, step * 2
    return n


def edit_matches(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common of a cheapest alignment of two gaps (longest common subsequence)."""
    # equal beginnings and ends belong to some longest common subsequence
    first = alike_first(a, b)
    a, b = a[first:], b[first:]
    last = alike_first(a[::-1], b[::-1])
    a, b = sorted((a[:len(a) - last], b[:len(b) - last]), key=len)
    if not len(a):
        return first + last
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        hit = np.append(0, row[:-1] + (b == w))
        row = np.maximum.accumulate(np.maximum(row, hit))
    return first + last + int(row[-1])


def stretch(a: np.ndarray, b: np.ndarray, drop: int = 12) -> tuple[int, int]:
    """How far two word sequences go on alike from here: words and matches; it may skip single words, and ends after too many differences."""
    i = j = best_i = best_j = score = best = 0
    while i < len(a) and j < len(b) and score > best - drop:
        if same := alike_first(a[i:], b[j:]):
            i, j, score = i + same, j + same, score + same
        else:
            options = [(1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2)]
            for di, dj in options:
                if i + di + 1 < len(a) and j + dj + 1 < len(b) and a[i + di] == b[j + dj] and a[i + di + 1] == b[j + dj + 1]:
                    i, j, score = i + di, j + dj, score - 2
                    break
            else:
                i, j, score = i + 1, j + 1, score - 4
        if score > best:
            best, best_i, best_j = score, i, j
    return best_i, best_j


def align(h: np.ndarray, g: np.ndarray, spans: list[tuple[int, int, int]]) -> tuple[int, int, int, int, float]:
    """Ends of a chain's passage in both texts, and the share of its longer side's words that the alignment matches."""
    x, y, _ = spans[0]
    bi, bj = stretch(h[:x][::-1], g[:y][::-1])
    lo, other_lo = x - bi, y - bj
    same, i, j = edit_matches(h[lo:x], g[other_lo:y]), x, y
    for a, b, n in spans:
        a, n, b = max(a, i), n - max(i - a, 0), b + max(i - a, 0)
        if b < j:
            a, n, b = a + j - b, n - (j - b), j
        if n <= 0:
            continue
        same += edit_matches(h[i:a], g[j:b]) if a > i and b > j else 0
        m = min(n, len(h) - a, len(g) - b)
        same += int((h[a:a + m] == g[b:b + m]).sum())
        i, j = a + m, b + m
    fi, fj = stretch(h[i:], g[j:])
    same += edit_matches(h[i:i + fi], g[j:j + fj])
    i, j = i + fi, j + fj
    return lo, i, other_lo, j, same / max(i - lo, j - other_lo, 1)


def passages(h: np.ndarray, g: np.ndarray, spans: list[tuple[int, int, int]], least: int, alike: float) -> list[tuple[int, int, int, int, float]]:
    """Aligned passages of a chain: the whole if it is long and alike enough, or else those of its parts on both sides of its widest gap.

    Of a single run that is not alike enough, the longest equal stretches remain, so none of ``least`` words is lost.
    """
    out, todo = [], [spans]
    while todo:
        part = todo.pop()
        whole = align(h, g, part)
        if whole[1] - whole[0] >= least and whole[4] >= alike:
            out.append(whole)
        elif len(part) > 1:
            gaps = [max(b[0] - a[0] - a[2], b[1] - a[1] - a[2]) for a, b in zip(part[:-1], part[1:], strict=True)]
            k = gaps.index(max(gaps)) + 1
            todo += [part[k:], part[:k]]
        elif whole[1] - whole[0] >= least:
            x, y, n = part[0]
            back = min(x, y, x - whole[0])
            m = min(n + max(whole[1] - x - n, 0), len(h) - x, len(g) - y)
            same = np.concatenate(([False], h[x - back:x + m] == g[y - back:y + m], [False]))
            edge = np.diff(same.astype(np.int8))
            for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                if j - i >= least:
                    out.append((x - back + i, x - back + j, y - back + i, y - back + j, 1.0))
    return out


def open_runs(pos: np.ndarray, shared: np.ndarray, least: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """First words of the runs of ``least`` words that may stand in another text: not wholly inside the union of ``spans``.

    ``pos`` are the places of all seeds of a text, ``shared`` tells which the other text has. The windows inside a run have the
    same seeds in both texts, so a seed that is not shared can only lie near its ends.
    """
    pos, order = np.sort(pos), np.argsort(pos)
    shared = shared[order]
    own = pos[shared]
    if not len(own):
        return own
    t = np.unique((own[:, None] - np.arange(max(least - K + 1, 1))[None]).ravel())
    t = t[t >= 0]
    other = pos[~shared]
    lo, hi = t + WINDOW - 1, t + least - K - WINDOW + 1
    t = t[(np.searchsorted(other, hi, side="right") <= np.searchsorted(other, lo)) | (hi < lo)]
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    if joined:
        a, b = np.array(joined).T
        k = np.searchsorted(a, t, side="right") - 1
        t = t[(k < 0) | (b[np.maximum(k, 0)] < t + least)]
    return t


def covering(pos: np.ndarray, source: np.ndarray, other: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Few of the matched runs that cover all words of them all: (source number, start, start in the source, words)."""
    order = np.lexsort((pos, pos - other, source))
    p, s, o = pos[order], source[order], other[order]
    first = np.flatnonzero(np.append(True, (np.diff(s) != 0) | (np.diff(p - o) != 0) | (np.diff(p) > 1)))
    last = np.append(first[1:], len(p)) - 1
    lo, hi = p[first], p[last] + least
    order = np.argsort(lo, kind="stable").tolist()
    out, end, at = [], -1, 0
    while at < len(order):
        reach, best = max(end, lo[order[at]]), -1
        while at < len(order) and lo[order[at]] <= reach:
            if hi[order[at]] > (hi[best] if best >= 0 else end):
                best = order[at]
            at += 1
        if best >= 0:
            out.append((int(s[first[best]]), int(lo[best]), int(o[first[best]]), int(hi[best] - lo[best])))
            end = hi[best]
    return out


def exact_runs(own: DataFrame, marked: DataFrame, found: DataFrame, least: int) -> DataFrame | None:
    """Runs of ``least`` words outside the passages ``found`` (id, start, end) that an earlier document has: (id, source, spans).

    Each run points to the first document that has all of it. ``own`` (id, text, pos) has all texts and the places of all their seeds, ``marked`` (id, seed, pos,
    source: an earlier document with the seed, or null) those that stand in several. Only texts with seeds of open runs are read. None if there is nothing to look for.
    """
    kind = own.schema["id"].dataType.simpleString()
    spans = found.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("s")).select("id", F.col("s.start").alias("a"), F.col("s.end").alias("b"))
    later = marked.filter("source is not null").groupBy("id").agg(F.collect_list(F.struct("pos", "seed")).alias("m")).select(
        "id", F.col("m.pos").alias("own"), "m.seed").join(spans, "id", "left")

    def searching(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                every, pos, seed = np.asarray(r.pos, np.int64), np.asarray(r.own, np.int64), np.asarray(r.seed, np.int64)
                t = open_runs(every, np.isin(every, pos), least, [] if r.a is None else list(zip(r.a.tolist(), r.b.tolist(), strict=True)))
                if len(t):
                    # the first run that begins behind pos - (least - K) begins at pos or before: the seed lies inside it
                    k = np.minimum(np.searchsorted(t, pos - (least - K)), len(t) - 1)
                    out.append((r.id, t, np.unique(seed[(t[k] <= pos) & (t[k] >= pos - (least - K))])))
            yield pd.DataFrame(out, columns=["id", "starts", "seeds"])
    searched = cut(own.select("id", "pos").join(later.hint("shuffle_hash"), "id").select("id", "pos", "own", "seed", "a", "b").mapInPandas(
        searching, f"id {kind}, starts array<bigint>, seeds array<bigint>"))
    if searched.isEmpty():
        return None
    wanted = cut(searched.select(F.explode("seeds").alias("seed")).distinct())
    flagged = marked.select("id", "seed", "pos").join(wanted, "seed").groupBy("id").agg(F.collect_list("pos").alias("own"))
    both = flagged.join(searched.select("id", F.col("starts").alias("open")), "id", "left")

    def hashed(b: pa.RecordBatch) -> pa.RecordBatch:
        row, gram, pos, opened = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for i, text in enumerate(encoded(b.column(3))):
            h = words([text])[0]
            if len(h) < least:
                continue
            every, flags, o = (np.array(b.column(c)[i].as_py() or [], np.int64) for c in (1, 2, 4))
            t = open_runs(every, np.isin(every, flags), least, [])
            t = t[t <= len(h) - least]
            row.append(np.full(len(t), i))
            gram.append(grams(h, least)[t].view(np.int64))
            pos.append(t)
            opened.append(np.isin(t, o))
        row, gram, pos, opened = (np.concatenate(x) for x in (row, gram, pos, opened))
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(gram), pa.array(pos.astype(np.int32)), pa.array(opened)],
                                          ["id", "gram", "pos", "open"])
    run = cut(by_text(own.join(both.hint("shuffle_hash"), "id").select("id", "pos", "own", "text", "open"), hashed, f"id {kind}, gram bigint, pos int, open boolean"))
    # written, so that the join with a frequent run's one row can be split
    first = cut(run.groupBy("gram").agg(F.min(F.struct("id", "pos")).alias("s"), F.max("id").alias("last")).filter("s.id <> last").select(
        "gram", F.col("s.id").alias("source"), F.col("s.pos").alias("other")))
    matches = run.filter("open").join(first, "gram").filter("source < id").groupBy("id").agg(
        F.collect_list(F.struct("pos", "source", "other")).alias("m")).select("id", "m.pos", "m.source", "m.other")

    def covered(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                codes, sources = pd.factorize(np.asarray(r.source))
                of: dict[int, list] = {}
                for s, *run in covering(np.asarray(r.pos, np.int64), codes, np.asarray(r.other, np.int64), least):
                    of.setdefault(s, []).append([run])
                out += [(r.id, sources[s], chains) for s, chains in of.items()]
            yield pd.DataFrame(out, columns=["id", "source", "chains"])
    return cut(matches.mapInPandas(covered, f"id {kind}, source {kind}, chains array<array<array<bigint>>>"))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All rows: columns c0, c1 ... of ``docs``, the text's md5 m, and ``row``, a number that ascends in the order of (id, nulls last, text).

    Whole numbers as ids, each in one row, are these numbers. Otherwise equal rows get numbers of their own, and the rows are written, into the scope outside.
    """
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    flat = flat.withColumn("m", F.md5(text))
    if dict(flat.dtypes)[own] in ("tinyint", "smallint", "int", "bigint") and flat.groupBy(own).count().filter(F.col(own).isNull() | (F.col("count") > 1)).isEmpty():
        return flat.withColumn("row", F.col(own).cast("long"))
    flat = flat.withColumn("tie", F.monotonically_increasing_id())
    return keep(flat.orderBy(F.col(own).asc_nulls_last(), "m", "tie").drop("tie").withColumn("row", F.monotonically_increasing_id()))


def likely_passages(matches: DataFrame, least: int) -> DataFrame:
    """Chains that may be passages, a row (id, source, chains) for each pair, of the matches (id, pos, source, other, fresh); pairs without a fresh match have none."""
    def chained(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                x, y = (np.array([int(p[c]) for p in r.m], np.int64) for c in ("pos", "other"))
                y, x = spaced(y, x, least)  # a seed has one place in the source
                a, b, n = runs(x, y, K)
                long = []
                for c in [part for c in chains(a, b, n) for part in split(c, a, b, n)]:
                    span = max(a[c[-1]] + n[c[-1]] - a[c[0]], b[c[-1]] + n[c[-1]] - b[c[0]])
                    # what lies before the first and after the last seed is at most a window and a seed if it is equal
                    if span + 2 * (WINDOW + K) >= least:
                        long.append([[int(a[i]), int(b[i]), int(n[i])] for i in c])
                if long:
                    out.append((r.id, r.source, long))
            yield pd.DataFrame(out, columns=["id", "source", "chains"])
    both = matches.groupBy("id", "source").agg(F.sort_array(F.collect_list(F.struct("pos", "other"))).alias("m"),
                                                   F.max("fresh").alias("fresh")).filter("fresh")
    # a chain of one seed is too short: a pair with one match, or with all in a few words, has none
    both = both.filter(F.greatest(F.array_max("m.pos") - F.array_min("m.pos"), F.array_max("m.other") - F.array_min("m.other")) + K
                       + 2 * (WINDOW + K) >= least)
    return cut(both.mapInPandas(chained, "id bigint, source bigint, chains array<array<array<bigint>>>"))


NAMES = ["id", "start", "end", "source", "source_start", "source_end", "alike"]


def verified(likely: DataFrame, own: DataFrame, least: int, alike: float) -> DataFrame:
    """Passages of the chains ``likely``, aligned in the whole texts ``own`` (id, text): columns NAMES.

    A pair's texts travel once for all its chains. A chain that lies, in both texts, in a passage of the pair is that passage again.
    """
    def aligned(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, known, room = [], {}, 1 << 22

        def hashes(column: int, i: int, key: int) -> np.ndarray:
            nonlocal room
            if key not in known:
                h = words(encoded(b.column(column).slice(i, 1)))[0]
                if len(h) > room:
                    known.clear()
                    room = 1 << 22
                known[key], room = h, room - len(h)
            return known[key]
        for i, (own, source, chains) in enumerate(zip(*[b.column(c).to_pylist() for c in (0, 1, 2)], strict=True)):
            h, g, found = hashes(3, i, own), hashes(4, i, source), []
            for c in chains:
                (x, y, _), (u, v, n) = c[0], c[-1]
                if not any(p[0] <= x and u + n <= p[1] and p[2] <= y and v + n <= p[3] for p in found):
                    found += passages(h, g, [tuple(s) for s in c], least, alike)
            rows += [(i, *p) for p in found]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        take = pa.array(cols[0], pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).take(take), *[pa.array(cols[i], pa.int64()) for i in (1, 2)], b.column(1).take(take),
                                           *[pa.array(cols[i], pa.int64()) for i in (3, 4)], pa.array(cols[5], pa.float64())], NAMES)
    # ``own`` is written in buckets: the pairs go to the texts of their sources, then with these to their own
    texts = own.select("id", "text")
    both = texts.select(F.col("id").alias("source"), F.col("text").alias("other")).join(likely.hint("shuffle_hash"), "source")
    both = texts.join(both.hint("shuffle_hash"), "id")
    return keep(by_text(both.select("id", "source", "chains", "text", "other"), aligned,
                        "id bigint, start bigint, `end` bigint, source bigint, source_start bigint, source_end bigint, alike double"))


def pairs_of_seeds(pos: np.ndarray, seed: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every two seeds of a text that may follow each other in a chain: key, place of the first, distance of the second, and whether both are flagged.

    A key has one place: the first of those flagged, or else the first of all.
    """
    order = np.argsort(pos)
    pos, seed, flags = pos[order], seed[order].view(np.uint64), flags[order]
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, len(pos)):
        i = np.flatnonzero(pos[step:] - pos[:-step] <= WIDEST + K)
        if not len(i):
            break
        first.append(i)
        second.append(i + step)
    i, j = np.concatenate(first), np.concatenate(second)
    key, both = grams(seed, 1)[i] * np.uint64(0x9E3779B97F4A7C15) + seed[j], flags[i] & flags[j]
    order = np.lexsort((pos[j], pos[i], ~both, key))
    order = order[np.append(True, np.diff(key[order]) != 0)[:len(order)]]
    i, j = i[order], j[order]
    return key[order].view(np.int64), pos[i], pos[j] - pos[i], both[order]


def window_at(h: np.ndarray, at: int) -> np.ndarray:
    """Words of a text beside a place, as 32-bit numbers: SIDE words backwards from it, then SIDE words from it on; 0 beyond the text."""
    out = np.zeros(2 * SIDE, np.uint32)
    back, ahead = h[max(at - SIDE, 0):at][::-1], h[at:at + SIDE]
    out[:len(back)], out[SIDE:SIDE + len(ahead)] = back.astype(np.uint32) | np.uint32(1), ahead.astype(np.uint32) | np.uint32(1)
    return out


def may_reach(one: np.ndarray, dist: int, many: np.ndarray, dists: np.ndarray, least: int) -> np.ndarray:
    """Which of the windows ``many`` at a pair of seeds may lie in a passage with the window ``one``.

    Left out are only those where both seeds stand in one equal run of less than ``least`` words that ``stretch`` lengthens on neither
    side: with its loss of at most 12 it goes on only to two equal words that begin within 8 words, shifted by one at most.
    A chain with a seed outside the run has a pair of seeds that leaves the run, and that pair is not left out.
    """
    def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words in common, as bits of one number for each half of the windows."""
        return np.packbits((a == b) & (a != 0), axis=1, bitorder="little").view("<u8")
    one, out = np.broadcast_to(one, many.shape), dists != dist
    left = np.flatnonzero(~out)
    a, b = (x[left].reshape(-1, SIDE) for x in (one, many))
    same = equal(a, b).reshape(-1, 2)
    # bits below the lowest one that is not set
    n = np.bitwise_count(same & ~(same + np.uint64(1))).astype(np.int64)
    far = (n.sum(axis=1) >= least) | (n.max(axis=1) > SIDE - 12) | (n[:, 1] < np.broadcast_to(dist, len(many))[left] + K)
    # two equal words that follow each other, with the same shift
    near = np.zeros(same.shape, np.uint64)
    for x, by in ((same, 0), (equal(a[:, :-1], b[:, 1:]).reshape(-1, 2), 0), (equal(a[:, 1:], b[:, :-1]).reshape(-1, 2), 1)):
        near |= (x & (x >> np.uint64(1))) << np.uint64(by)
    out[left[far | ((near >> np.minimum(n, SIDE - 1).astype(np.uint64)) & np.uint64(0x1FF)).any(axis=1)]] = True
    return out


def pairs_in_blocks(rows: DataFrame, own: DataFrame, least: int) -> DataFrame:
    """(id, source): all documents that an open row of ``rows`` (id, key, p, d, open) and an earlier row of its key may have a passage in.

    The rows of a key meet in blocks of about BLOCK, each two of them in one task, so pairs become rows only after ``may_reach``.
    """
    size = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max(F.when(F.col("open"), F.col("id"))).alias("last"))
               .filter("last > least").select("key", "last", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows = cut(rows.join(size, "key").filter("id <= last"))

    def windows(b: pa.RecordBatch) -> pa.RecordBatch:
        take, out = [], []
        for i, text in enumerate(encoded(b.column(6))):
            h = words([text])[0]
            places = b.column(2)[i].as_py()
            take += [(i, k) for k in range(len(places))]
            out += [window_at(h, p).tobytes() for p in places]
        row = pa.array([i for i, _ in take], pa.int64())
        flat = [pa.array([x for c in b.column(n).to_pylist() for x in c], t) for n, t in ((1, pa.int64()), (3, pa.int32()), (4, pa.bool_()), (5, pa.int32()))]
        return pa.RecordBatch.from_arrays([b.column(0).take(row), *flat, pa.array(out, pa.binary())], ["id", "key", "d", "open", "blocks", "w"])
    lists = rows.groupBy("id").agg(F.collect_list(F.struct("key", "p", "d", "open", "blocks")).alias("m")).select("id", "m.key", "m.p", "m.d", "m.open", "m.blocks")
    seen = by_text(own.select("id", "text").join(lists.hint("shuffle_hash"), "id").select("id", "key", "p", "d", "open", "blocks", "text"), windows,
                   "id bigint, key bigint, d int, open boolean, blocks int, w binary")
    seen = cut(seen.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    # a block meets every block, itself included
    meet = seen.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).groupBy(
        "key", F.least("block", "x").alias("g"), F.greatest("block", "x").alias("other")).agg(
        F.collect_list(F.struct("id", "d", "open", "block", "w")).alias("m")).filter(F.size("m") > 1)

    def compared(b: pa.RecordBatch) -> pa.RecordBatch:
        many = b.column(2).value_lengths().to_numpy()
        group = np.repeat(np.arange(len(many)), many)
        ids, dists, open_, block = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3, 4, 5))
        order = np.lexsort((ids, group))
        ids, dists, open_, block = ids[order], dists[order], open_[order], block[order]
        w = np.frombuffer(b"".join(b.column(6).flatten().to_pylist()), np.uint32).reshape(-1, 2 * SIDE)[order]
        own = (b.column(0).to_numpy() == b.column(1).to_numpy())[group]
        begin = np.repeat(np.cumsum(many) - many, many)
        # an open row meets all rows of its key before it, some thousand pairs at a time
        at = np.flatnonzero(open_)
        before = at - begin[at]
        slab = np.cumsum(before) // (1 << 12)
        out = [np.zeros((0, 2), np.int64)]
        for lo, hi in zip(*(np.searchsorted(slab, np.unique(slab), side=k) for k in ("left", "right")), strict=True):
            i = np.repeat(at[lo:hi], before[lo:hi])
            j = np.arange(len(i)) - np.repeat(np.cumsum(before[lo:hi]) - before[lo:hi], before[lo:hi]) + begin[i]
            met = (block[i] != block[j]) | own[i]
            i, j = i[met], j[met]
            hit = may_reach(w[i], dists[i], w[j], dists[j], least)
            out.append(np.unique(np.stack([ids[i[hit]], ids[j[hit]]], axis=1), axis=0))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["id", "source"])
    return by_text(meet.select("g", "other", "m.id", "m.d", "m.open", "m.block", "m.w"), compared, "id bigint, source bigint").distinct()


def further_sources(own: DataFrame, hits: DataFrame, later: DataFrame, found: DataFrame, least: int, alike: float) -> list[DataFrame]:
    """Passages with any earlier document of seeds ``later`` (id, seed, pos) that ``found`` leaves uncovered, as tables of NAMES.

    ``hits`` are all places (id, seed, pos) of all seeds. A chain that may be a passage has two seeds that follow each other in both texts, so
    only documents with such a pair of seeds outside all passages meet. First each pair of seeds points to its first document, then to the next, as
    long as that covers a tenth of what is open; what is still open then meets all earlier documents with its pair, so none is left out.
    """
    kind = "id bigint, key bigint, p int, d int, open boolean"
    inside = F.coalesce(F.exists("s", lambda s: (s["start"] <= F.col("pos")) & (F.col("pos") + K <= s["end"])), F.lit(False))

    def spans_of(found: DataFrame) -> DataFrame:
        return cut(found.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("s")))
    left = cut(later.join(spans_of(found), "id", "left").filter(~inside).select("id", "seed", "pos", F.lit(True).alias("open")))
    wanted = cut(left.select("seed").distinct())
    places = cut(hits.join(wanted, "seed").join(left, ["id", "seed", "pos"], "left").groupBy("id").agg(
        F.collect_list(F.struct("pos", "seed", F.coalesce("open", F.lit(False)).alias("f"))).alias("m")).filter(F.size("m") > 1)
        .select("id", "m.pos", "m.seed", "m.f"))

    def joined(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)]
            for r in f.itertuples(index=False):
                key, p, d, both = pairs_of_seeds(np.asarray(r.pos, np.int64), np.asarray(r.seed, np.int64), np.asarray(r.f, bool))
                out.append((np.full(len(key), r.id), key, p, d, both))
            yield pd.DataFrame(dict(zip(["id", "key", "p", "d", "open"], map(np.concatenate, zip(*out, strict=True)), strict=True)))
    rows = cut(places.mapInPandas(joined, kind))
    common = cut(rows.groupBy("key").agg(F.min("id").alias("least"), F.max(F.when(F.col("open"), F.col("id"))).alias("last")).filter("last > least").select("key", "last"))
    rows = cut(rows.join(common, "key").filter("id <= last").select("id", "key", "p", "d", "open"))
    follow, out, before = rows, [], rows.filter("open").count()

    def matches(pairs: DataFrame) -> DataFrame:
        """Both seeds' places for (id, p, d, source, sp, sd)."""
        ends = F.array(F.struct(F.col("p").alias("pos"), F.col("sp").alias("other")), F.struct((F.col("p") + F.col("d")).alias("pos"), (F.col("sp") + F.col("sd")).alias("other")))
        return pairs.select("id", "source", F.inline(ends)).distinct().select("id", "pos", "source", "other", F.lit(True).alias("fresh"))

    def closed(rows: DataFrame, new: DataFrame) -> DataFrame:
        spans = spans_of(new)
        within = F.coalesce(F.exists("s", lambda s: ((s["start"] <= F.col("p")) & (F.col("p") + K <= s["end"]))
                                     | ((s["start"] <= F.col("p") + F.col("d")) & (F.col("p") + F.col("d") + K <= s["end"]))), F.lit(False))
        return cut(rows.join(spans, "id", "left").select("id", "key", "p", "d", (F.col("open") & ~within).alias("open")))
    while before:
        # the minimum is combined on the map side, and the join with its written rows can be split
        after = cut(follow.groupBy("key").agg(F.min(F.struct("id", "p", "d")).alias("s"), F.max(F.when(F.col("open"), F.col("id"))).alias("last"))
                    .filter("last > s.id").select("key", F.col("s.id").alias("source"), F.col("s.p").alias("sp"), F.col("s.d").alias("sd")))
        follow = cut(follow.join(after, "key").filter("id > source"))
        with scratch(own.sparkSession):
            new = verified(likely_passages(matches(follow.filter("open")), least), own, least, alike)
        if new.isEmpty():
            break
        out.append(new)
        follow, rows = closed(follow.select("id", "key", "p", "d", "open"), new), closed(rows, new)
        now = rows.filter("open").count()
        if now > 0.9 * before:
            break
        before = now
    if before:
        with scratch(own.sparkSession):
            pairs = cut(pairs_in_blocks(rows, own, least))
            of = rows.select(F.col("id").alias("source"), "key", F.col("p").alias("sp"), F.col("d").alias("sd"))
            met = pairs.join(rows.filter("open"), "id").join(of, ["source", "key"])
            out.append(verified(likely_passages(matches(met), least), own, least, alike))
    return out


def passages_of(table: DataFrame, least: int, alike: float) -> DataFrame:
    """Columns NAMES for the documents of ``sown``; ids and sources are their numbers. Written by ``keep``."""
    spark = table.sparkSession
    with scratch(spark):
        own = table.filter("first is null and text is not null").select("id", "text", "pos", "seed")
        with scratch(spark):
            hits = own.select("id", F.inline(F.arrays_zip("seed", "pos")))
            # first document of each seed that stands in two or more
            shared = cut(hits.groupBy("seed").agg(F.min(F.struct("id", "pos")).alias("s"), F.max("id").alias("last")).filter("s.id <> last").select(
                "seed", F.col("s.id").alias("source"), F.col("s.pos").alias("other")))
            earlier = F.col("source") < F.col("id")
            marked = keep(hits.join(shared, "seed").select("id", "seed", "pos", F.when(earlier, F.col("source")).alias("source"), "other"))
        later = marked.filter("source is not null")
        with scratch(spark):
            found = verified(likely_passages(later.select("id", "pos", "source", "other", F.lit(True).alias("fresh")), least), own, least, alike)
        with scratch(spark):
            rest = exact_runs(own, marked, found.select("id", "start", "end"), least)
            if rest is not None:
                rest = verified(rest, own, least, alike)
        if rest is not None:
            found = found.union(rest)
        with scratch(spark):
            all_found = found
            for more in further_sources(own, marked.select("id", "seed", "pos"), later.select("id", "seed", "pos"), found, least, alike):
                all_found = all_found.union(more)
            found = keep(all_found)

        def counted(b: pa.RecordBatch) -> pa.RecordBatch:
            n = [len(t.split()) for t in encoded(b.column(2))]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["id", "source", "n"])
        copies = table.filter("first is not null").select("id", F.col("first").alias("source"), "text")
        whole = by_text(copies, counted, "id bigint, source bigint, n bigint")
        zero = F.lit(0).cast("long")
        return keep(found.union(whole.filter(F.col("n") >= least).select("id", zero, "n", "source", zero, "n", F.lit(1.0))))


def repeats(docs: DataFrame, least: int = 50, alike: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of at least ``least`` words that an earlier document (smaller id, null last, then smaller md5 of the text) has too, with small differences.

    Of every verbatim repeat all words lie in passages; a repeat with differences is looked for in the first documents of its seeds, then in
    all earlier documents that have two of its seeds near each other.
    Rows (id, start, end, source, source_start, source_end, alike); positions count words, ends excluded; ``alike`` is the
    share of matched words; ``source`` is that document's id. A document whose whole text an earlier one has is one passage. Texts that are
    null or too short have none. Every row is a document of its own, also one whose id is null or repeated. An empty table
    gives an empty table. Other columns are not read.
    """
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):
            rows = numbered(docs.select(id_col, text_col), id_col, text_col)
            table = sown(rows.select(F.col("row").alias("id"), F.col("c1").alias("text"), "m"))
        found = passages_of(table, least, alike)
        own, other = (rows.select(F.col("row").alias(k), F.col("c0").alias("_" + k)) for k in ("id", "source"))
        return keep(found.join(own, "id").join(other, "source").select(
            F.col("_id").alias(id_col), "start", "end", F.col("_source").alias("source"), "source_start", "source_end", "alike"))


def without_repeats(docs: DataFrame, least: int = 50, alike: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every repeated passage cut out of the later documents; all rows and columns stay, whatever their names.

    White space before a passage goes with it. Texts without such a passage are unchanged, null stays null. Every row is a
    document of its own, as in ``repeats``: of equal rows the first keeps its text. An empty table stays empty.
    """
    at = docs.columns.index(text_col)
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):
            rows = numbered(docs, id_col, text_col)
        table = sown(rows.withColumnsRenamed({f"c{at}": "text", "row": "id"}))
        spans = keep(passages_of(table, least, alike).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, spans in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
            if t is not None and spans:
                raw = t.encode("utf-8", "surrogatepass")
                _, _, start, end = words([raw])
                kept, place = [], 0
                for s in spans:
                    lo, hi = s["start"], min(s["end"], len(start))
                    if hi > lo and end[hi - 1] > place:
                        cut_at = end[lo - 1] if lo else 0
                        kept.append(raw[place:max(cut_at, place)])
                        place = end[hi - 1]
                t = b"".join([*kept, raw[place:]]).decode("utf-8", "surrogatepass")
            out.append(t)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])], flat)
    flat = [f"c{i}" for i in range(len(docs.columns))]
    types = ", ".join(f"{c} {t}" for c, (_, t) in zip(flat, docs.dtypes, strict=True))
    cut_out = table.join(spans.hint("shuffle_hash"), "id", "left").withColumnRenamed("text", f"c{at}")
    return by_text(cut_out.select(*flat, "spans"), run, types).toDF(*docs.columns)
