"""Toxicity scores of restored text.

Disguised words (digits and signs for letters, letters spaced out or repeated) are restored by a noisy-channel
decoder: each odd stretch is a lattice of what its characters may stand for, and the Viterbi path under a
character trigram model of the corpus is read back. Words and word beginnings of the restored text then carry
weights learnt from labelled documents, and a logistic curve turns them into a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import by_text, chunks, cut, encoded, mix, remainder, words
from traceloom.llm import common

# Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "li"}
SEPARATORS = " .-_*~"
ACCENTED = "ßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + ACCENTED
SIZE = 64  # classes: 0 for any other character, letters from 1
COST = {"sign": 1.0, "kept": 4.0, "dropped": 1.0, "repeat": 0.7, "space": 1.5}  # in nats, against leaving a character as it is
PREFIXES = (4, 5, 6)  # bytes
WINDOW = 64  # characters between two settlings of a path; stretches up to it are remembered
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_CLASS = np.zeros(0x250, np.int64)
for _c, _i in CODE.items():
    _CLASS[ord(_c)] = _i
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x250:
        _CLASS[ord(_c.upper())] = _i

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(97, 123), *range(128, 256)]] = True
_IS_SIGN = np.zeros(256, bool)
_IS_SIGN[[ord(c) for c in LEET]] = True
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[[ord(c) for c in SEPARATORS[1:]]] = True


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a character after two others, from all documents; a table of fixed size."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE ** 3, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                for lo in range(0, len(t or ""), common.CHUNK):
                    code = np.frombuffer(t[max(lo - 2, 0):lo + common.CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
                    c = np.where(code < 0x250, _CLASS[np.minimum(code, 0x24F)], 0)
                    c = c if lo else np.concatenate(([0, 0], c))
                    total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])
    rows = docs.select(text_col).mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(SIZE ** 3)
    n[rows["k"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    n = n.reshape(SIZE, SIZE, SIZE)
    two, one = n.sum(axis=0), n.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 4 * p1) / (two.sum(axis=1, keepdims=True) + 4)
    return np.log((n + 4 * p2[None]) / (n.sum(axis=2, keepdims=True) + 4))


def decode(observed: str, model: np.ndarray) -> str:
    """The likeliest intended text of an odd stretch: Viterbi over its lattice, states are the last two letters.

    What all paths have in common is settled as it goes, so paths stay short whatever the stretch's length is.
    """
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    settled: list[str] = []
    for i, c in enumerate(observed + " "):
        last = i == len(observed)
        inside = 0 < i < len(observed) - 1
        options: list[tuple[str, float]] = []
        if c in CODE:
            options.append((c, 0.0))
            if i and observed[i - 1] == c:
                options.append(("", COST["repeat"]))
        elif c in LEET:
            options += [(x, COST["sign"]) for x in LEET[c]] + [(c, COST["kept"])]
        else:
            options.append((c, 0.0))
        if inside and c in SEPARATORS:
            options.append(("", COST["space"] if c == " " else COST["dropped"]))
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (x, y), (cost, text) in states.items():
            for out, extra in options:
                if not out:
                    key, value = (x, y), (cost + extra, text)
                else:
                    z = CODE.get(out, 0)
                    # a run of signs and blanks counts as one gap
                    key, value = ((y, z), (cost + extra - (model[x, y, z] if y or z else 0.0), text + ("" if last else out)))
                if key not in after or value < after[key]:
                    after[key] = value
        states = after
        if i % WINDOW == WINDOW - 1:
            same = commonprefix([text for _, text in states.values()])
            settled.append(same)
            states = {key: (cost, text[len(same):]) for key, (cost, text) in states.items()}
    return "".join([*settled, min(states.values())[1]])


def odd_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word numbers of the stretches that may be disguised (``data``: lower-case bytes).

    A sign next to a letter, a separator between letters, a letter three times, or three or more single characters
    that are letters (accented ones too) or signs, one letter at least.
    """
    letter, sign = _IS_LETTER[data], _IS_SIGN[data]
    flag = np.zeros(len(data), bool)
    flag[1:] |= sign[1:] & letter[:-1]
    flag[:-1] |= sign[:-1] & letter[1:]
    flag[1:-1] |= _IS_SEPARATOR[data[1:-1]] & letter[:-2] & letter[2:]
    flag[2:] |= letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    at = np.flatnonzero(flag)
    odd = np.zeros(len(start), bool)
    if len(start) and len(at):
        w = np.searchsorted(start, at, side="right") - 1
        odd[w[w >= 0]] = True
    # two bytes from 0xC3 are U+00C0 to U+00FF
    alone = (end - start == 1) & letter[start] | (end - start == 2) & (data[start] == 0xC3) if len(start) else np.zeros(0, bool)
    single = alone | (end - start == 1) & sign[start] if len(start) else alone
    edge = np.diff(np.concatenate(([False], single, [False])).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    letters = np.concatenate(([0], np.cumsum(alone)))
    long = (b - a >= 2) & (letters[b + 1] > letters[a])
    a, b = a[long], b[long]
    odd[np.repeat(a, b - a + 1) + np.arange(int((b - a + 1).sum())) - np.repeat(np.cumsum(b - a + 1) - (b - a + 1), b - a + 1)] = False
    lone = np.flatnonzero(odd)
    order = np.argsort(np.concatenate([a, lone]), kind="stable")
    return np.concatenate([a, lone])[order], np.concatenate([b, lone])[order]


class Restorer:
    """Restores whole texts; decoded stretches are remembered, up to a bound, but for long ones."""

    def __init__(self, model: np.ndarray, held: int = 100_000):
        kept = lru_cache(held)(lambda s: decode(s, model))
        self.read = lambda s: kept(s) if len(s) <= WINDOW else decode(s, model)

    def restore(self, text: str) -> bytes:
        raw = text.lower().encode("utf-8", "surrogatepass")
        if not raw:
            return raw
        _, _, start, end = words([raw])
        data = np.frombuffer(raw, np.uint8)
        first, last = odd_words(data, start, end)
        out, at = [], 0
        for f, l in zip(start[first].tolist(), end[last].tolist(), strict=True):
            s = " ".join(raw[f:l].decode("utf-8", "surrogatepass").split())
            core = s.strip(".,;:?\"'()[]{}<>#%&*=~-_")
            out += [raw[at:f], self.read(core).encode("utf-8", "surrogatepass") if len(core) > 2 else raw[f:l]]
            at = l
        return b"".join([*out, raw[at:]])


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of word beginnings, and the bounds of each text in words; one row for each word."""
    h, at, start, end = words(texts)
    cols = [h]
    size = end - start
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    shift = np.repeat(np.concatenate(([0], np.cumsum(sizes + 1)))[:-1], np.diff(at))
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n" + b"\0" * 8, np.uint8)
    first = start + shift
    for k in PREFIXES:
        x = np.full(len(h), np.uint64(k))
        for i in range(k):
            x = x * np.uint64(257) + np.where(size > i, data[first + i], 0).astype(np.uint64)
        cols.append(mix(np.where(size >= k, x, h)))
    return np.stack(cols, axis=1) if len(h) else np.zeros((0, len(PREFIXES) + 1), np.uint64), at


@dataclass
class Scorer:
    """Weights of features (sorted hashes) and the logistic curve over a document's summary of them."""

    keys: np.ndarray
    weights: np.ndarray
    curve: np.ndarray

    def summary(self, texts: list[bytes]) -> np.ndarray:
        """Per text: its largest word weight, the sum of its five largest, its mean weight, the length's logarithm."""
        out = []
        for lo, hi in chunks(texts):
            f, at = features(texts[lo:hi])
            w = np.zeros(f.shape)
            if len(self.keys) and len(f):
                k = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
                w = np.where(self.keys[k] == f, self.weights[k], 0.0)
            best = np.where(np.abs(w.min(axis=1)) > w.max(axis=1), w.min(axis=1), w.max(axis=1)) if len(f) else np.zeros(0)
            for i, j in zip(at[:-1], at[1:], strict=True):
                x = best[i:j]
                if not len(x):
                    out.append((0.0, 0.0, 0.0, 0.0))
                    continue
                top = np.sort(x if len(x) <= 5 else np.partition(x, len(x) - 5)[-5:])
                out.append((top[-1], top.sum(), x.mean(), np.log1p(len(x))))
        return np.array(out).reshape(-1, 4)

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = self.summary(texts) @ self.curve[1:] + self.curve[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (constant first) by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        g = a.T @ (p - y) + ridge * c
        c -= np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge * np.eye(len(c)), g)
    return c


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, fit_rows: int = 20_000, kept_features: int = 50_000, least: int = 5,
        smooth: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Learn from ``labels`` (id, toxic), at most ``fit_rows`` of them, taken by the hash of the id.

    The ``kept_features`` features of the strongest evidence carry weights. The curve is fitted to summaries of each half of the rows
    under weights from the other half. Rows and features are bounded whatever the input. Without labels of both kinds every score is
    the share of toxic labels (0.0 without labels).
    """
    few = labels.filter("toxic is not null").groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    few = few.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows).withColumn("half", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2)))
    few = cut(few.select("_id", F.col("toxic").cast("int").alias("toxic"), "half"))
    # at most fit_rows narrow rows
    data = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "_id").select("text", "toxic", "half"))
    totals = {(r["half"], r["toxic"]): r["n"] for r in data.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Scorer(np.zeros(0, np.uint64), np.zeros(0), np.zeros(5))
    if any(not totals.get((h, t)) for h in (0, 1) for t in (0, 1)):
        n, y = sum(totals.values()), sum(v for (_, t), v in totals.items() if t)
        none.curve[0] = -30 if not n else np.clip(np.log(max(y, 1e-9) / max(n - y, 1e-9)), -30, 30)
        return none

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(model)
        for b in batches:
            restored = [own.restore(t or "") for t in b.column(0).to_pylist()]
            column = b.column(1).to_numpy() + 2 * b.column(2).to_numpy()
            sets, kind = [], []
            for lo, hi in chunks(restored):
                f, at = features(restored[lo:hi])
                for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    u = np.unique(f[i:j])
                    sets.append(u)
                    kind.append(np.full(len(u), column[lo + k]))
            if sets:
                key, back = np.unique(np.concatenate(sets), return_inverse=True)
                t = np.concatenate(kind)
                n = [pa.array(np.bincount(back, t == c, len(key)).astype(np.int64)) for c in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *n], ["key", *names])
    names = ["n0", "n1", "m0", "m1"]  # clean and toxic of one half, then of the other
    counted = data.select("text", "toxic", "half").mapInArrow(count, "key bigint, " + ", ".join(f"{c} bigint" for c in names))
    counted = counted.groupBy("key").agg(*[F.sum(c).alias(c) for c in names]).filter(F.expr(" + ".join(names)) >= least)

    def odds(toxic, clean, t1: int, t0: int, log, add):
        share = t1 / (t0 + t1)
        w = log((toxic + smooth * share) / (t1 + smooth)) - log((clean + smooth * (1 - share)) / (t0 + smooth))
        return w * (toxic + clean) / (toxic + clean + add)
    every = odds(F.col("n1") + F.col("m1"), F.col("n0") + F.col("m0"), totals[0, 1] + totals[1, 1], totals[0, 0] + totals[1, 0], F.log, 3.0)
    strong = counted.withColumn("w", every).orderBy(F.desc(F.abs("w") * F.sqrt(F.expr(" + ".join(names)))), "key").limit(kept_features).toPandas()
    strong = strong.iloc[np.argsort(strong["key"].to_numpy(np.int64).view(np.uint64))]
    keys = strong["key"].to_numpy(np.int64).view(np.uint64)
    halves = [odds(strong[f"{c}1"].to_numpy(float), strong[f"{c}0"].to_numpy(float), totals[h, 1], totals[h, 0], np.log, 3.0)
              for h, c in enumerate("nm")]
    apart = [Scorer(keys, np.where(strong[f"{c}0"] + strong[f"{c}1"] > 0, w, 0.0), np.zeros(5)) for c, w in zip("nm", halves, strict=True)]

    def summed(b: pa.RecordBatch) -> pa.RecordBatch:
        own = Restorer(model)
        texts, half = [own.restore(t or "") for t in b.column(0).to_pylist()], b.column(2).to_numpy()
        s = np.where((half == 0)[:, None], apart[1].summary(texts), apart[0].summary(texts))
        return pa.RecordBatch.from_arrays([*[pa.array(s[:, i]) for i in range(4)], b.column(1)], ["a", "b", "c", "d", "toxic"])
    rows = by_text(data.select("text", "toxic", "half"), summed, "a double, b double, c double, d double, toxic int").toPandas()
    rows = rows.sort_values(list(rows.columns))
    return Scorer(keys, strong["w"].to_numpy(float), _logistic(rows[["a", "b", "c", "d"]].to_numpy(), rows["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: np.ndarray, scorer: Scorer, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted``, from the whole restored texts.

    Null and empty texts get the score of a text without words. The model's tables have a fixed size. Rows are independent.
    """
    kept = docs.columns
    own: list[Restorer] = []  # one for each task, made where it runs

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not own:
            own.append(Restorer(model))
        texts = b.column(b.num_columns - 1).to_pylist()
        s = scorer.score([own[0].restore(t or "") for t in texts])
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*kept, "score", "predicted"])
    types = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + ["score double, predicted int"])
    return by_text(docs.select(*kept, F.col(text_col).alias("_text")), run, types)


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], threshold: float = 0.3, modulus: int = 4, held: int = 2,
             id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Score every document, having learnt from labels whose crc32(id) mod ``modulus`` is not ``held``.

    Returns the columns ``keep`` with held_out, score and predicted. Null ids are not held out and never labelled; repeated labels of
    an id count as toxic if one is.
    """
    out = F.coalesce(remainder(id_col, modulus) == held, F.lit(False))
    model = character_model(docs, text_col)
    scorer = fit(docs, labels.select(id_col, "toxic").filter(~out), model, id_col=id_col, text_col=text_col)
    return score(docs.select(*keep, text_col) if text_col not in keep else docs.select(*keep), model, scorer, threshold, text_col).withColumn("held_out", out)
