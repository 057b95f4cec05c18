"""Interpolated modified Kneser-Ney bigram model: counted in Spark, looked up in mapped arrays.

One job counts. Workers add up large batches of word pairs and send them, as arrays, to buckets of the pair's hash; a
bucket's task adds the batches, writes its pairs as sorted arrays, and sends what it has seen of each word (as a
history, as a continuation) to the word's bucket, where the same happens. Buckets are even whatever the words'
frequencies are, and no frequent word is gathered anywhere. Scoring workers map the files and find the pairs
of a batch of texts by binary search, so a worker holds no more than the pages it touches.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import by_text, chunks, encoded, mix, words
from traceloom.session import shared_dir

START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_BATCH = 1 << 20  # tokens that are counted together before they leave the worker
_OPEN: dict[str, list[np.ndarray]] = {}
_HALF = np.uint64(32)


def token_pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (the words of each text and one end), of the tokens before them, and the bounds of each text."""
    h, at, _, _ = words(texts)
    size = np.diff(at)
    bounds = np.concatenate(([0], np.cumsum(size + 1)))
    token = np.full(int(bounds[-1]), END, np.uint64)
    token[np.repeat(bounds[:-1] - at[:-1], size) + np.arange(len(h))] = h
    before = np.concatenate((token[:0], [START], token[:-1])) if len(token) else token
    before[bounds[:-1]] = START
    return token, before, bounds


def pair_keys(token: np.ndarray, before: np.ndarray) -> np.ndarray:
    """History and token as 32 bits each: two of millions of words that share theirs blur each other's pairs, not their own counts."""
    return before >> _HALF << _HALF | token >> _HALF


def _parts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket numbers and the positions of their keys; keys become even by mixing."""
    bucket = (mix(keys) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(edge)):
        yield int(b), order[edge[b]:edge[b + 1]]


_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
SENT = "bucket int, kind int, keys binary, counts binary"
PAIRS, OWN, HISTORY, KINDS = 0, 1, 2, 3


def _send(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SENT.types, strict=True)], schema=_SENT)


def _packed(kind: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple]:
    """Rows to send: for each bucket its keys, and their counts (one row of numbers for each key) in the narrowest type."""
    out = []
    for b, at in _parts(keys, bits):
        c = counts[at]
        narrow = np.min_scalar_type(int(c.max()))
        out.append((b, kind, keys[at].tobytes(), narrow.str.encode() + b" " + c.astype(narrow).tobytes()))
    return out


def _added(table: pa.Table, kind: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of the received rows of a kind, and the sums of their counts."""
    own = table.filter(pa.compute.equal(table["kind"], kind)) if table.num_rows else table
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros((0, width), np.int64)]
    for k, c in zip(own["keys"].to_pylist(), own["counts"].to_pylist(), strict=True):
        kind_of, _, raw = c.partition(b" ")
        keys.append(np.frombuffer(k, np.uint64))
        counts.append(np.frombuffer(raw, np.dtype(kind_of.decode())).reshape(-1, width).astype(np.int64))
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first, axis=0) if len(first) else n


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


@dataclass
class Store:
    """Tables of sorted 64-bit keys with numbers, in ``1 << bits[name]`` bucket files each, in the shared folder."""

    uri: str
    bits: dict[str, int]
    fetched: bool = False

    def write(self, name: str, bucket: int, keys: np.ndarray, columns: list[np.ndarray]) -> None:
        """One bucket; a repeated task replaces the file by the same one."""
        fs, place = _filesystem(self.uri)
        path = f"{place}/{name}-{bucket}.bin"
        part = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            for c in (keys, *columns):
                f.write(np.ascontiguousarray(c).tobytes())
        fs.move(part, path)

    def bucket(self, name: str, b: int, types: tuple) -> list[np.ndarray]:
        """The bucket's keys and columns, mapped."""
        key = f"{self.uri} {name} {b}"
        if key not in _OPEN:
            place = SparkFiles.get(self.uri.rsplit("/", 1)[-1]) if self.fetched else _filesystem(self.uri)[1]
            path = f"{place}/{name}-{b}.bin"
            sizes = [8, *[np.dtype(t).itemsize for t in types]]
            n = os.path.getsize(path) // sum(sizes) if os.path.exists(path) else 0
            flat = np.memmap(path, np.uint8, "r") if n else np.zeros(0, np.uint8)
            edge = np.concatenate(([0], np.cumsum(np.array(sizes) * n)))
            _OPEN[key] = [flat[i:j].view(t) for i, j, t in zip(edge[:-1], edge[1:], (np.uint64, *types), strict=True)]
        return _OPEN[key]

    def find(self, name: str, keys: np.ndarray, types: tuple) -> list[np.ndarray]:
        """Columns for the keys, zero where one is absent. Equal keys are looked up once, in sorted order."""
        short, back = np.unique(keys, return_inverse=True)
        out = [np.zeros(len(short)) for _ in types]
        for b, at in _parts(short, self.bits[name]):
            have, *columns = self.bucket(name, b, types)
            if not len(have):
                continue
            i = np.minimum(np.searchsorted(have, short[at]), len(have) - 1)
            hit = have[i] == short[at]
            for o, c in zip(out, columns, strict=True):
                o[at] = np.where(hit, c[i], 0)
        return [o[back] for o in out]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2, and 3 or more, from how many n-grams have counts 1 to 4."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return tuple(min(max(x, 0.1), k - 0.1) for x, k in zip(d, (1, 2, 3), strict=True))


@dataclass
class Model:
    """What scoring needs: the store, discounts of both levels, and totals."""

    store: Store
    pair_discount: tuple[float, float, float]
    word_discount: tuple[float, float, float]
    least: int  # smallest count of a stored pair
    kinds: int  # distinct pairs
    word_left: float  # share of the continuation level left for unknown tokens
    vocabulary: int
    tokens: int

    def probabilities(self, token: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(token | token before) for each token, and how often the token itself was counted."""
        def less(a: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
            return np.maximum(a - np.select([a <= 0, a == 1, a == 2], [0.0, d[0], d[1]], d[2]), 0.0)
        own, = self.store.find("own", token, (np.int64,))
        types = (np.int64,) * 5
        continued = self.store.find("word", token >> _HALF, types)[0]
        _, total, n1, n2, n3 = self.store.find("word", before >> _HALF, types)
        a, = self.store.find("pair", pair_keys(token, before), (np.uint32,))
        p = less(np.where(own > 0, continued, 0), self.word_discount) / max(self.kinds, 1) + self.word_left / (self.vocabulary + 1)
        d = self.pair_discount
        # pairs below the stored count leave all their weight to the lower level
        left = sum(n * (c if c < self.least else x) for n, c, x in ((n1, 1, d[0]), (n2, 2, d[1]), (n3, 3, d[2])))
        return np.where(total > 0, (less(a, d) + left * p) / np.maximum(total, 1), p), own


def train(docs: DataFrame, least: int = 1, text_col: str = "text") -> Model:
    """Count, discount and store the model of the texts. Null texts are empty: one end. Without rows: the uniform model.

    Counts and discounts come from all pairs. The file of pairs keeps those counted ``least`` (1, 2 or 3) times or more, all by
    default; the weight of others goes to the lower level, so probabilities still add up to one.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    # about 4 MB of text to a bucket of pairs; fewer buckets of words, as each bucket of pairs sends to all of them
    bits = max(8, (size >> 22).bit_length())
    word_bits = max(8, bits - 6)
    uri = f"{shared_dir(spark).rstrip('/')}/ngrams-{uuid.uuid4().hex}"
    fs, path = _filesystem(uri)
    fs.create_dir(path, recursive=True)
    store = Store(uri, {"pair": bits, "own": bits, "word": word_bits})

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            token, before = (np.concatenate(c) for c in zip(*held, strict=True))
            rows = []
            for kind, keys in ((PAIRS, pair_keys(token, before)), (OWN, token)):
                key, n = np.unique(keys, return_counts=True)
                rows += _packed(kind, key, n[:, None], bits)
            return _send(rows)
        for b in batches:
            texts = encoded(b.column(0))
            for lo, hi in chunks(texts):
                token, before, _ = token_pairs(texts[lo:hi])
                held.append((token, before))
                size += len(token)
                if size >= _BATCH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def add_pairs(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        own, n = _added(table, OWN, 1)
        store.write("own", bucket, own, [n[:, 0]])
        rows = [(0, KINDS, b"", b"<i8 " + np.array([len(own), n.sum(), 0, 0, 0, 0], np.int64).tobytes())]
        key, c = _added(table, PAIRS, 1)
        c = c[:, 0]
        kept = c >= least
        store.write("pair", bucket, key[kept], [np.minimum(c[kept], 2 ** 32 - 1).astype(np.uint32)])
        rows.append((0, KINDS, b"", b"<i8 " + np.array([0, 0, *[(c == i).sum() for i in (1, 2, 3, 4)]], np.int64).tobytes()))
        # continued, total, n1, n2, n3 of both words
        one = np.ones(len(c), np.int64)
        nothing = np.zeros((len(c), 4), np.int64)
        seen = np.concatenate([np.column_stack([one, nothing]), np.column_stack([0 * one, c, c == 1, c == 2, c >= 3])])
        word = np.concatenate([key & np.uint64(0xFFFFFFFF), key >> _HALF])
        order = np.argsort(word, kind="stable")
        word, seen = word[order], seen[order]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
        if len(first):
            rows += _packed(HISTORY, word[first], np.add.reduceat(seen, first, axis=0), word_bits)
        return pa.Table.from_batches([_send(rows)])

    def add_words(table: pa.Table) -> pa.Table:
        word, n = _added(table, HISTORY, 5)
        if len(word):
            store.write("word", table["bucket"][0].as_py(), word, list(n.T))
        c = n[:, 0]
        totals = np.array([c.sum(), *[(c == i).sum() for i in (1, 2, 3, 4)], (c > 0).sum()], np.int64)
        sums = sum((np.frombuffer(x[4:], np.int64) for x, k in zip(table["counts"].to_pylist(), table["kind"].to_pylist(), strict=True) if k == KINDS),
                   np.zeros(6, np.int64))
        return pa.table({"t": [[*map(int, sums), *map(int, totals)]]})

    sent = docs.select(text_col).mapInArrow(count, SENT)
    sent = sent.groupBy("bucket").applyInArrow(add_pairs, SENT).groupBy("bucket").applyInArrow(add_words, "t array<bigint>")
    total = np.array([r["t"] for r in sent.collect()], np.int64).reshape(-1, 12).sum(axis=0).tolist()  # a row for each bucket
    vocabulary, tokens, *pairs, kinds, w1, w2, w3, w4, several = total
    d = discounts(w1, w2, w3, w4)
    left = (w1 * d[0] + w2 * d[1] + (several - w1 - w2) * d[2]) / kinds if kinds else 1.0
    store.fetched = not isinstance(fs, pafs.LocalFileSystem)
    if store.fetched:  # a store that workers cannot map: executors fetch a copy from it
        spark.sparkContext.addFile(uri, recursive=True)
    return Model(store, discounts(*pairs), d, least, kinds, left, vocabulary, tokens)


def score(docs: DataFrame, model: Model, keep: list[Column | str], text_col: str = "text") -> DataFrame:
    """The kept columns with n_tokens, n_known, train_tokens, base_score, score and perplexity of every whole text."""
    kept = docs.select(*keep)
    total, room = model.tokens, model.tokens + model.vocabulary + 1

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, known, base, full = [], [], [], []
        texts = encoded(b.column(b.num_columns - 1))
        for lo, hi in chunks(texts):
            token, before, bounds = token_pairs(texts[lo:hi])
            p, own = model.probabilities(token, before)
            n.append(np.diff(bounds))
            for out, x in ((known, own > 0), (base, np.log10((own + 1) / room)), (full, np.log10(p))):
                out.append(np.add.reduceat(x, bounds[:-1], dtype=np.int64 if x.dtype == bool else np.float64))
        n, known, base, full = (np.concatenate(x) for x in (n, known, base, full))
        cols = [pa.array(n), pa.array(known), pa.array(np.full(len(n), total, np.int64)), pa.array(base), pa.array(full), pa.array(10 ** (-full / n))]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names)
    names = [*kept.columns, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    schema = ", ".join([f"`{c}` {t}" for c, t in kept.dtypes] + ["n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
                                                                  "score double, perplexity double"])
    return by_text(docs.select(*keep, F.col(text_col).alias("_text")), run, schema)
