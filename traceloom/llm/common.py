"""Word hashing, written cut points and connected components shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.session import cut

CHUNK = 1 << 20  # bytes of text that are hashed together
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand at most ``rows`` rows to Python at once, so that long texts do not fill a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for i, b in enumerate((_BASE, inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z in lower case, and where each text's words begin.

    A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D. Returns hashes, the
    bounds of each text (one more than texts), and first byte and end byte of each word
    inside its own text.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    gap = _SPACE[data]
    edge = np.diff(np.concatenate(([True], gap)).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _pow(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])))
    h = mix((total[end] - total[start]) * inverse[start] ^ (end - start).astype(np.uint64) * _STEP)
    bounds = np.searchsorted(start, at)
    shift = np.repeat(at[:-1], np.diff(bounds))
    return h, bounds, start - shift, end - shift


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; the whole sequence as one when it is shorter, none when empty."""
    if not len(h):
        return h
    n, m = min(n, len(h)), len(h) - min(n, len(h)) + 1
    out = np.full(m, np.uint64(n), np.uint64)
    for i in range(n):
        out = out * _STEP + h[i:i + m]
    return mix(out)


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together; a longer text stands alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def encoded(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, nothing for null."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def by_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to the Arrow batches of a narrow stage."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): rows (id, component), the smallest id reachable.

    Alternates two star contractions until nothing changes, a number of rounds in the order
    of log(n) squared at most. Each round is a minimum for each node (combined on the map
    side) joined back to written links, so a hub's links can be split over tasks. Ids
    without a link do not appear. Nulls and self links are left out.
    """
    def star(e: DataFrame, both: bool) -> DataFrame:
        s = cut(e.select("a", "b").union(e.select("b", "a")) if both else e)
        m = cut(s.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        joined = s.join(m, "a")
        if both:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        out = joined.select(F.inline(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m")))).toDF("a", "b")
        return out.filter("a > b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(e)
    while before[0]:
        e = cut(star(cut(star(e, True)), False))
        now = state(e)
        if now == before:
            break
        before = now
    # every link now leads from a node to the smallest of its component
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        e.select("b", "b").distinct().toDF("id", "component"))
