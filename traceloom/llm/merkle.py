"""Merkle dataset manifest on a tree of SHA-256 midstates.

A parent's digest covers the hex text of its children, 64 bytes each and so exactly one block of the hash function. The
chaining value before a child's slot is therefore a complete midstate of 32 bytes. The tree keeps that copy for every child;
a fold resumes it with the replaced child and the right siblings only, and never reads what stands to the left.

Leaves are numbered inside their group by a range-partitioned scan, subtrees of ``WIDTH`` leaves are built in one task each,
and their roots are the leaves of the next round, so ten billion rows need three rounds. The path of a subtree's root (a few
kilobytes) is what the subtree's leaves need to fold to the root of the data set.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.common import cut
from traceloom.operators.common import with_group_stats
from traceloom.operators.ordered import row_index

DEPTH = 4096  # leaves of a subtree that one task builds, at least (a power of the fan-out is taken)


def _roots(count: int, degree: int) -> np.ndarray:
    """First 32 bits of the fractions of the roots of the first primes, from which the hash function takes its constants."""
    primes = [p for p in range(2, 400) if all(p % q for q in range(2, math.isqrt(p) + 1))][:count]
    out = []
    for p in primes:
        x = p << 32 * degree
        r = 1 << (x.bit_length() // degree + 1)
        while r ** degree > x:  # Newton's rule from above
            r = ((degree - 1) * r + x // r ** (degree - 1)) // degree
        out.append(r & 0xFFFFFFFF)
    return np.array(out, np.uint32)


START, _ROUND = _roots(8, 2), _roots(64, 3)
_HEX = np.array([int.from_bytes(b"%02x" % i, "little") for i in range(256)], "<u2")


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) after one block (16, n) of 32-bit words for each of n lanes."""
    w = list(block)
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ a >> np.uint32(3)) + w[i - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ b >> np.uint32(10)))
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        up = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ e & (f ^ g)) + _ROUND[i] + w[i]
        low = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b | c & (a | b))
        a, b, c, d, e, f, g, h = up + low, a, b, c, d + up, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def blocks_of(digests: np.ndarray) -> np.ndarray:
    """Digests (8, n) as the message words (16, n) of their lower-case hex text."""
    raw = np.ascontiguousarray(digests.T).astype(">u4").view(np.uint8)
    return np.ascontiguousarray(_HEX[raw].view(np.uint8).view(">u4").astype(np.uint32).T)


def finish(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests of messages that had ``children`` blocks of hex text."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0], last[15] = 1 << 31, children * 512
    return compress(state, last)


def _pack(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words.T).astype(">u4").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, ">u4").reshape(-1, 8).astype(np.uint32).T)


def _hex(words: np.ndarray) -> list[bytes]:
    raw = _HEX[np.ascontiguousarray(words.T).astype(">u4").view(np.uint8)].tobytes()
    return [raw[i:i + 64] for i in range(0, len(raw), 64)]


def grow(leaves: np.ndarray, levels: int, fanout: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests of every level, the leaves first, and for every child the midstate before its slot."""
    digests, states = [leaves], []
    for _ in range(levels):
        below = digests[-1]
        n = below.shape[1]
        text, before = blocks_of(below), np.empty_like(below)
        state = np.repeat(START[:, None], -(-n // fanout), axis=1)
        for slot in range(fanout):
            at = np.arange(slot, n, fanout)
            before[:, at] = state[:, :len(at)]
            if len(at):
                state[:, :len(at)] = compress(state[:, :len(at)], text[:, at])
        states.append(before)
        digests.append(finish(state, np.minimum(fanout, n - np.arange(0, n, fanout)).astype(np.uint32)))
    return digests, states


@dataclass
class Block:
    """A stored subtree: the digests of its levels and the midstates before their nodes."""
    digests: list[np.ndarray]
    states: list[np.ndarray]
    fanout: int

    @classmethod
    def load(cls, n: int, digests: bytes, states: bytes, fanout: int) -> Block:
        d, s = _unpack(digests), _unpack(states)
        sizes = [n]
        while sum(sizes) < d.shape[1]:
            sizes.append(-(-sizes[-1] // fanout))
        at = np.cumsum([0, *sizes])
        return cls([d[:, i:j] for i, j in zip(at[:-1], at[1:], strict=True)], [s[:, i:j] for i, j in zip(at[:-2], at[1:-1], strict=True)], fanout)

    def fold(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Root digests (8, n) when leaf ``at[i]`` alone becomes ``value[:, i]``: its midstate goes on with it and the right siblings."""
        for d, s in zip(self.digests, self.states, strict=False):
            text, slot = blocks_of(d), at % self.fanout
            children = np.minimum(self.fanout, d.shape[1] - (at - slot))
            state = compress(s[:, at], blocks_of(value))
            for step in range(1, self.fanout):
                more = np.flatnonzero(slot + step < children)
                if len(more):
                    state[:, more] = compress(state[:, more], text[:, at[more] + step])
            value, at = finish(state, children.astype(np.uint32)), at // self.fanout
        return value

    def siblings(self) -> list[list[tuple[list[bytes], list[bytes]]]]:
        """For each level and node the hex digests to its left and to its right under the same parent."""
        out = []
        for d in self.digests[:-1]:
            text = _hex(d)
            out.append([(text[i - i % self.fanout:i], text[i + 1:i - i % self.fanout + self.fanout]) for i in range(len(text))])
        return out

    def paths(self) -> Iterator[list[dict]]:
        """For each leaf its steps to the root: left siblings, own midstate, right siblings."""
        around, states = self.siblings(), [[raw[i:i + 32] for i in range(0, len(raw), 32)] for raw in map(_pack, self.states)]
        for i in range(self.digests[0].shape[1]):
            steps, at = [], i
            for level, state in zip(around, states, strict=True):
                left, right = level[at]
                steps.append({"left": b"".join(left), "state": state[at], "right": b"".join(right)})
                at //= self.fanout
            yield steps


def fold_path(value: np.ndarray, path: list[dict]) -> np.ndarray:
    """Fold n digests (8, n) that share one path."""
    for step in path:
        state = compress(np.repeat(_unpack(step["state"]), value.shape[1], axis=1), blocks_of(value))
        right = step["right"]
        for i in range(0, len(right), 64):
            text = np.frombuffer(right[i:i + 64], ">u4").astype(np.uint32)
            state = compress(state, np.repeat(text[:, None], value.shape[1], axis=1))
        children = (len(step["left"]) + len(right)) // 64 + 1
        value = finish(state, np.full(value.shape[1], children, np.uint32))
    return value


def field_digest(columns: Sequence[Column]) -> Column:
    """Hex SHA-256 of the fields one after another: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


@dataclass
class Manifest:
    """``leaves``: the caller's columns, grp, pos, leaf. ``nodes``: stored subtrees of all rounds, the groups' (top = false) and the one above them."""
    leaves: DataFrame
    nodes: DataFrame
    fanout: int

    def write(self, path: str) -> None:
        self.leaves.write.parquet(f"{path}/leaves")
        self.nodes.withColumn("fanout", F.lit(self.fanout)).write.parquet(f"{path}/nodes")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Manifest:
        nodes = spark.read.parquet(f"{path}/nodes")
        row = nodes.select("fanout").first()
        return cls(spark.read.parquet(f"{path}/leaves"), nodes.drop("fanout"), row["fanout"] if row else 2)


NODE = "top boolean, round int, grp string, block bigint, n int, left int, digest binary, digests binary, states binary"
STEP = "array<struct<left:binary,state:binary,right:binary>>"


def _width(fanout: int) -> tuple[int, int]:
    levels = math.ceil(math.log(DEPTH, fanout) - 1e-9)
    return fanout ** levels, levels


def _forest(nodes: DataFrame, top: bool, fanout: int) -> list[DataFrame]:
    """Subtrees of all rounds over nodes (grp, pos, leaf hex, left: levels that their tree has above them)."""
    width, most = _width(fanout)

    def build(number: int):
        def one(t: pa.Table) -> pa.Table:
            t = t.sort_by("pos")
            left, n = t["left"][0].as_py(), t.num_rows
            levels = min(left, most)
            digests, states = grow(_unpack(bytes.fromhex("".join(t["leaf"].to_pylist()))), levels, fanout)
            row = {"top": top, "round": number, "grp": t["grp"][0].as_py(), "block": t["pos"][0].as_py() // width, "n": n, "left": left - levels,
                   "digest": _pack(digests[-1]), "digests": b"".join(map(_pack, digests)), "states": b"".join(map(_pack, states))}
            return pa.Table.from_pylist([row], schema=pa.schema([("top", pa.bool_()), ("round", pa.int32()), ("grp", pa.string()), ("block", pa.int64()),
                                                                 ("n", pa.int32()), ("left", pa.int32()), ("digest", pa.binary()),
                                                                 ("digests", pa.binary()), ("states", pa.binary())]))
        return one

    out: list[DataFrame] = []
    while True:
        at = nodes.select("grp", "pos", "leaf", "left", F.floor(F.col("pos") / width).alias("b"))
        out.append(cut(at.groupBy("grp", "b").applyInArrow(build(len(out)), NODE)))
        open_ = out[-1].filter("left > 0")
        if open_.isEmpty():
            return out
        nodes = open_.select("grp", F.col("block").alias("pos"), F.lower(F.hex("digest")).alias("leaf"), "left")


def _levels(n: Column, fanout: int) -> Column:
    """Levels above n leaves: the powers of the fan-out that are smaller than n."""
    powers = [fanout ** i for i in range(64) if fanout ** i < 1 << 62]
    return F.size(F.filter(F.array(*[F.lit(p) for p in powers]), lambda p: p < n)).cast("int")


def build(rows: DataFrame, leaf_col: str, group_col: str, order_col: str, fanout: int = 2) -> Manifest:
    """The manifest of ``rows``: per group the leaves ascend by ``order_col``, group roots by group (null first, bytewise).

    ``fanout`` consecutive nodes become their parent while several remain; the last run may hold fewer, even one. A null order
    value stands first, ties and repeated rows are ordered by their leaf digest; all rows count. A null group is a group of its
    own. An empty table gives an empty manifest. Other columns of ``rows`` are kept beside the leaves; the names grp, pos and leaf
    are the manifest's own (``leaf_col`` becomes leaf) and a caller's columns of those names are left out.
    """
    kept = [c for c in rows.columns if c not in ("grp", "pos", "leaf", leaf_col)]
    base = rows.select(*kept, F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("grp"),
                       F.col(order_col).alias("_by"), F.col(leaf_col).alias("leaf"))
    leaves = cut(row_index(base, ["grp"], ["_by", "leaf"], "pos").drop("_by"))
    sized = with_group_stats(leaves.select("grp", "pos", "leaf"), ["grp"], F.count(F.lit(1)).alias("_n"))
    low = _forest(sized.select("grp", "pos", "leaf", _levels(F.col("_n"), fanout).alias("left")), False, fanout)
    subroots = [b.filter("left = 0").select("grp", F.lower(F.hex("digest")).alias("leaf")) for b in low]
    for more in subroots[1:]:
        subroots[0] = subroots[0].union(more)
    numbered = row_index(subroots[0], [], ["grp"], "pos")
    # the one group above; its name is that of no other
    above = with_group_stats(numbered, [], F.count(F.lit(1)).alias("_n")).select(
        F.lit("/").alias("grp"), "pos", "leaf", _levels(F.col("_n"), fanout).alias("left"))
    nodes = low + _forest(above, True, fanout)
    for more in nodes[1:]:
        nodes[0] = nodes[0].union(more)
    return Manifest(leaves, nodes[0], fanout)


def _down(nodes: DataFrame, tails: DataFrame, fanout: int) -> DataFrame:
    """Paths (grp, block, path) of the leaves of the given subtrees, from those of the subtrees' roots."""
    width, _ = _width(fanout)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                steps = list(Block.load(r["n"], r["digests"], r["states"], fanout).paths())
                table = pa.Table.from_pylist([{"grp": r["grp"], "block": r["block"] * width + i, "path": p + r["path"]} for i, p in enumerate(steps)],
                                             schema=pa.schema([("grp", pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.struct(
                                                 [("left", pa.binary()), ("state", pa.binary()), ("right", pa.binary())])))]))
                yield from table.to_batches()
    joined = nodes.join(tails, ["grp", "block"]).select("grp", "block", "n", "digests", "states", "path")
    return joined.mapInArrow(run, f"grp string, block bigint, path {STEP}")


def _paths(manifest: Manifest) -> DataFrame:
    """For each lowest subtree: grp, block, the path of its root to the root of all, the subroot and the root."""
    nodes, empty = manifest.nodes, F.array().cast(STEP)
    rounds = {(r["top"], r["round"]) for r in nodes.select("top", "round").distinct().collect()}  # a few rows
    most = {top: max((n for t, n in rounds if t == top), default=-1) for top in (False, True)}
    tails = nodes.filter("top and left = 0").select("grp", "block", empty.alias("path"))
    for i in range(most[True], -1, -1):
        tails = cut(_down(nodes.filter(f"top and round = {i}"), tails, manifest.fanout))
    root = nodes.filter("top and left = 0").select(F.lower(F.hex("digest")).alias("root"))
    # group g stands at position p under the root: its subroot's path
    done = nodes.filter("not top and left = 0").select("grp", "round", F.col("digest").alias("subroot"))
    order = row_index(done, [], ["grp"], "pos")
    by_group = cut(order.join(tails.select(F.col("block").alias("pos"), "path"), "pos").crossJoin(F.broadcast(root)).select(  # one row
        "grp", "round", F.lower(F.hex("subroot")).alias("subroot"), "root", "path"))
    tails = None
    for i in range(most[False], -1, -1):
        # a group's last subtree of this round takes the group's path; others had theirs from the round above
        own = by_group.filter(F.col("round") == i).select("grp", F.lit(0).cast("long").alias("block"), "path")
        tails = own if tails is None else tails.union(own)
        if i:
            tails = cut(_down(nodes.filter(f"not top and round = {i}"), tails, manifest.fanout))
    if tails is None:
        tails = by_group.select("grp", F.lit(0).cast("long").alias("block"), "path")
    return tails.join(by_group.select("grp", "subroot", "root"), "grp")


def fold(manifest: Manifest, altered_col: str) -> DataFrame:
    """Every leaf folded to the root with the digest of ``altered_col`` in its place (null: the leaf itself).

    Returns the leaves' columns with subroot and root (as stored), proof_sha256 (of the hex of all siblings, level by level up to
    the root, left to right; of nothing where there are none), folded_root and verified (folded_root = root). Every leaf is folded,
    altered or not. An empty manifest gives no rows.
    """
    width, _ = _width(manifest.fanout)
    fanout, leaves = manifest.fanout, manifest.leaves
    own = ["subroot", "root", "proof_sha256", "folded_root", "verified"]
    kept = [c for c in leaves.columns if c not in own]
    schema = leaves.select(*kept).schema
    for name in own[:-1]:
        schema = schema.add(name, "string")
    schema = schema.add("verified", "boolean")
    blocks = manifest.nodes.filter("not top and round = 0").select("grp", "block", "n", "digests", "states").join(_paths(manifest), ["grp", "block"])

    def run(rows: pa.Table, block: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos").drop_columns(["block"])
        b = block.select(["n", "digests", "states", "path", "subroot", "root"]).to_pylist()[0]
        tree = Block.load(b["n"], b["digests"], b["states"], fanout)
        new = [a or leaf for a, leaf in zip(rows[altered_col].to_pylist(), rows["leaf"].to_pylist(), strict=True)]
        at = rows["pos"].to_numpy() % width
        folded = fold_path(tree.fold(_unpack(bytes.fromhex("".join(new))), at), b["path"])
        tail, around, proofs = b"".join(s["left"] + s["right"] for s in b["path"]), tree.siblings(), []
        for i in at.tolist():
            parts = []
            for level in around:
                left, right = level[i]
                parts += left
                parts += right
                i //= fanout
            proofs.append(hashlib.sha256(b"".join(parts) + tail).hexdigest())
        got = [x.decode() for x in _hex(folded)]
        more = ([b["subroot"]] * len(got), [b["root"]] * len(got), proofs, got, [x == b["root"] for x in got])
        for name, values in zip(own, more, strict=True):
            rows = rows.append_column(name, pa.array(values))
        return rows

    left = leaves.select(*kept, F.floor(F.col("pos") / width).alias("block"))
    return left.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInArrow(run, schema)


def manifest_documents(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """Per row of documents: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf covers doc_id, source, lang, n_chars and the whole text. Where 7 divides crc32 of the decimal doc_id, one is added to
    n_chars before the leaf is folded back to the root (a null n_chars or doc_id alters nothing), so there ``verified`` is false.
    Null ids stand first in their lang, repeated ids and rows are leaves of their own in the order of their digests, empty and null
    texts are fields like any other, other columns are not read, an empty table gives no rows.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")  # cannot overflow
    changed = [F.col(c) if c != "n_chars" else more for c in fields]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    rows = docs.select("doc_id", F.col("lang").alias("_group"), field_digest([F.col(c) for c in fields]).alias("_leaf"),
                       F.when(tampered, field_digest(changed)).alias("_altered"))
    manifest = build(rows, "_leaf", "_group", "doc_id", fanout)
    return fold(manifest, "_altered").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
