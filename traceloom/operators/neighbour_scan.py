"""Nearest rows of queries that a task holds, while the searched rows pass by."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

TILE = 2048  # searched rows that are compared at once
QUERIES = 1024  # queries that are compared with them at once
HELD = 32 << 20  # bytes of queries that a task holds
PAIRS = 1 << 15  # pairs whose exact distance is computed at once


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of numbers as rows of one length."""
    if not len(column):
        return np.zeros((0, 0))
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("vectors have different lengths")
    return flat.reshape(len(column), -1)


def blocks(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """First block and number of blocks for groups of rows: small groups share a block of about ``most`` rows, a larger one gets as many as it needs."""
    out, full, own = {}, 0, 0
    for group, size in sorted(sizes.items()):
        if own and own + size > most:
            full, own = full + 1, 0
        out[group] = (full, max(1, -(-size // most)))
        if size > most:
            full += out[group][1]
        else:
            own += size
    return out


class Scan:
    """The ``k`` nearest of the rows that ``add`` is given, by (distance, id), for each query.

    A product in single precision, with a bound of its error, finds the pairs that may be as near as a query's k-th row so far; only their
    distances are computed, in double precision. ``accept(i, codes)`` may refuse pairs of a query and a row's codes.
    """

    def __init__(self, ids: list, v: np.ndarray, k: int, cells: np.ndarray | None = None, accept: Callable | None = None):
        self.ids, self.v, self.k, self.cells, self.accept = ids, v, k, cells, accept
        self.square = (v * v).sum(1)
        self.distance, self.row = np.full((len(v), k), np.inf), np.zeros((len(v), k), object)
        self.filled, self.limit = np.zeros((len(v), k), bool), np.full(len(v), np.inf)
        self.short = {}

    def _narrow(self, kind: type) -> np.ndarray:
        if kind not in self.short:
            with np.errstate(over="ignore"):
                self.short = {kind: np.concatenate((self.v, np.ones((len(self.v), 1))), axis=1).astype(kind)}
        return self.short[kind]

    def add(self, ids: np.ndarray, v: np.ndarray, cell: int = 0, codes: np.ndarray | None = None) -> None:
        """Compare the queries that the cell is open to with rows of it."""
        # of rows that are alike only the first k by id can be among the k nearest
        alike = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_inverse=True)[1] if v.shape[1] else np.zeros(len(v), np.int64)
        if len(alike) and np.bincount(alike).max() > self.k:
            order = np.lexsort((np.unique(ids, return_inverse=True)[1], alike))
            group = alike[order]
            some = np.sort(order[np.arange(len(group)) - np.searchsorted(group, group) < self.k])
            ids, v, codes = ids[some], v[some], None if codes is None else codes[some]
        square = (v * v).sum(1)
        top, low = (max(square.max(initial=0), self.square.max(initial=0)), square.max(initial=0))
        kind = np.float32 if 1e-20 < top < 1e30 else np.float64
        some = np.arange(len(self.v)) if self.cells is None else np.flatnonzero(self.cells[:, cell])
        tile = np.concatenate((v, -square[:, None] / 2), axis=1).astype(kind).T
        short = self._narrow(kind)
        for at in range(0, len(some), QUERIES):
            q = some[at:at + QUERIES]
            near = short[q] @ tile  # q.t - t.t / 2: the larger, the nearer
            slack = (v.shape[1] + 16) * np.finfo(kind).eps * (self.square[q] + low)
            if self.accept is None and len(v) > self.k and np.isinf(self.limit[q]).any():
                last = -np.partition(-near, self.k - 1, axis=1)[:, self.k - 1]
                least = np.fmin((self.square[q] - self.limit[q]) / 2, np.inf)
                least = np.fmax(least, last - slack)
            else:
                least = (self.square[q] - self.limit[q]) / 2
            # what is not a number is compared, too; the k-th distance may be rounded itself
            i, j = np.divmod(np.flatnonzero(~(near < (least - slack).astype(kind)[:, None])), len(v))
            for a in range(0, len(i), PAIRS):
                x, y = q[i[a:a + PAIRS]], j[a:a + PAIRS]
                if self.accept is not None:
                    ok = self.accept(x, codes[y])
                    x, y = x[ok], y[ok]
                if len(x):
                    self._merge(x, np.sqrt(((v[y] - self.v[x]) ** 2).sum(1)), ids[y])

    def _merge(self, q: np.ndarray, distance: np.ndarray, row: np.ndarray) -> None:
        mine = np.unique(q)
        i, j = np.nonzero(self.filled[mine])
        q, distance, row = np.concatenate((mine[i], q)), np.concatenate((self.distance[mine[i], j], distance)), np.concatenate((self.row[mine[i], j], row.astype(object)))
        order = np.lexsort((np.unique(_sortable(row), return_inverse=True)[1], distance, q))
        q, distance, row = q[order], distance[order], row[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        q, place = q[keep], place[keep]
        self.distance[q, place], self.row[q, place], self.filled[q, place] = distance[keep], row[keep], True
        self.limit[mine] = np.where(self.filled[mine, -1], self.distance[mine, -1] ** 2, np.inf)

    def rows(self, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        """(qid, tid, distance) of all queries."""
        for at in range(0, len(self.v), 10_000):
            i, j = np.nonzero(self.filled[at:at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array([self.ids[n] for n in i + at], kinds[0]), pa.array(self.row[i + at, j].tolist(), kinds[1]),
                                              pa.array(self.distance[i + at, j])], ["qid", "tid", "distance"])


def _sortable(row: np.ndarray) -> np.ndarray:
    return row.astype(np.int64) if len(row) and isinstance(row[0], (int, np.integer)) else row


def scan_tasks(k: int, plan=None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For partitions sorted by (task, kind, cell): the queries of a task (kind 0) stand before the rows that they are compared with.

    Columns: task, kind, cell, qid, tid, v, cells (those open to a query, null for all). ``plan``: a ``HashPlan`` whose buckets bound what is accepted.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        scan, kinds, now, size, waiting = None, None, None, 0, []

        def start() -> Scan:
            ids, v = [x for b in held for x in b.column(3).to_pylist()], np.concatenate([matrix(b.column(5)) for b in held])
            lists = [x for b in held for x in b.column(6).to_pylist()]
            cells = None
            if lists[0] is not None:
                cells = np.zeros((len(v), 1 + max(max(x, default=0) for x in lists)), bool)
                for i, x in enumerate(lists):
                    cells[i, x] = True
            held.clear()
            return Scan(ids, v, k, cells, plan.accepts(v) if plan is not None else None)

        def tile(own: list[pa.RecordBatch], cell: int) -> None:
            v = np.concatenate([matrix(b.column(5)) for b in own])
            ids = np.array([x for b in own for x in b.column(4).to_pylist()])
            if scan.cells is None or cell < scan.cells.shape[1]:
                scan.add(ids, v, cell, plan.codes(v) if plan is not None else None)

        def flush() -> None:
            if waiting:
                tile(waiting, now[2])
                waiting.clear()

        for whole in batches:
            kinds = [whole.schema.field(3).type, whole.schema.field(4).type]
            marks = np.stack([whole.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2)])
            edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), whole.num_rows]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                mark = marks[:, a].tolist()
                if mark != now:
                    if scan is not None:
                        flush()
                        size = 0
                        if mark[0] != now[0]:
                            yield from scan.rows(kinds)
                            scan = None
                    if now is not None and mark[0] != now[0]:
                        held.clear()
                    now = mark
                if mark[1] == 0:
                    held.append(whole.slice(a, z - a))
                    continue
                if scan is None and held:
                    scan, grown = start(), 128
                if scan is None:
                    continue
                while a < z:  # tiles grow, as the first ones have no distance to beat
                    n = min(z - a, grown - size)
                    waiting.append(whole.slice(a, n))
                    a, size = a + n, size + n
                    if size >= grown:
                        flush()
                        size, grown = 0, min(2 * grown, TILE)
        if scan is not None:
            flush()
            yield from scan.rows(kinds)
    return run
