"""Breadth-first trees of single starts over a graph that a task holds in arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ROWS = 100_000  # patterns that are handed on together
TEXTS = 1_000_000  # texts that are kept for the next start
EDGES = 1 << 16  # most edges that are followed at once


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[0] .. first[0] + size[0] - 1, then those of first[1], and so on."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Search:
    """Patterns of the causal paths of starts, see ``profiles.causal_profiles``.

    ``edges``: src, dst and code as 32-bit numbers, a batch of columns each, by number of the edge; ``sets``: node, word and mask as
    64-bit numbers; ``steps``: the text of every code. A level follows the edges of its nodes in order; each unseen target is entered by the
    first edge to it. Where the unseen targets have fewer edges to them than are followed next, their own edges are looked through instead.
    """

    def __init__(self, edges: list[bytes], sets: list[bytes], steps: list[bytes], max_depth: int | None = None, max_nodes: int | None = None):
        self.steps, self.max_depth, self.max_nodes = [s.decode() for s in steps], max_depth, max_nodes
        self.codes = max(len(steps), 1)
        few = np.int16 if self.codes < 1 << 15 else np.int32
        src, dst, code = [], [], []
        while edges:  # a batch goes as soon as it is taken over
            a, b, c = np.frombuffer(edges.pop(0), np.int32).reshape(3, -1)
            src.append(a)
            dst.append(b.copy())
            code.append(c.astype(few))
        src, self.dst, self.code = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((src, np.int32), (dst, np.int32), (code, few)))
        s = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in sets], axis=1) if sets else np.zeros((3, 0), np.int64)
        n = int(max(src.max(initial=-1), self.dst.max(initial=-1), s[0].max(initial=-1))) + 1
        self.off = np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n))))
        # edges by target: their source, and their place among its edges
        back = np.argsort(self.dst, kind="stable")
        self.back_src = src[back]
        self.back_place = (back - self.off[self.back_src]).astype(np.int32)
        del src, back
        self.back_off = np.concatenate(([0], np.cumsum(np.bincount(self.dst, minlength=n))))
        self.back_size = np.diff(self.back_off)
        self.words = -(-self.codes // 64)
        if self.words == 1:  # one mask for every node
            self.mask = np.zeros(n, np.uint64)
            self.mask[s[0]] = s[2].view(np.uint64)
        else:
            s = s[:, np.argsort(s[0], kind="stable")]
            self.set_off, self.word, self.mask = np.concatenate(([0], np.cumsum(np.bincount(s[0], minlength=n)))), s[1], s[2].view(np.uint64)
        self.unseen, self.slot, self.place = np.zeros(n, bool), np.zeros(n, np.int64), np.full(n, -1, np.int32)
        self.repeats = any("|" in t or not t for t in self.steps)  # then different paths may have one text
        self._forget()
        self.found, self.names, self.size = [], [], 0

    @property
    def full(self) -> bool:
        return self.size >= ROWS or self._many()

    def _many(self) -> bool:
        return len(self.texts) >= TEXTS or len(self.beyond) >= TEXTS // 4

    def _forget(self) -> None:
        self.texts, self.by_text, self.child, self.beyond = [""], {"": 0}, {}, {}

    def _step(self, key: int) -> int:
        """The number of a path and a step after it; ``key`` is path * codes + code."""
        before, step = self.texts[key // self.codes], self.steps[key % self.codes]
        text = f"{before}|{step}" if before else step
        at = self.child[key] = self.by_text.setdefault(text, len(self.texts))
        if at == len(self.texts):
            self.texts.append(text)
        return at

    def _paths(self, keys: np.ndarray) -> np.ndarray:
        child, step = self.child, self._step
        return np.array([at if (at := child.get(k)) is not None else step(k) for k in keys.tolist()], np.int64)

    def add(self, start: int, name: str) -> None:
        """Search one start and keep its patterns for ``rows``."""
        out, depth, entered = [], 1, 1
        np.greater(self.back_size, 0, out=self.unseen)
        self.left = len(self.dst)  # edges to unseen nodes
        self._enter(np.array([start]))
        front, local, paths = np.array([start]), np.zeros(1, np.int64), np.zeros(1, np.int64)  # nodes, and which of the level's paths leads to each
        while len(front):
            if self.max_nodes is not None:
                before = entered - len(front)
                front, local = front[:max(0, self.max_nodes - before)], local[:max(0, self.max_nodes - before)]
            out.append(self._patterns(front, local, paths))
            if depth == self.max_depth:
                break
            front, parent, code = self._level(front)
            key = local[parent] * self.codes + code
            width = len(paths) * self.codes
            if width <= max(1 << 16, 4 * len(key)):
                there = np.zeros(width, bool)
                there[key] = True
                some = np.flatnonzero(there)
                number = np.zeros(width, np.int64)
                number[some] = np.arange(len(some))
                local = number[key]
            else:
                some, local = np.unique(key, return_inverse=True)
            paths = self._paths(paths[some // self.codes] * self.codes + some % self.codes)
            entered += len(front)
            depth += 1
        ids = np.concatenate(out)
        if self.repeats:
            ids = np.unique(ids)
        self.found.append(ids)
        self.names.append(name)
        self.size += len(ids)

    def _patterns(self, front: np.ndarray, local: np.ndarray, paths: np.ndarray) -> np.ndarray:
        """Numbers of the paths one step beyond the front, over all steps out of its nodes."""
        if not len(front):
            return np.zeros(0, np.int64)
        if self.words == 1:
            group, mask = local, self.mask[front]
        else:
            first = self.set_off[front]
            size = self.set_off[front + 1] - first
            at = ranges(first, size)
            group, mask = np.repeat(local, size) * self.words + self.word[at], self.mask[at]
        order = np.argsort(group.astype(np.uint16) if len(paths) * self.words <= 1 << 16 else group, kind="stable")
        group = group[order]
        new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))[:len(group)]
        mask = np.bitwise_or.reduceat(mask[order], new) if len(new) else mask
        group, beyond, out = group[new], self.beyond, [np.zeros(0, np.int64)]
        for k in zip(paths[group // self.words].tolist(), (group % self.words).tolist(), mask.tolist(), strict=True):
            if (ids := beyond.get(k)) is None:
                bits = [b for b in range(64) if k[2] >> b & 1]
                ids = beyond[k] = self._paths(k[0] * self.codes + k[1] * 64 + np.array(bits, np.int64))
            out.append(ids)
        return np.concatenate(out)

    def _enter(self, node: np.ndarray) -> None:
        self.unseen[node] = False
        self.left -= int(self.back_size[node].sum())

    def _level(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unseen targets of the front in the order they are entered, the place of their parent in the front and the code of the edge."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        first = self.off[front]
        size = self.off[front + 1] - first
        ends = np.cumsum(size)
        total, at, most = int(ends[-1]) if len(ends) else 0, 0, 4096
        while at < total and self.left:
            if self.left <= most:
                found.append(self._backward(front))
                break
            until = min(at + most, total)
            parents = np.arange(np.searchsorted(ends, at, "right"), np.searchsorted(ends, until, "left") + 1)
            begin = ends[parents] - size[parents]
            low = np.maximum(begin, at)
            many = np.minimum(ends[parents], until) - low
            begin = first[parents] + low - begin
            if 64 * len(parents) < until - at:
                for parent, i, j in zip(parents.tolist(), begin.tolist(), (begin + many).tolist(), strict=True):  # no two edges of one node lead to one target
                    node = self.dst[i:j]
                    place = np.flatnonzero(self.unseen.take(node))
                    if len(place):
                        node = node.take(place)
                        self._enter(node)
                        found.append((node, np.full(len(node), parent), self.code[i:j].take(place)))
            else:
                node = self.dst[ranges(begin, many)]
                place = np.flatnonzero(self.unseen.take(node))
                node = node.take(place)
                self.slot[node[::-1]] = place[::-1]  # the first edge to a node is written last
                own = self.slot[node] == place
                node, place = node[own], place[own]
                self._enter(node)
                last = np.cumsum(many)
                by = np.searchsorted(last, place, "right")
                found.append((node, parents[by], self.code[begin[by] + place - (last - many)[by]]))
            at, most = until, min(2 * most, EDGES)
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))

    def _backward(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same by the edges to what is unseen. None of those followed so far leads there, so no edge of the front is left out."""
        rest = np.flatnonzero(self.unseen)
        to = self.back_size[rest]
        edge = ranges(self.back_off[rest], to)
        self.place[front] = np.arange(len(front))
        parent = self.place[self.back_src[edge]]
        self.place[front] = -1
        some = np.flatnonzero(parent >= 0)
        parent, edge, node = parent[some], edge[some], np.repeat(rest, to)[some]
        order = np.lexsort((self.back_place[edge], parent))
        parent, edge, node = parent[order], edge[order], node[order]
        at = np.arange(len(node))
        self.slot[node[::-1]] = at[::-1]
        own = self.slot[node] == at
        parent, edge, node = parent[own], edge[own], node[own]
        self._enter(node)
        return node, parent, self.code[self.off[front[parent]] + self.back_place[edge]]

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(node, pattern) of the starts added since the last call."""
        ids = np.concatenate(self.found) if self.found else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(self.names)), [len(x) for x in self.found])
        names = pa.array(self.names, pa.string())
        for at in range(0, len(ids), ROWS):
            some, place = np.unique(ids[at:at + ROWS], return_inverse=True)
            texts = pa.array([self.texts[i] for i in some], pa.string())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(owner[at:at + ROWS])), texts.take(pa.array(place))], ["node", "pattern"])
        self.found, self.names, self.size = [], [], 0
        if self._many():
            self._forget()
