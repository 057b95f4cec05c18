"""Byte-pair encoding and decoding in batched numpy merge rounds.

The vocabulary file has words with an end mark, lower-cased text, and a pattern that drops white
space. A text is cut at white space; each distinct piece is encoded once for a batch of pieces:
all symbols of all words lie in one flat array, every round finds the pair of lowest rank in each
word by binary search over the sorted pair keys, and merges it wherever it stands.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from traceloom.llm.common import by_text, chunks

# White space as Unicode defines it; the regex module's own class has four more control characters.
_WHITE = "\t-\r \x85\xa0  -     　"
_HELD: dict[str, "WordBpe"] = {}


class WordBpe:
    """Encoder of one vocabulary file; forgets its words when more than ``held`` are known."""

    def __init__(self, path: str, held: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.held = spec["model"]["vocab"], held
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max([*vocab.values(), *self.special.values()], default=-1) + 1)
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        end = spec["model"]["end_of_word_suffix"] or ""
        # printable bytes stand for themselves, the others for the characters from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in shown]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.inner = np.array([vocab.get(sign[b], -1) for b in range(256)], np.int64)
        self.last = np.array([vocab.get(sign[b] + end, -1) for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
                                     .replace(r"[^\s", f"[^{_WHITE}"))
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.clear()

    def clear(self) -> None:
        """Forget all words but the special tokens; numbers handed out before are void."""
        special = list(self.special)
        self.number: dict[str, int] = {t: i for i, t in enumerate(special)}
        self.spelled: list[str] = list(special)
        self.flat = np.array(list(self.special.values()), np.uint32)
        self.start = np.arange(len(special) + 1)

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the bounds of each word."""
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        symbol, word = self.inner[raw], np.repeat(np.arange(len(tokens)), size)
        ends = np.cumsum(size) - 1
        symbol[ends] = self.last[raw[ends]]
        keep = symbol >= 0
        symbol, word = symbol[keep], word[keep]
        out_ids, out_word = [], []
        none = len(self.merged)

        def ranked(left, right):
            pair = left << 32 | right
            at = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            return np.where(self.keys[at] == pair, self.ranks[at], none)

        # rank[i]: of the pair (i, i + 1)
        rank = np.full(len(symbol), none)
        if none and len(symbol):
            inside = np.flatnonzero(word[:-1] == word[1:])
            rank[inside] = ranked(symbol[inside], symbol[inside + 1])
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            done = low == none
            if done.any():
                out_ids.append(symbol[done])
                out_word.append(word[done])
                symbol, word, rank, low = (x[~done] for x in (symbol, word, rank, low))
            mark = rank == low
            at = np.flatnonzero(mark)
            twice = at[1:][(np.diff(at) == 1)]
            if len(twice):  # of overlapping pairs (one symbol repeated) every second one from the left
                run = np.arange(len(mark)) - np.maximum.accumulate(np.where(mark, -1, np.arange(len(mark)))) - 1
                mark &= run % 2 == 0
                at = np.flatnonzero(mark)
            symbol[at] = self.merged[rank[at]]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            rank[at] = rank[at + 1]  # a pair that ended in the merged one is ranked anew below
            new = np.cumsum(stay) - 1
            symbol, word, rank, at = symbol[stay], word[stay], rank[stay], new[at]
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            touched = touched[touched < len(word) - 1]
            inside = touched[word[touched] == word[touched + 1]]
            rank[inside] = ranked(symbol[inside], symbol[inside + 1])
            rank[at[(at == len(word) - 1)]] = none
            outside = touched[word[touched] != word[touched + 1]]
            rank[outside] = none
        if not out_ids:
            return np.zeros(0, np.uint32), np.zeros(len(tokens) + 1, np.int64)
        ids, word = np.concatenate(out_ids), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.uint32), np.searchsorted(word[order], np.arange(len(tokens) + 1))

    def split(self, text: str) -> list[str]:
        """The normalised words of a text; its special tokens stand among them as they are."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.pattern.findall(text.replace("Σ", "σ").lower())

    def tokens(self, text: str) -> list[str]:
        if self.cuts and "<" in text and self.cuts.search(text):
            return [t for part in self.cuts.split(text) for t in ([part] if part in self.special else self.split(part))]
        return self.split(text)

    def learn(self, fresh: list[str]) -> None:
        ids, at = self.merge([t.encode() for t in fresh])
        spelled = list(map(self.names.__getitem__, ids.tolist()))
        bounds = at.tolist()
        n = len(self.spelled)
        self.number.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        self.spelled += [" ".join(spelled[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        self.flat = np.concatenate([self.flat, ids])
        self.start = np.concatenate([self.start, self.start[-1] + at[1:]])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, list[int]]]:
        """For each whole text its ids and the numbers of its words (for ``decode``); valid until the next call."""
        split = [self.tokens(t) for t in texts]
        fresh = set().union(*split).difference(self.number)
        if len(self.number) + len(fresh) > self.held:
            self.clear()
            fresh = set().union(*split).difference(self.number)
        self.learn(sorted(fresh))
        out = []
        for words in split:
            number = list(map(self.number.__getitem__, words))
            n = np.array(number, np.int64)
            first = self.start[n]
            size = self.start[n + 1] - first
            at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            out.append((self.flat[at], number))
        return out

    def decode(self, number: list[int]) -> str:
        """The text of the ids of these words: the names of the ids joined by spaces."""
        return " ".join(filter(None, map(self.spelled.__getitem__, number)))

    def decode_ids(self, ids) -> str:
        return " ".join([self.names[i] for i in ids])


def held(path: str) -> WordBpe:
    """One encoder in each worker."""
    if path not in _HELD:
        _HELD[path] = WordBpe(path)
    return _HELD[path]


def in_chunks(bpe: WordBpe, column: pa.Array) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Encode the texts of a column (null: empty) some megabytes at a time."""
    texts = [t or "" for t in column.to_pylist()]
    for lo, hi in chunks(texts, 4 << 20):
        yield from bpe.encode(texts[lo:hi])


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: id, ``ids`` array<int>, ``decoded`` string.

    A null text counts as empty: no ids and the empty text. Rows are independent, so null or repeated ids,
    repeated rows and ties need no rule; other columns are not read. One narrow stage, no shuffle.
    """
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe, ids, texts = held(path), [], []
        for i, number in in_chunks(bpe, b.column(1)):
            ids.append(i.astype(np.int32))
            texts.append(bpe.decode(number))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())],
                                          [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return by_text(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, but with n_tokens and the SHA-256 of ids (little-endian, 32 bits) and decoded text.

    Digests are taken where the ids arise, so a text's ids never travel.
    """
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe, rows = held(path), []
        for ids, number in in_chunks(bpe, b.column(1)):
            rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                         hashlib.sha256(bpe.decode(number).encode()).hexdigest()))
        n, a, d = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)],
                                          [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return by_text(docs.select(id_col, text_col), run,
                   f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
