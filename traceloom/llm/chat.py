"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered as one string of ``<turn>role<says>text</turn>``. The three control strings are added tokens of
the tokenizer, so no token crosses a turn's edge. The string is encoded once with offsets, and the sorted spans of the trained
turns meet the sorted token spans by binary search. A control string (or special token) inside a role or text gets a backslash
after its first character and a backslash is doubled, which is undone when the string is read back.

A conversation beyond ``part_chars`` is rendered in parts that begin at turns: its rows are given running lengths by a
range-partitioned scan, so that no task ever holds more than one part, and the parts' tokens are those of the whole, because
every part begins and ends with a control token.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import cut
from traceloom.operators.ordered import SLICE, running_sum, slice_by

TURN, SAYS, END = "<turn>", "<says>", "</turn>"
_HELD: dict[str, "Template"] = {}


class Template:
    """Rendering, encoding and reading back with one byte-level tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import AddedToken, Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (TURN, SAYS, END)])
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # every place where a control string begins, overlapping ones too
        self.control = re.compile("(?=" + "|".join(map(re.escape, [TURN, SAYS, END, *special])) + ")(.)", re.S)

    def escape(self, text: str) -> str:
        return self.control.sub(r"\1\\", text.replace("\\", "\\\\"))

    def render(self, turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted string of (role, text) turns and where each escaped text stands in it."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, body = TURN + self.escape(role) + SAYS, self.escape(text)
            parts += (head, body, END)
            at += len(head)
            spans.append((at, at + len(body)))
            at += len(body) + len(END)
        return "".join(parts), spans

    def encode(self, formatted: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and end character of every token."""
        e = self.tokenizer.encode(formatted, add_special_tokens=False)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2)
        return np.array(e.ids, np.int64), spans[:, 0], spans[:, 1]


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def loss_mask(start: np.ndarray, end: np.ndarray, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in one of the sorted disjoint spans; both edges of each span are found by binary search.

    Raises ValueError when the tokens of a span do not cover exactly its characters.
    """
    s = np.array(spans, np.int64).reshape(-1, 2)
    s = s[s[:, 1] > s[:, 0]]
    first, last = np.searchsorted(end, s[:, 0], "right"), np.searchsorted(start, s[:, 1], "left")
    if len(s) and ((first >= last).any() or (start[first] != s[:, 0]).any() or (end[last - 1] != s[:, 1]).any()):
        raise ValueError("a token crosses the edge of a turn, or characters have no token: a byte-level tokenizer is needed")
    step = np.zeros(len(start) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    return np.cumsum(step)[:-1] > 0


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted string."""
    out = []
    for piece in formatted.split(END)[:-1]:
        role, text = piece.removeprefix(TURN).split(SAYS, 1)
        out.append((unescape(role), unescape(text)))
    return out


def read_masked(formatted: str, start: np.ndarray, end: np.ndarray, mask: np.ndarray) -> str:
    """The unescaped text under the mask, each character once (a character of several bytes may have several tokens)."""
    a, b = start[mask], end[mask]
    if not len(a):
        return ""
    new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))  # where no token joins the one before
    last = np.append(new[1:], len(a)) - 1
    return unescape("".join([formatted[i:j] for i, j in zip(a[new].tolist(), b[last].tolist(), strict=True)]))


def _held(path: str) -> Template:
    """One template in each worker."""
    if path not in _HELD:
        _HELD[path] = Template(path)
    return _HELD[path]


def format_conversations(rows: DataFrame, path: str, trained: Sequence[str] = ("assistant",), part_chars: int = 1 << 20,
                         conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations as formatted strings with ids, token spans and loss mask.

    Returns the conversation's id, part int (from 0), whole boolean (the conversation has this part only), n_turns, formatted,
    ids, starts, ends (arrays of int) and loss_mask (array of boolean: tokens of the texts whose role is in ``trained``). Parts
    of one conversation, in order, make up its string. Turns stand by ``turn_col``, null first, ties and repeated rows in the
    order of a hash of role and text; every row is a turn. A null role or text is empty, an empty text has no token. Rows with a
    null id are one conversation. A text of any length stays whole. Other columns are not read; an empty table gives no rows.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    turns = turns.withColumn("tie", F.xxhash64("role", "text")).withColumn("size", (F.length("role") + F.length("text") + 32).cast("long"))
    long = turns.groupBy("conv").agg(F.sum("size").alias("total")).filter(F.col("total") > part_chars).select(F.col("conv").alias("c"))
    # only conversations beyond the bound pay for a scan; the join key may be null
    kept = turns.join(long, turns["conv"].eqNullSafe(long["c"]), "left_anti").withColumn("part", F.lit(0).cast("long"))
    large = turns.join(long, turns["conv"].eqNullSafe(long["c"]), "left_semi")
    order = ["turn", "tie"]
    run = running_sum(slice_by(large, ["conv"], order), ["conv"], order, run="size")
    parted = run.withColumn("part", F.floor((F.col("run") - F.col("size")) / part_chars)).drop(SLICE, "run")
    kind = rows.schema[conv_col].dataType.simpleString()
    schema = (f"`{conv_col}` {kind}, part bigint, n_turns bigint, formatted string, ids array<int>, starts array<int>, ends array<int>, "
              "loss_mask array<boolean>")
    names, learnt = [conv_col, "part", "n_turns", "formatted", "ids", "starts", "ends", "loss_mask"], set(trained)

    def render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = _held(path)
        for b in batches:
            rows = []
            for said in b.column(2).to_pylist():
                said = [(t["role"], t["text"]) for t in said]
                formatted, spans = template.render(said)
                ids, start, end = template.encode(formatted)
                mask = loss_mask(start, end, [s for (r, _), s in zip(said, spans, strict=True) if r in learnt])
                rows.append((len(said), formatted, ids.astype(np.int32), start.astype(np.int32), end.astype(np.int32), mask))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    def formatted(t: DataFrame, whole: bool) -> DataFrame:
        said = t.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "tie", "role", "text"))).alias("said"))
        return said.mapInArrow(render, schema).withColumn("whole", F.lit(whole))
    return formatted(kept, True).union(formatted(parted, False))


class _Digest:
    """Running digests of one conversation's parts."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, start: np.ndarray, end: np.ndarray, mask: np.ndarray) -> None:
        said, loss = read_turns(formatted), read_masked(formatted, start, end, mask)
        self.turns.update("".join([f"{r}\n{t}\n" for r, t in said]).encode())
        self.loss.update(loss.encode())
        self.n, self.loss_chars, self.chars = self.n + len(said), self.loss_chars + len(loss), self.chars + len(formatted)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest_conversations(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from the output of ``format_conversations``: its id, n_turns, turns_sha256 (role, newline, text,
    newline of every turn), loss_chars and loss_sha256 (of the text under the loss mask), formatted_chars.

    A conversation of one part is digested where it stands. The parts of a longer one pass one task in order, a part at a time: a
    SHA-256 over a whole conversation is a chain by its nature.
    """
    kind = formatted.schema[conv_col].dataType.simpleString()
    schema = f"`{conv_col}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    columns = [conv_col, "part", "formatted", "starts", "ends", "loss_mask"]

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                conv, d = held.pop()
                yield batch([conv], [d.row()])

        def batch(convs, rows) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(convs, id_type), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                                              [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            id_type, ready = b.schema.field(0).type, []
            convs, texts = b.column(0).to_pylist(), b.column(2).to_pylist()
            starts, ends, masks = ([x.values.to_numpy(zero_copy_only=False) for x in b.column(i)] for i in (3, 4, 5))
            for conv, part, text, *tokens in zip(convs, b.column(1).to_pylist(), texts, starts, ends, masks, strict=True):
                if part == 0:  # a new conversation
                    if held:
                        ready.append(held.pop())
                    held.append((conv, _Digest()))
                held[0][1].add(text, *tokens)
            if ready:
                yield batch([c for c, _ in ready], [d.row() for _, d in ready])
        yield from flush()

    whole = formatted.filter("whole").select(*columns).mapInArrow(digests, schema)
    parts = cut(formatted.filter("not whole").select(*columns)).repartition(F.col(conv_col)).sortWithinPartitions(conv_col, "part")
    return whole.union(parts.mapInArrow(digests, schema))
