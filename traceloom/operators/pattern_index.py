"""Thousands of extraction rules over log lines, through an index of the literals they need.

A line can only match a rule that has every literal of the rule's regular expressions in it. The literals are read off the
parsed expressions; one Aho-Corasick automaton per task finds all of them in one pass over a line, and expressions run for
the few rules whose literals are all there. Within a line an expression that many rules share runs once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from re import _constants as K
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame

from traceloom.functions import edge_text as T

FIELDS = ("source", "dest", "action", "timestamp")
LITERALS = (T.NO_LABEL, T.NO_TIMESTAMP, "No Regex")
SKIPPED = "NOT APPLICABLE"
_ZERO_WIDTH = (K.AT, K.ASSERT, K.ASSERT_NOT)


def _runs(items, out: list[str], run: str) -> str:
    """Literal runs that every match holds; returns the run that is still open at the end."""
    for op, arg in items:
        if op is K.LITERAL:
            run += chr(arg)
        elif op is K.SUBPATTERN:
            _, added, removed, inner = arg
            if (added | removed) & re.IGNORECASE:
                out.append(run)
                run = ""
            else:
                run = _runs(inner, out, run)
        elif op is K.ATOMIC_GROUP:
            run = _runs(arg, out, run)
        elif op in _ZERO_WIDTH:
            continue  # takes no character, so its neighbours stay neighbours
        else:
            out.append(run)
            run = ""
            if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] > 0:
                out.append(_runs(arg[2], out, ""))  # stands there at least once
    return run


def required_literal(pattern: str) -> str:
    """The longest text that every match of ``pattern`` holds; empty when none can be told."""
    parsed = _parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return ""
    out: list[str] = []
    out.append(_runs(parsed, out, ""))
    return max(out, key=len)


def _parts(field) -> list[str]:
    """The patterns of a field that have to be found."""
    if field is None:
        return []
    parts = [field] if isinstance(field, str) else [p for p in field if p != SKIPPED][:1] if SKIPPED in field else list(field)
    return [p for p in parts if p not in LITERALS]


class RuleIndex:
    """Compiled rules with their automaton; built once in each task.

    A rule is a dictionary of source, dest, action and timestamp; a field is a regular expression, a fixed word of ``LITERALS``,
    a tuple of expressions joined by ':' (all must be found; with 'NOT APPLICABLE' only the first other one counts), or absent.
    """

    def __init__(self, rules: Sequence[dict]):
        import ahocorasick
        self.rules = [tuple(r.get(f) for f in FIELDS) for r in rules]
        self.regexes: dict[str, re.Pattern] = {}
        self.number: dict[str, int] = {}  # of a literal
        self.needs: list[frozenset[int]] = []
        self.by_literal: dict[int, list[int]] = {}
        self.always: list[int] = []
        needed: dict[str, str] = {}
        for i, rule in enumerate(self.rules):
            own = set()
            for p in (p for f in rule for p in _parts(f)):
                if p not in self.regexes:
                    self.regexes[p], needed[p] = re.compile(p), required_literal(p)
                if needed[p]:
                    own.add(self.number.setdefault(needed[p], len(self.number)))
            self.needs.append(frozenset(own))
        # a rule waits at the literal that the fewest rules need
        used: dict[int, int] = {}
        for own in self.needs:
            for n in own:
                used[n] = used.get(n, 0) + 1
        for i, own in enumerate(self.needs):
            if own:
                self.by_literal.setdefault(min(own, key=lambda n: (used[n], n)), []).append(i)
            else:
                self.always.append(i)
        self.automaton = ahocorasick.Automaton()
        for text, n in self.number.items():
            self.automaton.add_word(text, n)
        if self.number:
            self.automaton.make_automaton()

    def candidates(self, line: str) -> list[int]:
        """Rules whose literals are all in the line, in the order of the rules."""
        if not self.number:
            return self.always
        hits = {n for _, n in self.automaton.iter(line)}
        found = [i for n in hits for i in self.by_literal.get(n, ()) if self.needs[i] <= hits]
        return sorted(found + self.always)

    def _groups(self, pattern: str, line: str, seen: dict) -> tuple[str, ...] | None:
        """Groups of the first match, the whole match where there are none; a group that took no part is empty."""
        if pattern not in seen:
            m = self.regexes[pattern].search(line)
            seen[pattern] = None if m is None else tuple(g or "" for g in m.groups()) or (m.group(0),)
        return seen[pattern]

    def _value(self, field, line: str, seen: dict) -> str | None:
        if isinstance(field, str):
            if field in LITERALS:
                return field
            groups = self._groups(field, line, seen)
            return None if groups is None else ":".join(groups)
        if SKIPPED in field:
            rest = [p for p in field if p != SKIPPED]
            return self._value(rest[0], line, seen) if rest else None
        values = [self._value(p, line, seen) for p in field]
        return None if None in values else ":".join(values)

    def _ends(self, field, line: str, seen: dict) -> list[str] | None:
        """End values of a field: several groups are several ends unless the second is a number."""
        if field is None:
            return [""]
        value = self._value(field, line, seen)
        if value is None:
            return None
        if isinstance(field, str) and field not in LITERALS:
            groups = self._groups(field, line, seen)
            if len(groups) > 1 and not re.match(r"[0-9]+$", groups[1]):
                return list(groups)
        return [value]

    def edges(self, line: str) -> list[tuple[str, str, str, str]]:
        """(src, dst, action, ts) of all rules that match, repeats removed, in the order of the rules."""
        out: dict[tuple, None] = {}
        seen: dict = {}
        for i in self.candidates(line):
            source, dest, action, ts = self.rules[i]
            sources = self._ends(source, line, seen)
            dests = self._ends(dest, line, seen) if sources is not None else None
            if dests is None:
                continue
            act = T.NO_LABEL if action is None else self._value(action, line, seen)
            time = T.UNKNOWN_TS if ts is None else self._value(ts, line, seen)
            if act is None or time is None:
                continue
            time = T.UNKNOWN_TS if time == T.NO_TIMESTAMP else time
            for s in sources:
                for d in dests:
                    out[s.strip("\"'"), d.strip("\"'"), act.strip("\"'"), time] = None
        return list(out)


def with_edges(logs: DataFrame, rules: Sequence[dict], name: str = "_e", line_col: str = "line") -> DataFrame:
    """``logs`` with an array of edge structs (src, dst, action, ts) found by ``rules``, in the order given.

    One narrow stage. A null line has no edges. Only the rules' text travels to the tasks.
    """
    rules = [{f: r.get(f) for f in FIELDS} for r in rules]
    kind = pa.list_(pa.struct([(f, pa.string()) for f in ("src", "dst", "action", "ts")]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules)
        for b in batches:
            found = [[] if line is None else [dict(zip(("src", "dst", "action", "ts"), e, strict=True)) for e in index.edges(line)]
                     for line in b.column(line_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*b.schema.names, name])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in logs.schema.fields)
    return logs.mapInArrow(run, f"{columns}, `{name}` array<struct<src:string,dst:string,action:string,ts:string>>")
