"""Edges and entity names out of log lines.

``extract_edges`` keeps all edges of a log in one array column, so the whole
clean-up of a log stays on its row: no shuffle, no group, and a retry redoes one
input split only. Patterns are plain data; they become Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import cdm
from traceloom.functions import edge_text as T
from traceloom.operators.common import first_rows, parsed_rows
from traceloom.operators.filters import REVERSE_TYPES
from traceloom.operators.pattern_index import FIELDS, LITERALS, _parts, required_literal, with_edges

INDEXED = 16  # from so many rules on a plan with one expression tree for each would outgrow what Spark compiles
EDGE = "array<struct<src:string,dst:string,action:string,ts:string>>"


def order_patterns(patterns: Sequence[dict]) -> list[dict]:
    """Specific patterns (with an action or a timestamp) first, order kept otherwise."""
    def generic(p: dict) -> bool:
        return all(not p.get(f) or p[f] in LITERALS[:2] for f in ("action", "timestamp"))
    return sorted(patterns, key=generic)


def _single(line: Column, pattern: str) -> tuple[Column, Column]:
    """(matches, value) of one pattern: its group, its groups joined by ':', or the whole match."""
    if pattern in LITERALS:
        return F.lit(True), F.lit(pattern)
    groups = re.compile(pattern).groups
    if groups <= 1:
        return line.rlike(pattern), F.regexp_extract(line, pattern, groups)
    return line.rlike(pattern), F.concat_ws(":", *[F.regexp_extract(line, pattern, i + 1) for i in range(groups)])


def _literals(p: dict) -> list[str]:
    """Texts that a line must hold to match a rule, one of each expression at most."""
    found = {required_literal(x) for f in FIELDS for x in _parts(p.get(f))}
    return sorted(found - {""}, key=len, reverse=True)


def _field(line: Column, pattern) -> tuple[Column, Column]:
    """(matches, value) of a field given as one pattern, a tuple of parts, or nothing."""
    if pattern is None:
        return F.lit(True), F.lit(None).cast("string")
    if isinstance(pattern, str):
        return _single(line, pattern)
    if "NOT APPLICABLE" in pattern:
        rest = [p for p in pattern if p != "NOT APPLICABLE"]
        return _single(line, rest[0]) if rest else (F.lit(False), F.lit(None).cast("string"))
    parts = [_single(line, p) for p in pattern]
    ok = parts[0][0]
    for m, _ in parts[1:]:
        ok = ok & m
    return ok, F.concat_ws(":", *[v for _, v in parts])


def _ends(line: Column, pattern) -> tuple[Column, Column]:
    """(matches, array of end values): several groups are several ends unless group 2 is a number."""
    ok, value = _field(line, pattern)
    if isinstance(pattern, str) and pattern not in LITERALS and (n := re.compile(pattern).groups) > 1:
        each = F.array(*[F.regexp_extract(line, pattern, i + 1) for i in range(n)])
        port = F.regexp_extract(line, pattern, 2).rlike(r"^\d+$")
        return ok, F.when(port, F.array(value)).otherwise(each)
    return ok, F.array(F.coalesce(value, F.lit("")))


def match_patterns(line: Column, patterns: Sequence[dict]) -> Column:
    """Array of edge structs found by a pattern list in one line, repeats removed."""
    found = []
    for p in order_patterns(patterns):
        s_ok, srcs = _ends(line, p.get("source"))
        d_ok, dsts = _ends(line, p.get("dest"))
        a_ok, act = _field(line, p.get("action"))
        t_ok, ts = _field(line, p.get("timestamp"))
        act = F.coalesce(act, F.lit(T.NO_LABEL))
        ts = F.when(ts == T.NO_TIMESTAMP, T.UNKNOWN_TS).otherwise(F.coalesce(ts, F.lit(T.UNKNOWN_TS)))

        def unquote(c: Column) -> Column:
            return F.regexp_replace(c, "^[\"']+|[\"']+$", "")

        def cross(srcs: Column, dsts: Column, act: Column, ts: Column) -> Column:
            return F.flatten(F.transform(srcs, lambda s: F.transform(dsts, lambda d: F.struct(
                unquote(s).alias("src"), unquote(d).alias("dst"), unquote(act).alias("action"), ts.alias("ts")))))

        # plain substring tests first: they spare the expressions on lines of other rules
        ok = s_ok & d_ok & a_ok & t_ok
        for text in _literals(p):
            ok = F.contains(line, F.lit(text)) & ok
        found.append(F.when(ok, cross(srcs, dsts, act, ts)).otherwise(F.array().cast(EDGE)))
    return F.array_distinct(F.flatten(F.array(*found)))


def _each(edges: Column, **changes) -> Column:
    def apply(e: Column) -> Column:
        for name, fn in changes.items():
            e = e.withField(name, fn(e[name]))
        return e
    return F.transform(edges, apply)


def _split(edges: Column, parts) -> Column:
    return F.flatten(F.transform(edges, lambda e: F.transform(parts(e["action"]), lambda a: e.withField("action", a))))


def merge_repeats(edges: Column, smart: bool) -> Column:
    """Join the actions of edges with the same ends; words lower-cased, distinct, in order.

    ``smart`` compares URL-like ends by their normal form.
    """
    def key(e: Column) -> Column:
        s, d = T.rtrim_colons(e["src"]), T.rtrim_colons(e["dst"])
        if smart:
            both = s.rlike("[a-zA-Z]") & d.rlike("[a-zA-Z]")
            s, d = F.when(both, T.grouping_key(s)).otherwise(s), F.when(both, T.grouping_key(d)).otherwise(d)
        return F.struct(s.alias("s"), d.alias("d"))

    def merged(k: Column) -> Column:
        # a one-element array binds the group, so that it is filtered only once
        return F.get(F.transform(F.array(F.filter(edges, lambda e: key(e) == k)), one_edge), F.lit(0))

    def one_edge(same: Column) -> Column:
        words = F.array_distinct(F.flatten(F.transform(same, lambda e: F.split(T.trim_all(e["action"]), r"\s+"))))
        text = F.array_join(F.array_sort(F.transform(words, F.lower)), " ")
        one = F.get(same, F.lit(0))
        return (one.withField("action", F.when(F.size(same) > 1, text).otherwise(one["action"]))
                .withField("src", T.rtrim_colons(one["src"])).withField("dst", T.rtrim_colons(one["dst"])))

    return F.transform(F.array_distinct(F.transform(edges, key)), merged)


def tidy_edges(edges: Column, builtin_ids: bool) -> Column:
    """The ordered clean-up of one log's edges; the order of steps is part of the result."""
    keep = F.filter
    e = _split(edges, T.action_lines)
    e = _each(e, action=T.strip_action_marks)
    e = keep(e, lambda x: T.has_usable_action(x["action"]))
    e = keep(e, lambda x: T.has_usable_timestamp(x["ts"]))
    e = _split(e, T.colon_parts)
    e = keep(e, lambda x: T.has_letter(x["action"]))
    e = keep(_each(e, action=T.drop_integer_words), lambda x: x["action"] != "")
    e = _each(e, src=T.strip_record_prefix, dst=T.strip_record_prefix)
    e = _each(e, src=T.rtrim_colons, dst=T.rtrim_colons)
    e = _each(e, ts=T.tidy_timestamp)
    e = _each(e, action=T.unwrap_brackets)
    e = _each(e, src=T.strip_uri_prefix, dst=T.strip_uri_prefix)
    if not builtin_ids:
        e = _each(e, action=T.http_only)
    e = F.array_distinct(e)
    e = keep(e, lambda x: T.ends_not_empty(x["src"], x["dst"]))
    return keep(e, lambda x: T.ends_not_integer(x["src"], x["dst"]))


def final_checks(edges: Column, names: Column | None) -> Column:
    """Filters that compare an edge with its own log: entity names, times and other ends."""
    keep = F.filter
    e = keep(edges, lambda x: T.not_self_loop(x["src"], x["dst"]))
    if names is not None:
        e = keep(e, lambda x: ~(F.array_contains(names, x["src"]) | F.array_contains(names, x["dst"]) |
                                F.array_contains(names, x["action"])))
    e = keep(e, lambda x: T.action_not_in_timestamp(x["action"], x["ts"]))
    e = keep(e, lambda x: T.has_usable_action(x["action"]))
    e = keep(e, lambda x: T.ends_not_near_equal(x["src"], x["dst"]))
    e = keep(e, lambda x: T.ends_not_single_char(x["src"], x["dst"]))
    return e


def without_end_actions(edges: Column) -> Column:
    ends = F.flatten(F.transform(edges, lambda e: F.array(e["src"], e["dst"])))
    return F.filter(edges, lambda e: ~F.array_contains(ends, e["action"]))


def name_pairs(line: Column, patterns: Sequence[dict]) -> Column:
    """Array of (entity, name) found by id/name patterns; the last name of an id wins."""
    text = F.replace(line, F.lit('\\"'), F.lit('"'))
    found = []
    for p in patterns:
        if not p.get("id") or not p.get("name") or p["name"] == "No Regex":
            continue
        i_ok, ident = _field(text, p["id"])
        n_ok, name = _field(text, p["name"])
        one = F.struct(T.trim_all(ident).alias("entity"), T.tidy_entity_name(name).alias("name"))
        found.append(F.when(i_ok & n_ok & (ident != "") & (name != ""), F.array(one))
                     .otherwise(F.array().cast("array<struct<entity:string,name:string>>")))
    pairs = F.flatten(F.array(*found))
    return F.filter(F.array_distinct(pairs), lambda p: p["name"].isNotNull() & (F.length(p["name"]) > 1))


def extract_edges(logs: DataFrame, patterns: Sequence[dict], name_patterns: Sequence[dict] = (),
                  merge: str | None = None, builtin_ids: bool = True, indexed: bool | None = None) -> DataFrame:
    """Log lines to clean edges: ``log_idx, source_id, source_name, dest_id, dest_name, action, timestamp``.

    Log types without ids of their own (``builtin_ids=False``) carry the names in
    the name columns and leave the id columns null. ``merge`` is None, 'plain' or
    'smart'. One narrow stage throughout. ``indexed`` finds matches through the literal index (the default from
    ``INDEXED`` patterns on); both ways give the same edges where Java and Python read the expressions alike.
    """
    carry = [c for c in logs.columns if c != "line"]
    if indexed or indexed is None and len(patterns) >= INDEXED:
        found = with_edges(logs, order_patterns(patterns), "_m")
        raw = found.select(*logs.columns, tidy_edges(F.col("_m"), builtin_ids).alias("_e"))
    else:
        raw = logs.select("*", tidy_edges(match_patterns(F.col("line"), patterns), builtin_ids).alias("_e"))
    if merge:
        raw = raw.withColumn("_e", merge_repeats(F.col("_e"), merge == "smart"))
    if builtin_ids and name_patterns:
        raw = raw.withColumn("_n", name_pairs(F.col("line"), name_patterns))
        raw = raw.withColumn("_names", F.transform("_n", lambda p: p["name"]))
        raw = raw.withColumn("_e", final_checks(F.col("_e"), F.col("_names")))
    else:
        raw = raw.withColumn("_n", F.array().cast("array<struct<entity:string,name:string>>"))
        raw = raw.withColumn("_e", final_checks(F.col("_e"), None))
    rows = raw.withColumn("_e", without_end_actions(F.col("_e"))).select(
        *carry, "_n", F.explode_outer("_e").alias("_x")).filter("_x IS NOT NULL")

    def name_of(end: str) -> Column:
        hits = F.filter("_n", lambda p: p["entity"] == F.col(end))
        return F.when(F.size(hits) > 0, F.element_at(hits, -1)["name"]).otherwise("")

    null = F.lit(None).cast("string")
    ids = ([F.col("_x.src").alias("source_id"), name_of("_x.src").alias("source_name"),
            F.col("_x.dst").alias("dest_id"), name_of("_x.dst").alias("dest_name")] if builtin_ids else
           [null.alias("source_id"), F.col("_x.src").alias("source_name"), null.alias("dest_id"),
            F.col("_x.dst").alias("dest_name")])
    return rows.select(*carry, *ids, F.col("_x.action").alias("action"), T.strip_clock_half(F.col("_x.ts")).alias("timestamp"))


def match_with_python(logs: DataFrame, patterns: Sequence[dict]) -> DataFrame:
    """The matching step through the literal index and Python's ``re``: one row per edge (log_idx, src, dst, action, ts).

    Made for many patterns, and for expressions that Java cannot compile; tuples and several groups count as in
    ``match_patterns``. Rows stay in their input split.
    """
    found = with_edges(logs.select("log_idx", "line"), order_patterns(patterns))
    return found.select("log_idx", F.inline("_e"))


# --- CDM records ---------------------------------------------------------------------------

def cdm_nodes(logs: DataFrame, mode: str = "lenient", seq: str = "log_idx") -> DataFrame:
    """Node records (uuid, kind, property, node hash); the last record of a uuid wins.

    ``strict`` drops a record with any missing part, ``lenient`` writes 'null' for it.
    """
    line = F.col("line")
    prop = cdm.strict_property(line) if mode == "strict" else cdm.lenient_property(line)
    nodes = logs.filter(F.contains(line, F.lit(cdm.CDM)) & ~cdm.is_record(line, "Event"))
    rows = parsed_rows(nodes, [F.col(seq).alias("_seq")], ["uuid", "kind", "property"], uuid=cdm.node_uuid(line),
                       kind=cdm.node_kind(line), property=prop)
    last = first_rows(rows, ["uuid", "kind"], ["_seq"], last=True)
    return last.select("uuid", "kind", "property", F.sha2("property", 256).alias("node"), F.col("_seq").alias("seq"))


def cdm_events(logs: DataFrame) -> DataFrame:
    line = F.col("line")
    ev = logs.filter(cdm.is_record(line, "Event") & ~F.contains(line, F.lit("EVENT_FLOWS_TO")))
    fields = dict(ts_ns=cdm.timestamp_ns(line), subject=cdm.uuid_of(line, "subject"),
                  object=cdm.uuid_of(line, "predicateObject"), action=cdm.record_type(line))
    return parsed_rows(ev, ["log_idx"], list(fields), **fields)


def resolve_nodes(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Event ends to node hashes; an object is looked up as subject, file, then net flow, the last hit wins.

    Both joins have one row per uuid on the node side, so a hub uuid only makes a
    large stream partition, which adaptive execution splits.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in cdm.NODE_KINDS]), F.col("kind"))
    any_kind = nodes.groupBy(F.col("uuid").alias("object")).agg(
        F.max_by("node", rank).alias("dst"), F.max_by("kind", rank).alias("dst_kind"))
    subjects = nodes.filter("kind = 'Subject'").select(F.col("uuid").alias("subject"), F.col("node").alias("src"))
    return events.join(subjects, "subject").join(any_kind, "object")


def cdm_edges(logs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed, timed edges between node hashes; read-like events run from the object to the subject."""
    e = resolve_nodes(cdm_events(logs), nodes)
    back = F.col("action").isin(REVERSE_TYPES)
    return e.select("log_idx", F.when(back, F.col("dst")).otherwise(F.col("src")).alias("src"),
                    F.when(back, F.col("src")).otherwise(F.col("dst")).alias("dst"), "action", "ts_ns")


def cdm_node_types(logs: DataFrame, seq: str = "log_idx") -> DataFrame:
    """uuid and type of every node record; records without a type field take their record kind."""
    line = F.col("line")
    skip = F.lit(False)
    for k in cdm.NO_NODE_KINDS:
        skip = skip | F.contains(line, F.lit(cdm.CDM + k))
    kind = cdm.record_type(line)
    for k in cdm.UNTYPED_KINDS:
        kind = F.coalesce(kind, F.when(F.contains(line, F.lit(cdm.CDM + k)), F.lit(k)))
    rows = parsed_rows(logs.filter(~skip), [F.col(seq).alias("_seq")], ["uuid", "type"], uuid=cdm.node_uuid(line), type=kind)
    return rows.groupBy("uuid").agg(F.max_by("type", "_seq").alias("type"))


def typed_edges(logs: DataFrame, types: DataFrame) -> DataFrame:
    """One row per event object (an event may have two), with the types of both ends."""
    line = F.col("line")

    def real(key: str) -> Column:
        u = cdm.uuid_of(line, key)
        return F.when(u != "null", u)

    ev = parsed_rows(logs.filter(F.contains(line, F.lit(cdm.CDM + "Event"))), ["log_idx"], ["actor"],
                     actor=cdm.uuid_of(line, "subject"), action=cdm.record_type(line), ts_ns=cdm.timestamp_ns(line),
                     _o=F.array_compact(F.array(real("predicateObject"), real("predicateObject2"))))
    ev = ev.select("*", F.explode("_o").alias("object"))
    a = types.select(F.col("uuid").alias("actor"), F.col("type").alias("actor_type"))
    o = types.select(F.col("uuid").alias("object"), F.col("type").alias("object_type"))
    return ev.join(a, "actor").join(o, "object").select("log_idx", "actor", "actor_type", "object", "object_type", "action", "ts_ns")


def event_attributes(logs: DataFrame) -> DataFrame:
    """Command line and object path per (actor, object, action, time), from the full JSON."""
    uid = f"struct<`{cdm.CDM}UUID`:string>"
    schema = (f"struct<datum:struct<`{cdm.CDM}Event`:struct<subject:{uid},type:string,timestampNanos:bigint,"
              f"properties:struct<map:struct<cmdLine:string>>,predicateObject:{uid},predicateObjectPath:struct<string:string>,"
              f"predicateObject2:{uid},predicateObject2Path:struct<string:string>>>>")
    ev = F.from_json("line", schema)["datum"][cdm.CDM + "Event"]

    def target(r: Column, which: str) -> Column:
        return F.struct(r[which][cdm.CDM + "UUID"].alias("object"),
                        F.coalesce(r[which + "Path"]["string"], F.lit("")).alias("path"))

    rows = parsed_rows(logs.filter(F.contains(F.col("line"), F.lit("EVENT"))), [], ["ev"], ev=ev)
    rows = rows.select(
        F.col("ev.subject")[cdm.CDM + "UUID"].alias("actor"), F.col("ev.type").alias("action"),
        F.col("ev.timestampNanos").alias("ts_ns"), F.coalesce("ev.properties.map.cmdLine", F.lit("")).alias("exec"),
        F.inline(F.array(target(F.col("ev"), "predicateObject"), target(F.col("ev"), "predicateObject2"))))
    return rows.filter("actor IS NOT NULL AND object IS NOT NULL AND action IS NOT NULL")


def add_event_attributes(edges: DataFrame, logs: DataFrame) -> DataFrame:
    """Inner join of edges with their event attributes on all four keys, repeats dropped."""
    return edges.join(event_attributes(logs), ["actor", "object", "action", "ts_ns"]).dropDuplicates()
