"""Filters and text cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import actions, edge_text as T, names as N, times
from traceloom.operators import cleaning as C
from traceloom.operators import filters as B
from traceloom.plans.registry import query

EDGE_COLS = ["log_idx", "src", "dst", "action", "ts"]

# A log of the cleaning queries is a run of five consecutive records.
SQL_LOGS = "(SELECT *, log_idx // 5 AS log FROM dirty)"

PLAIN_FILTERS = [
    ("filter_timestamp", B.usable_timestamps,
     "upper(trim(ts)) NOT IN ('AM', 'PM') AND (trim(ts) = '...' OR (length(trim(ts)) >= 5 AND regexp_matches(ts, '[0-9]')))"),
    ("filter_action", B.usable_actions, "length(trim(action)) >= 3 AND NOT regexp_full_match(trim(action), '[0-9]+')"),
    ("filter_action_letters", B.lettered_actions, "regexp_matches(action, '[a-zA-Z]')"),
    ("filter_self_loop", B.no_self_loops, "rtrim(trim(src), ':') <> rtrim(trim(dst), ':')"),
    ("filter_integer_ends", B.no_integer_ends,
     "NOT regexp_full_match(rtrim(src, ':'), '[0-9]+') AND NOT regexp_full_match(rtrim(dst, ':'), '[0-9]+')"),
    ("filter_empty_ends", B.no_empty_ends, "trim(src) <> '' AND trim(dst) <> ''"),
    ("filter_near_equal_ends", B.no_near_equal_ends, "levenshtein(src, dst) <> 1"),
    ("filter_single_char_ends", B.no_single_char_ends, "length(trim(src)) <> 1 AND length(trim(dst)) <> 1"),
    ("filter_timestamp_action", B.action_not_timestamp,
     "NOT contains(ts, trim(action)) AND NOT contains(regexp_replace(ts, ':(AM|PM)$', ''), trim(action))"),
    ("filter_digit_id_pairs", B.digit_id_pairs, "regexp_matches(src, '[0-9]') AND regexp_matches(dst, '[0-9]') AND src <> dst"),
    ("filter_no_label", B.drop_no_label, "action <> 'NO LABEL'"),
    ("filter_noise_names", B.drop_noise_names,
     "upper(src) <> 'NONE' AND upper(dst) <> 'NONE' AND NOT regexp_full_match(src, '-?[0-9]+') AND NOT regexp_full_match(dst, '-?[0-9]+')"),
    ("filter_benign_text", lambda e: B.not_benign_text(e, "dst"),
     "NOT list_bool_or([contains(dst, x) for x in ['netflow', 'null', '/dev/pts', 'usr', 'proc', 'tmp']])"),
]
for _name, _fn, _cond in PLAIN_FILTERS:
    query(_name, f"SELECT log_idx, src, dst, action, ts FROM dirty WHERE {_cond}", "dirty")(
        lambda t, fn=_fn: fn(t.dirty.select(*EDGE_COLS)))


def _logs(t):
    return t.dirty.select(F.floor(F.col("log_idx") / 5).alias("log"), *EDGE_COLS)


@query("filter_action_is_end", f"""
SELECT log, log_idx, src, dst, action, ts FROM {SQL_LOGS} d WHERE NOT EXISTS
 (SELECT 1 FROM {SQL_LOGS} o WHERE o.log = d.log AND (o.src = d.action OR o.dst = d.action))""", "dirty")
def _(t):
    return B.action_not_an_end(_logs(t), "log")


@query("filter_entity_names", f"""
SELECT log, log_idx, src, dst, action, ts FROM {SQL_LOGS} d WHERE NOT EXISTS
 (SELECT 1 FROM named n WHERE n.event_id // 5 = d.log AND n.event_id % 2 = 0 AND n.obj IN (d.src, d.dst, d.action))""", "dirty named")
def _(t):
    names = t.named.filter("event_id % 2 = 0").select(F.floor(F.col("event_id") / 5).alias("log"), F.col("obj").alias("name"))
    return B.not_entity_names(_logs(t), names, "log")


@query("filter_entity_name_length", """
SELECT event_id AS log_idx, subj AS entity, n AS name FROM (SELECT *, CASE WHEN k % 9 = 0 THEN 'q' WHEN k % 11 = 0 THEN ' ' ELSE event_type END AS n
FROM named) WHERE trim(n) <> '' AND length(trim(n)) <> 1""", "named")
def _(t):
    n = F.when(F.col("k") % 9 == 0, "q").when(F.col("k") % 11 == 0, " ").otherwise(F.col("event_type"))
    return B.named_entities(t.named.select(F.col("event_id").alias("log_idx"), F.col("subj").alias("entity"), n.alias("name")))


@query("filter_edge_quality", f"""
SELECT log, log_idx, src, dst, action, ts FROM (SELECT *, bool_or(real) OVER (PARTITION BY log) AS dated FROM
 (SELECT *, trim(ts) NOT IN ('...', '.', '') AS real FROM {SQL_LOGS} WHERE length(trim(action)) > 1)) WHERE real OR NOT dated""", "dirty")
def _(t):
    return B.edge_quality(_logs(t), "log")


@query("no_label_counts", """
SELECT log_type, count(*) FILTER (action <> 'NO LABEL') AS kept, count(*) FILTER (action = 'NO LABEL') AS removed
FROM dirty GROUP BY log_type""", "dirty")
def _(t):
    return B.no_label_counts(t.dirty, "log_type")


VALIDITY = """(SELECT kind AS action, CASE WHEN count(*) % 2 = 0 THEN 'VALID' ELSE 'INVALID' END AS status FROM named
 WHERE kind <> 'EVENT_OPEN' GROUP BY kind)"""


def _validity(t):
    return (t.named.filter("kind <> 'EVENT_OPEN'").groupBy(F.col("kind").alias("action")).count()
            .select("action", F.when(F.col("count") % 2 == 0, "VALID").otherwise("INVALID").alias("status")))


@query("filter_valid_actions", f"""
SELECT e.log_idx, e.action FROM edges e LEFT JOIN {VALIDITY} v ON e.action = v.action WHERE coalesce(v.status, 'VALID') = 'VALID'""",
       "edges named")
def _(t):
    return B.valid_actions(t.edges.select("log_idx", "action"), _validity(t))


@query("filter_valid_edge_types", f"""
SELECT log_idx, action FROM edges WHERE lower(action) IN
 (SELECT lower(action) FROM (SELECT kind AS action FROM named WHERE kind IN ('EVENT_OPEN', 'EVENT_READ')))""", "edges named")
def _(t):
    v = t.named.groupBy(F.col("kind").alias("action")).count().select(
        "action", F.when(F.col("action").isin("EVENT_OPEN", "EVENT_READ"), "VALID").otherwise("INVALID").alias("status"))
    return B.valid_edge_types(t.edges.select("log_idx", "action"), v)


@query("filter_labelled_edge_types", """
SELECT log_idx, action FROM dirty WHERE action IS NOT NULL AND lower(action) NOT IN ('no label', 'no_label')""", "dirty")
def _(t):
    return B.valid_edge_types(t.dirty.select("log_idx", "action"), None)


PROCESSED_CLASS = """(SELECT name, CASE WHEN length(name) % 3 = 0 THEN 'INVALID' ELSE 'VALID' END AS class FROM
 (SELECT DISTINCT replace(lower(name), chr(92), '/') AS name FROM names) WHERE length(name) % 4 <> 0)"""


@query("filter_profile_names", f"""
SELECT n.name, c.class FROM (SELECT replace(lower(name), chr(92), '/') AS name FROM names) n JOIN {PROCESSED_CLASS} c ON n.name = c.name
WHERE c.class <> 'INVALID' OR NOT (length(regexp_replace(n.name, '[^\\pL]', '', 'g')) < 3 OR NOT contains(n.name, '/') OR NOT contains(n.name, '.'))""",
       "names")
def _(t):
    n = t.names.select(F.translate(F.lower("name"), "\\", "/").alias("name"))
    classes = n.distinct().filter(F.length("name") % 4 != 0).select(
        "name", F.when(F.length("name") % 3 == 0, "INVALID").otherwise("VALID").alias("class"))
    return B.profile_names(n, classes)


IP_SQL = """
(SELECT *, CASE WHEN regexp_matches(s, '^\\[.*\\]:') THEN regexp_extract(s, '^\\[(.*?)\\]:', 1)
     WHEN regexp_matches(s, '^(.*):[0-9]+$') AND NOT starts_with(s, 'http') THEN regexp_extract(s, '^(.*):[0-9]+$', 1) ELSE s END AS ip
 FROM (SELECT name, trim(name) AS s FROM names))"""


@query("is_ip_address", f"""
SELECT name, s <> '' AND (
  (regexp_full_match(ip, '([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}') AND list_bool_and([try_cast(o AS INT) <= 255 for o in string_split(ip, '.')]))
  OR contains(ip, '::') OR regexp_full_match(ip, '([0-9a-fA-F]{{0,4}}:){{2,7}}[0-9a-fA-F]{{0,4}}')
  OR (regexp_matches(s, '[.:]') AND length(regexp_replace(s, '[^\\pL]', '', 'g')) < 0.2 * length(s)
      AND length(regexp_replace(s, '[^0-9.:]', '', 'g')) > 0.7 * length(s))) AS is_ip FROM {IP_SQL}""", "names")
def _(t):
    return t.names.select("name", N.is_ip_address(F.col("name")).alias("is_ip"))


@query("filter_benign_edges", "SELECT id FROM scores WHERE y = 0", "scores")
def _(t):
    return B.benign_only(t.scores.select("id", F.col("y").alias("label"))).select("id")


@query("filter_frequent_actions", """
SELECT log_idx, line_no, dst, action FROM edges_big WHERE action IN
 (SELECT action FROM edges_big GROUP BY action HAVING count(*) >= 1000)""", "edges_big")
def _(t):
    return B.frequent_actions(t.edges_big.select("log_idx", "line_no", "dst", "action"), 1000)


WINDOW_NAME = "strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:00:00') || '_end'"


def _window_name():
    return F.concat(F.date_format(F.timestamp_seconds(times.seconds(F.col("ts_ns"))), "yyyy-MM-dd HH:00:00"), F.lit("_end"))


@query("filter_date_range", f"""
SELECT log_idx, w FROM (SELECT log_idx, CASE WHEN log_idx % 50 = 0 THEN 'bad name' ELSE {WINDOW_NAME} END AS w FROM edges)
WHERE w <> 'bad name' AND substr(w, 1, 10) BETWEEN '2024-01-05' AND '2024-01-20'""", "edges")
def _(t):
    w = F.when(F.col("log_idx") % 50 == 0, "bad name").otherwise(_window_name())
    return B.in_date_range(t.edges.select("log_idx", w.alias("w")), "w", "2024-01-05", "2024-01-20")


@query("filter_reverse_types", """
SELECT log_idx, action IN ('EVENT_READ', 'EVENT_READ_SOCKET_PARAMS', 'EVENT_RECVFROM', 'EVENT_RECVMSG') AS is_reverse FROM edges""",
       "edges")
def _(t):
    return t.edges.select("log_idx", F.col("action").isin(B.REVERSE_TYPES).alias("is_reverse"))


@query("filter_score_threshold", "SELECT id, score FROM scores WHERE score >= 89.218", "scores")
def _(t):
    return B.at_least(t.scores.select("id", "score"), "score", 89.218)


@query("filter_step_names", """
SELECT conv_id, turn, entity, name FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '- Step ' || turn ELSE 'U' || conv_id END AS entity,
 CASE WHEN turn % 3 = 0 THEN '**Step 1' ELSE role END AS name FROM answers) WHERE entity NOT LIKE '%- Step%' AND name NOT LIKE '%**Step%'""",
       "answers")
def _(t):
    a = t.answers.select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, F.concat(F.lit("- Step "), "turn"))
                         .otherwise(F.concat(F.lit("U"), "conv_id")).alias("entity"),
                         F.when(F.col("turn") % 3 == 0, "**Step 1").otherwise(F.col("role")).alias("name"))
    return B.drop_step_names(a)


# --- cleaners: one output column over the dirty edges ------------------------------------------

WS = r"[ \t\n]"
CLEANERS = [
    ("clean_integer_words", "action", T.drop_integer_words,
     "array_to_string([w for w in regexp_split_to_array(trim(action), '\\s+') if NOT regexp_full_match(w, '[0-9]+')], ' ')"),
    ("clean_record_prefix", "src", T.strip_record_prefix, "trim(regexp_replace(trim(src), '^(AAAA|A):', ''))"),
    ("clean_trailing_colons", "src", lambda c: T.rtrim_colons(T.trim_all(c)), "rtrim(trim(src), ':')"),
    ("clean_action_marks", "action", T.strip_action_marks,
     "regexp_replace(regexp_replace(action, '^[:\".][:\".\\s]*', ''), '[:\".\\s]*[:\".]$', '')"),
    ("clean_brackets", "action", T.unwrap_brackets,
     "CASE WHEN regexp_matches(action, '(?s)^\\[\\[.+\\]\\]$') THEN regexp_extract(action, '(?s)^\\[\\[(.*)\\]\\]$', 1) ELSE action END"),
    ("clean_uri_prefix", "src", T.strip_uri_prefix, "trim(regexp_replace(trim(src), '^uri=', ''))"),
    ("clean_http_action", "action", T.http_only, "CASE WHEN contains(lower(action), 'http') THEN 'http' ELSE action END"),
    ("clean_timestamp", "ts", T.tidy_timestamp,
     "CASE len(regexp_split_to_array(ts, '\\s+')) "
     "WHEN 3 THEN trim(regexp_replace(array_to_string(regexp_split_to_array(ts, '\\s+')[2:3], ' '), '^:', '')) "
     "WHEN 2 THEN regexp_replace(regexp_split_to_array(ts, '\\s+')[1], '^.*:', '') || ' ' || regexp_split_to_array(ts, '\\s+')[2] ELSE ts END"),
    ("clean_grouping_key", "dst", T.grouping_key,
     "CASE WHEN regexp_matches(dst, '[a-zA-Z]') THEN replace(regexp_replace(regexp_replace(dst, '^[:/\\\\][:/\\\\\\s]*', ''), "
     "'[:/\\\\\\s]*[:/\\\\]$', ''), '://', '') ELSE dst END"),
    ("clean_action_equals", "action", T.action_before_equals, "trim(split_part(action, '=', 1))"),
    ("clean_node_name", "action", actions.clean_node_name, "replace(replace(action, ' ', '_'), chr(9), '_')"),
]
for _name, _col, _fn, _sql in CLEANERS:
    query(_name, f"SELECT log_idx, {_col} AS raw, {_sql} AS cleaned FROM dirty", "dirty")(
        lambda t, col=_col, fn=_fn: t.dirty.select("log_idx", F.col(col).alias("raw"), fn(F.col(col)).alias("cleaned")))


@query("drop_empty_actions", """
SELECT log_idx, a AS action FROM (SELECT log_idx, array_to_string([w for w in regexp_split_to_array(trim(action), '\\s+')
 if NOT regexp_full_match(w, '[0-9]+')], ' ') AS a FROM dirty) WHERE a <> ''""", "dirty")
def _(t):
    return C.drop_integer_words(t.dirty.select("log_idx", "action"))


EDGE_LINE_SQL = """(SELECT log_idx, '(' || src || ', ' || dst || ') A: [' || action || '] {D=' ||
 CASE WHEN log_idx % 2 = 0 THEN '->' ELSE '<-' END || '} (timestamp=' || ts || ')' AS line FROM dirty)"""


def _edge_lines(t):
    return t.dirty.select("log_idx", F.concat(
        F.lit("("), "src", F.lit(", "), "dst", F.lit(") A: ["), "action", F.lit("] {D="),
        F.when(F.col("log_idx") % 2 == 0, "->").otherwise("<-"), F.lit("} (timestamp="), "ts", F.lit(")")).alias("line"))


RE = r"\(([^,]+),\s*([^)]+)\)\s*A:\s*\[([^\]]+)\]\s*\{D=([^}]+)\}\s*\(([^)]+)\)"


@query("parse_edge_lines", f"""
SELECT log_idx, regexp_matches(line, '{RE}') AS parse_ok, CASE WHEN d = '<-' THEN b ELSE a END AS src, CASE WHEN d = '<-' THEN a ELSE b END AS dst,
  act AS action, d AS direction, CASE WHEN ts IN ('...', 'NO TIMESTAMP') THEN 'NO TIMESTAMP' ELSE ts END AS ts_raw, act <> 'NO LABEL' AS has_label
FROM (SELECT *, trim(regexp_extract(line, '{RE}', 1)) AS a, trim(regexp_extract(line, '{RE}', 2)) AS b, trim(regexp_extract(line, '{RE}', 3)) AS act,
  trim(regexp_extract(line, '{RE}', 4)) AS d, trim(regexp_replace(regexp_extract(line, '{RE}', 5), '^timestamp=', '')) AS ts FROM {EDGE_LINE_SQL})""",
       "dirty")
def _(t):
    return C.parse_edge_lines(_edge_lines(t)).drop("line")


@query("format_edge_lines", """
SELECT log_idx, '(' || src || ', ' || dst || ') A: [' || trim(action, '"''') || '] {D=->} (timestamp=' ||
 CASE WHEN ts = '...' THEN '...' ELSE ts END || ')' AS line,
 CASE WHEN src <> '' THEN src || ' = ' || dst ELSE 'No Regex' END AS name_line FROM dirty""", "dirty")
def _(t):
    ts = F.when(F.col("ts") == "...", T.NO_TIMESTAMP).otherwise(F.col("ts"))
    return t.dirty.select("log_idx", T.format_edge_line(F.col("src"), F.col("dst"), F.col("action"), ts).alias("line"),
                          T.format_name_line(F.col("src"), F.col("dst")).alias("name_line"))


@query("split_multi_actions", """
SELECT log_idx, unnest(parts) AS action, (generate_subscripts(parts, 1) - 1)::BIGINT AS part_no FROM (SELECT log_idx, CASE
 WHEN contains(action, chr(10)) THEN flatten([CASE WHEN regexp_matches(l, ':(\\t+| {3,})')
     THEN [regexp_extract(l, '^(.*?):(\\t+| {3,})(.*)$', 1) || ':', regexp_extract(l, '^(.*?):(\\t+| {3,})(.*)$', 3)] ELSE [l] END
     for l in string_split(action, chr(10))])
 WHEN regexp_matches(action, '\\t| {3,}') THEN regexp_split_to_array(action, '\\t+| {3,}') ELSE [action] END AS parts FROM dirty)""", "dirty")
def _(t):
    return C.split_multi_actions(t.dirty.select("log_idx", "action"))


@query("split_colon_actions", """
SELECT log_idx, unnest(parts) AS action, (generate_subscripts(parts, 1) - 1)::BIGINT AS part_no FROM (SELECT log_idx, CASE WHEN contains(action, ':')
 THEN [x for x in [regexp_replace(p, '^\\s+|\\s+$', '', 'g') for p in string_split(action, ':')] if x <> ''] ELSE [action] END AS parts FROM dirty)""", "dirty")
def _(t):
    return C.split_colon_actions(t.dirty.select("log_idx", "action"))


@query("split_comma_actions", """
SELECT id, unnest(parts) AS action, (generate_subscripts(parts, 1) - 1)::BIGINT AS part_no FROM
 (SELECT event_id AS id, [kind || ' (a, b)', event_type, 'k' || k] AS parts FROM named)""", "named")
def _(t):
    a = F.concat(F.col("kind"), F.lit(" (a, b), "), F.col("event_type"), F.lit(",k"), F.col("k").cast("string"))
    return C.split_comma_actions(t.named.select(F.col("event_id").alias("id"), a.alias("action")))


@query("split_nested_actions", """
SELECT id, unnest(parts) AS action, (generate_subscripts(parts, 1) - 1)::BIGINT AS part_no FROM
 (SELECT event_id AS id, CASE WHEN k % 2 = 0 THEN [kind || ' (a, (b, (c, ' || k || ')), d)', event_type, '(k, (x)) y'] ELSE ['f(' || k || ') g', kind || '), z'] END
  AS parts FROM named)""", "named")
def _(t):
    k = F.col("k").cast("string")
    a = F.when(F.col("k") % 2 == 0, F.concat(F.col("kind"), F.lit(" (a, (b, (c, "), k, F.lit(")), d), "), F.col("event_type"), F.lit(" , (k, (x)) y,"))).otherwise(
        F.concat(F.lit("f("), k, F.lit(") g,"), F.col("kind"), F.lit("), z")))
    return C.split_comma_actions(t.named.select(F.col("event_id").alias("id"), a.alias("action")))


ACTION_TEXT = """(SELECT event_id AS id, CASE k % 14 WHEN 0 THEN 'A handle to an object was requested.' WHEN 1 THEN 'The handle to an object was Closed'
 WHEN 2 THEN 'An attempt was made to access an object' WHEN 3 THEN 'Accesses  ReadData (or ListDirectory)' WHEN 4 THEN 'HTTP' WHEN 5 THEN 'Main Thread'
 WHEN 6 THEN 'the handle to an object was duplicated' WHEN 7 THEN 'Accesses WRITE_DAC x' || k WHEN 8 THEN 'the Access  Mask is ' || k
 WHEN 9 THEN 'this is a very long action text about the ' || event_type || ' object number ' || k WHEN 10 THEN '' WHEN 11 THEN '!!'
 WHEN 12 THEN 'log: a handle to an object was opened ' || k ELSE event_type || '/' || k END AS action FROM ev)"""


def _action_text(t):
    k, e = F.col("k"), F.col("event_type")
    txt = (F.when(k % 14 == 0, "A handle to an object was requested.").when(k % 14 == 1, "The handle to an object was Closed")
           .when(k % 14 == 2, "An attempt was made to access an object").when(k % 14 == 3, "Accesses  ReadData (or ListDirectory)")
           .when(k % 14 == 4, "HTTP").when(k % 14 == 5, "Main Thread").when(k % 14 == 6, "the handle to an object was duplicated")
           .when(k % 14 == 7, F.concat(F.lit("Accesses WRITE_DAC x"), k)).when(k % 14 == 8, F.concat(F.lit("the Access  Mask is "), k))
           .when(k % 14 == 9, F.concat(F.lit("this is a very long action text about the "), e, F.lit(" object number "), k))
           .when(k % 14 == 10, "").when(k % 14 == 11, "!!")
           .when(k % 14 == 12, F.concat(F.lit("log: a handle to an object was opened "), k)).otherwise(F.concat(e, F.lit("/"), k)))
    return t.ev.select(F.col("event_id").alias("id"), txt.alias("action"))


_case = " ".join(f"WHEN regexp_matches(a, '{p}') THEN regexp_replace(a, '{p}', '{r.replace('$', chr(92))}', 'g')" for p, r in actions.ACTION_REWRITES)
_fill = ", ".join(f"'{w}'" for w in actions.FILLER_WORDS)


@query("normalize_action", f"""
WITH s AS (SELECT id, action, trim(regexp_replace(lower(action), '\\s+', ' ', 'g')) AS a FROM {ACTION_TEXT}),
r AS (SELECT id, action, CASE WHEN regexp_matches(a, ' (a|the) handle to an object was ') THEN 'handle_' || regexp_extract(a, 'was\\s+(\\w+)', 1)
   ELSE (CASE {_case} ELSE a END) END AS b FROM s),
c AS (SELECT id, action, CASE WHEN length(b) > 50 THEN array_to_string(([w for w in string_split(b, ' ') if w NOT IN ({_fill}) AND length(w) > 2])[1:5], '_')
   ELSE b END AS d FROM r),
f AS (SELECT id, action, trim(regexp_replace(regexp_replace(d, '[^a-z0-9_-]', '_', 'g'), '_+', '_', 'g'), '_') AS e FROM c)
SELECT id, action AS raw, CASE WHEN e = '' THEN 'unknown' ELSE rtrim(substr(e, 1, 50), '_') END AS action FROM f""", "ev")
def _(t):
    return _action_text(t).select("id", F.col("action").alias("raw"), actions.normalize_action(F.col("action")).alias("action"))


PATH_SQL = """
pth AS (SELECT name, regexp_replace(regexp_replace({src}, '\\\\+', '/', 'g'), '/+', '/', 'g') AS p FROM names),
known AS (SELECT DISTINCT '.' || lower(p_type) AS ext FROM part WHERE p_type LIKE '%E%'),
seg AS (SELECT *, regexp_matches(p, '[^./][^/]*\\.[^./]*$') AS is_file, regexp_extract(p, '([^/]*)$', 1) AS base,
   regexp_extract(p, '(\\.[^./]*)$', 1) AS ext FROM pth),
kept AS (SELECT *, CASE WHEN is_file AND length(ext) >= 6 AND lower(ext) NOT IN (SELECT ext FROM known)
   THEN regexp_replace(base, '\\.[^.]*$', '') ELSE base END AS kb FROM seg),
fin AS (SELECT *, CASE WHEN contains(kb, '.') THEN split_part(kb, '.', 1) ELSE kb END AS stem,
   CASE WHEN contains(kb, '.') THEN regexp_extract(kb, '^[^.]*(\\..*)$', 1) ELSE '' END AS tail FROM kept),
out AS (SELECT name, is_file, CASE WHEN is_file THEN array_to_string(list_concat(
     [x for x in [regexp_replace(regexp_replace(regexp_replace(s, '[0-9]+$', ''), '[-_][0-9]+', '', 'g'), '[0-9]+', '', 'g')
       for s in string_split(regexp_replace(p, '/?[^/]*$', ''), '/')] if x <> ''],
     [regexp_replace(regexp_replace(regexp_replace(stem, '[0-9]+$', ''), '[-_][0-9]+', '', 'g'), '[0-9]+', '', 'g') || tail]), '/')
   ELSE array_to_string([x for x in [regexp_replace(regexp_replace(regexp_replace(s, '[0-9]+$', ''), '[-_][0-9]+', '', 'g'), '[0-9]+', '', 'g')
       for s in string_split(p, '/')] if x <> ''], '/') END AS processed FROM fin)"""


def known_extensions(t):
    return t.read("part").filter(F.contains(F.col("p_type"), F.lit("E"))).select(
        F.concat(F.lit("."), F.lower("p_type")).alias("extension")).distinct()


@query("normalize_paths", "WITH " + PATH_SQL.format(src="name") + " SELECT name, processed FROM out", "names")
def _(t):
    return C.normalize_paths(t.names, known_extensions(t))


@query("normalize_names_lower", "WITH " + PATH_SQL.format(src="lower(name)") + " SELECT name, processed FROM out", "names")
def _(t):
    return C.normalize_paths(t.names, known_extensions(t), lower=True)


_host = "ltrim(lower(regexp_replace(regexp_replace(regexp_replace(name, '_[0-9]+$', ''), '\\\\+', '/', 'g'), '/+', '/', 'g')), '/')"
for _p, _r in N.HOST_REWRITES:
    _host = f"regexp_replace({_host}, '{_p}', '{_r}', 'g')"

HOST_NAMES = """(SELECT event_id AS id, CASE k % 8 WHEN 0 THEN 'C:\\Windows\\System32\\cmd' || k || '.exe_' || user_id WHEN 1 THEN 'chrome_' || user_id
 WHEN 2 THEN '-' WHEN 3 THEN 'connection_' || k WHEN 4 THEN '\\Device\\HarddiskVolume' || k || '\\Program_Files\\python' || k || '\\tcl8.6'
 WHEN 5 THEN '/syswow64/x/SysWOW64/v1.2.3_10.0.0.1_' WHEN 6 THEN 'x64_0123456789abcdef0123456789abcdef' ELSE 'amd64_app_0123456789abcdef' END AS name FROM ev)"""


@query("host_neutral_names", f"""
SELECT id, name AS raw, CASE WHEN name IN ('', '-', '-_0') THEN name WHEN regexp_full_match(name, '[A-Za-z]+_[0-9]+') THEN lower(regexp_replace(name, '_[0-9]+$', ''))
 WHEN starts_with(name, 'connection_') THEN name ELSE {_host} END AS name FROM {HOST_NAMES}""", "ev")
def _(t):
    k, u = F.col("k"), F.col("user_id").cast("string")
    name = (F.when(k % 8 == 0, F.concat(F.lit("C:\\Windows\\System32\\cmd"), k, F.lit(".exe_"), u))
            .when(k % 8 == 1, F.concat(F.lit("chrome_"), u)).when(k % 8 == 2, "-").when(k % 8 == 3, F.concat(F.lit("connection_"), k))
            .when(k % 8 == 4, F.concat(F.lit("\\Device\\HarddiskVolume"), k, F.lit("\\Program_Files\\python"), k, F.lit("\\tcl8.6")))
            .when(k % 8 == 5, "/syswow64/x/SysWOW64/v1.2.3_10.0.0.1_").when(k % 8 == 6, "x64_0123456789abcdef0123456789abcdef")
            .otherwise("amd64_app_0123456789abcdef"))
    d = t.ev.select(F.col("event_id").alias("id"), name.alias("raw"))
    return d.withColumn("name", N.host_neutral_name(F.col("raw")))


@query("name_prefixes", """
SELECT name, array_to_string([array_to_string((string_split(name, '/'))[1:i], '/') for i in range(1, len(string_split(name, '/')) + 1)], '') AS joined,
 len(string_split(name, '.'))::BIGINT AS dot_levels FROM names""", "names")
def _(t):
    return t.names.select("name", F.array_join(N.prefixes(F.col("name"), "/"), "").alias("joined"),
                          F.size(N.prefixes(F.col("name"), ".")).alias("dot_levels"))


@query("property_hash", "SELECT c_custkey AS id, sha256(c_name || ',' || c_mktsegment) AS h FROM customer")
def _(t):
    return t.read("customer").select(F.col("c_custkey").alias("id"), N.property_hash(F.concat_ws(",", "c_name", "c_mktsegment")).alias("h"))


@query("hex_to_decimal", """
SELECT event_id AS id, h AS raw, CASE WHEN starts_with(h, '0x') AND h <> '0xZZ' AND k % 3 = 0 THEN CAST(CAST(user_id * 1000 + k AS HUGEINT) * 18446744073709551616 + 255 AS VARCHAR)
 WHEN starts_with(h, '0x') AND h <> '0xZZ' THEN CAST(user_id * 1000 + k AS VARCHAR) ELSE h END AS value
FROM (SELECT *, CASE WHEN k % 10 = 0 THEN '0xZZ' WHEN k % 7 = 0 THEN 'plain' ELSE '0x' || lower(to_hex(user_id * 1000 + k)) || CASE WHEN k % 3 = 0 THEN '00000000000000ff' ELSE '' END END AS h FROM ev)""", "ev")
def _(t):
    h = (F.when(F.col("k") % 10 == 0, "0xZZ").when(F.col("k") % 7 == 0, "plain")
         .otherwise(F.concat(F.lit("0x"), F.lower(F.hex(F.col("user_id") * 1000 + F.col("k"))),
                             F.when(F.col("k") % 3 == 0, "00000000000000ff").otherwise(""))))
    return t.ev.select(F.col("event_id").alias("id"), h.alias("raw")).withColumn("value", N.hex_to_decimal(F.col("raw")))


@query("window_names", f"""
SELECT log_idx, w, replace(substr(w, 1, 13), ' ', '_') AS window_key, replace(replace(w, ' ', '_'), ':', '-') AS token
FROM (SELECT log_idx, {WINDOW_NAME} AS w FROM edges)""", "edges")
def _(t):
    return t.edges.select("log_idx", _window_name().alias("w")).select(
        "log_idx", "w", N.window_key_from_name(F.col("w")).alias("window_key"), N.window_name_token(F.col("w")).alias("token"))


@query("seed_ids", """
SELECT log_idx, 'S1_host_' || log_type || '_' || window_key || '_' || log_idx AS seed, 'S1_host' AS scenario, log_type,
 window_key AS window_name, log_idx AS log_pos FROM edges""", "edges")
def _(t):
    e = t.edges.select("log_idx", N.seed_id(F.lit("S1_host"), F.col("log_type"), F.col("window_key"), F.col("log_idx")).alias("seed"))
    return e.select("*", *[c.alias(n) for n, c in N.parse_seed_id(F.col("seed")).items()])


@query("seed_ids_any", """
SELECT log_idx, 'M1_h' || log_idx % 3 || '_' || kind || '_' || window_key || '_' || log_idx AS seed, 'M1_h' || log_idx % 3 AS scenario, kind AS log_type,
 window_key AS window_name, log_idx AS log_pos FROM (SELECT *, lower(replace(action, '_', '-')) || log_idx % 7 AS kind FROM edges)""", "edges")
def _(t):
    kind = F.concat(F.lower(F.replace("action", F.lit("_"), F.lit("-"))), (F.col("log_idx") % 7).cast("string"))
    host = F.concat(F.lit("M1_h"), (F.col("log_idx") % 3).cast("string"))
    e = t.edges.select("log_idx", N.seed_id(host, kind, F.col("window_key"), F.col("log_idx")).alias("seed"))
    return e.select("*", *[c.alias(n) for n, c in N.parse_seed_id(F.col("seed"), None).items()])


@query("entity_class", """
SELECT name, CASE WHEN regexp_matches(s, '[a-zA-Z]') THEN 'website_filename' WHEN regexp_matches(s, '[0-9]') AND contains(s, '.') AND contains(s, ':') THEN 'ip_with_port'
 WHEN regexp_matches(s, '[0-9]') AND contains(s, '.') THEN 'ip_no_port' WHEN regexp_matches(s, '[0-9]') THEN 'integer_only' ELSE 'unknown' END AS class
FROM (SELECT name, trim(name) AS s FROM names UNION ALL SELECT src, src FROM dirty)""", "names dirty")
def _(t):
    n = t.names.unionAll(t.dirty.select("src"))
    return n.select("name", N.entity_class(F.col("name")).alias("class"))


@query("mask_values", """
SELECT event_id AS id, regexp_replace(regexp_replace(regexp_replace(x, '[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}', '<UUID>', 'g'),
 '[0-9]{19}', '<TIMESTAMP>', 'g'), '[0-9]+', '<NUMBER>', 'g') AS template
FROM (SELECT event_id, '(' || upper(substr(md5(subj), 1, 8)) || '-0000-1111-ABCD-' || upper(substr(md5(obj), 1, 12)) || ', ' || obj || ') at ' || ts_ns AS x FROM named)""",
       "named")
def _(t):
    x = F.concat(F.lit("("), F.upper(F.substring(F.md5("subj"), 1, 8)), F.lit("-0000-1111-ABCD-"),
                 F.upper(F.substring(F.md5("obj"), 1, 12)), F.lit(", "), "obj", F.lit(") at "), F.col("ts_ns").cast("string"))
    return t.named.select(F.col("event_id").alias("id"), N.mask_values(x).alias("template"))


LIST_SQL = """(SELECT event_id AS id, CASE WHEN k % 12 = 0 THEN '[]' ELSE '[''Proc' || (k % 5) || ''', ''datum'', "File' || k || '", ''proc' || (k % 5) || ''']' END AS l FROM ev)"""


def _lists(t):
    k = F.col("k")
    txt = F.when(k % 12 == 0, "[]").otherwise(F.concat(
        F.lit("['Proc"), k % 5, F.lit("', 'datum', \"File"), k, F.lit("\", 'proc"), k % 5, F.lit("']")))
    return t.ev.select(F.col("event_id").alias("id"), txt.alias("l"))


@query("list_text", f"""
SELECT id, array_to_string(p, '|') AS parsed, CASE WHEN len(p) = 0 THEN 'unknown' ELSE array_to_string(list_sort(list_distinct([lower(x) for x in p])), '+') END AS vtype,
 CASE WHEN len(p) = 0 THEN '' ELSE (CASE WHEN length(p[3]) > length(p[1]) THEN p[3] ELSE p[1] END) END AS longest
FROM (SELECT id, [trim(x) for x in string_split(regexp_replace(trim(l, '[]'), '[''"]', '', 'g'), ',') if trim(x) <> ''] AS p FROM {LIST_SQL})""", "ev")
def _(t):
    p = _lists(t).select("id", N.parse_list(F.col("l")).alias("p"))
    return p.select("id", F.array_join("p", "|").alias("parsed"), N.compound_type(F.col("p")).alias("vtype"),
                    N.longest_name(F.col("p")).alias("longest"))


REPAIR_SQL = """(SELECT log_type AS file, log_idx, src AS source_id, CASE WHEN log_type = 'dns' OR log_idx % 4 = 0 THEN '' ELSE 'name ' || src END AS source_name,
 dst AS dest_id, CASE WHEN log_idx % 3 = 0 THEN ' ' ELSE 'name ' || dst END AS dest_name, action, ts_ns::VARCHAR AS timestamp FROM edges)"""


@query("repair_columns", f"""
SELECT file, log_idx, CASE WHEN trim(source_name) <> '' THEN source_name ELSE source_id END AS source_name,
 CASE WHEN trim(dest_name) <> '' THEN dest_name ELSE dest_id END AS dest_name, action, timestamp FROM {REPAIR_SQL}""", "edges")
def _(t):
    e = t.edges.select(
        F.col("log_type").alias("file"), "log_idx", F.col("src").alias("source_id"),
        F.when((F.col("log_type") == "dns") | (F.col("log_idx") % 4 == 0), "").otherwise(F.concat(F.lit("name "), "src")).alias("source_name"),
        F.col("dst").alias("dest_id"), F.when(F.col("log_idx") % 3 == 0, " ").otherwise(F.concat(F.lit("name "), "dst")).alias("dest_name"),
        "action", F.col("ts_ns").cast("string").alias("timestamp"))
    return C.repair_columns(e, "file")


@query("orient_edges", """
SELECT seq, CASE WHEN direction = '<-' THEN dst ELSE src END AS src, CASE WHEN direction = '<-' THEN src ELSE dst END AS dst FROM votes""", "votes")
def _(t):
    return C.orient(t.votes.select("seq", "src", "dst", "direction"), [("src", "dst")]).drop("direction")


@query("clean_pattern_text", """
SELECT event_id AS id, CASE k % 3 WHEN 0 THEN 'pid=(' || k || '\\d+)' WHEN 1 THEN 'uuid:(.*?)' ELSE 'none' END AS pattern, k % 3 <> 2 AS usable FROM ev""", "ev")
def _(t):
    k = F.col("k")
    raw = (F.when(k % 3 == 0, F.concat(F.lit(" pid=("), k, F.lit("\\d+)\n - NOT applicable here")))
           .when(k % 3 == 1, "uuid:(.*?) ''").otherwise("none"))
    d = t.ev.select(F.col("event_id").alias("id"), T.tidy_pattern(raw).alias("pattern"))
    return d.withColumn("usable", T.is_usable_pattern(F.col("pattern")))


@query("clean_answer_pattern", """
SELECT event_id AS id, 'id\\s(' || k || ')' AS pattern FROM ev""", "ev")
def _(t):
    raw = F.concat(F.lit("- \"`id\\\\\\\\s("), F.col("k").cast("string"), F.lit(")é`\""))
    return t.ev.select(F.col("event_id").alias("id"), T.tidy_answer_pattern(raw).alias("pattern"))


NAME_TEXT = """(SELECT event_id AS id, k, CASE k % 7 WHEN 0 THEN 'C:\\app\\a.exe' || k WHEN 1 THEN chr(10) || '  first ' || k || chr(10) || 'second'
  WHEN 2 THEN 'Object Name:' || chr(9) || 'C:\\dir\\f' || k WHEN 3 THEN 'C:\\x' || k || ':C:\\x' || k || chr(9) || 'tail'
  WHEN 4 THEN 'label: value' || k || '    other' WHEN 5 THEN 'quoted' || k || '" "' ELSE '"' END AS raw FROM ev)"""


@query("tidy_entity_names", f"""
SELECT id, CASE k % 7 WHEN 0 THEN raw WHEN 1 THEN 'first ' || k WHEN 2 THEN 'C:\\dir\\f' || k WHEN 3 THEN 'C:\\x' || k WHEN 4 THEN 'value' || k
 WHEN 5 THEN 'quoted' || k ELSE NULL END AS name FROM {NAME_TEXT}""", "ev")
def _(t):
    k = F.col("k").cast("string")
    m = F.col("k") % 7
    raw = (F.when(m == 0, F.concat(F.lit("C:\\app\\a.exe"), k)).when(m == 1, F.concat(F.lit("\n  first "), k, F.lit("\nsecond")))
           .when(m == 2, F.concat(F.lit("Object Name:\tC:\\dir\\f"), k))
           .when(m == 3, F.concat(F.lit("C:\\x"), k, F.lit(":C:\\x"), k, F.lit("\ttail")))
           .when(m == 4, F.concat(F.lit("label: value"), k, F.lit("    other")))
           .when(m == 5, F.concat(F.lit("quoted"), k, F.lit('" "'))).otherwise('"'))
    return t.ev.select(F.col("event_id").alias("id"), T.tidy_entity_name(raw).alias("name"))


@query("ids_from_type_lines", """
SELECT conv_id, turn, 'U' || (conv_id % 150) || ' ' AS entity FROM answers""", "answers")
def _(t):
    return C.ids_from_type_lines(t.answers.select("conv_id", "turn", F.regexp_extract("text", r"(?s)Final Output(.*?)\(U1", 1).alias("x")), "x").drop("x")


@query("edge_sentences", """
SELECT e.log_idx, coalesce(s.vtype || ' ' || s.functionality, e.src) || ' --' || e.action || '--> ' || coalesce(d.vtype || ' ' || d.functionality, e.dst) AS sentence
FROM edges e LEFT JOIN types s ON e.src = s.node LEFT JOIN types d ON e.dst = d.node""", "edges types")
def _(t):
    names = t.types.select("node", F.array("vtype", "functionality").alias("names"))
    return C.edge_sentences(t.edges.select("log_idx", "src", "dst", "action"), names).select("log_idx", "sentence")
