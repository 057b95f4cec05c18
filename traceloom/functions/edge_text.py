"""Column expressions that clean and test one provenance edge.

Every function takes and returns Columns, so the same rule works on a flat edge
table and inside a lambda over an array of edge structs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed text of the edge line format.
EDGE_LINE = r"\(([^,]+),\s*([^)]+)\)\s*A:\s*\[([^\]]+)\]\s*\{D=([^}]+)\}\s*\(([^)]+)\)"
NO_LABEL = "NO LABEL"
NO_TIMESTAMP = "NO TIMESTAMP"
UNKNOWN_TS = "..."


def trim_all(c: Column) -> Column:
    """Trim every kind of blank, as log text holds tabs and newlines."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def rtrim_colons(c: Column) -> Column:
    return F.regexp_replace(c, ":+$", "")


# --- predicates: true means the edge stays -------------------------------------------------

def has_usable_timestamp(ts: Column) -> Column:
    t = trim_all(ts)
    return (~F.upper(t).isin("AM", "PM")) & ((t == UNKNOWN_TS) | ((F.length(t) >= 5) & t.rlike(r"\d")))


def has_usable_action(action: Column) -> Column:
    a = trim_all(action)
    return (F.length(a) >= 3) & ~a.rlike(r"^\d+$")


def has_letter(action: Column) -> Column:
    return action.rlike("[a-zA-Z]")


def not_self_loop(src: Column, dst: Column) -> Column:
    return rtrim_colons(trim_all(src)) != rtrim_colons(trim_all(dst))


def ends_not_integer(src: Column, dst: Column) -> Column:
    def digits(c: Column) -> Column:
        return rtrim_colons(trim_all(c)).rlike(r"^\d+$")
    return ~digits(src) & ~digits(dst)


def ends_not_empty(src: Column, dst: Column) -> Column:
    return (trim_all(src) != "") & (trim_all(dst) != "")


def ends_not_near_equal(src: Column, dst: Column) -> Column:
    """Drop ends exactly one edit apart."""
    return F.levenshtein(src, dst) != 1


def ends_not_single_char(src: Column, dst: Column) -> Column:
    return (F.length(trim_all(src)) != 1) & (F.length(trim_all(dst)) != 1)


def action_not_in_timestamp(action: Column, ts: Column) -> Column:
    a, t = trim_all(action), trim_all(ts)
    bare = trim_all(F.regexp_replace(t, ":(AM|PM)$", ""))
    return ~(F.contains(bare, a) | F.contains(t, a))


def ids_have_digits_and_differ(a: Column, b: Column) -> Column:
    return a.rlike(r"\d") & b.rlike(r"\d") & (a != b)


def is_real_timestamp(ts: Column) -> Column:
    return F.coalesce(~trim_all(ts).isin("...", ".", ""), F.lit(False))


def is_noise_name(name: Column) -> Column:
    """'NONE' and whole-integer names, which carry no entity."""
    return (F.upper(name) == "NONE") | trim_all(name).rlike(r"^-?\d+$")


# --- cleaners ------------------------------------------------------------------------------

def strip_record_prefix(c: Column) -> Column:
    """Drop a leading DNS record type ('A:' or 'AAAA:')."""
    return trim_all(F.regexp_replace(trim_all(c), r"^(?:AAAA|A):", ""))


def strip_uri_prefix(c: Column) -> Column:
    return trim_all(F.regexp_replace(trim_all(c), "^uri=", ""))


def strip_action_marks(c: Column) -> Column:
    return F.regexp_replace(trim_all(c), r'^[:".][:".\s]*|[:".\s]*[:".]$', "")


def drop_integer_words(c: Column) -> Column:
    words = F.split(trim_all(c), r"\s+")
    return F.array_join(F.filter(words, lambda w: ~w.rlike(r"^\d+$")), " ")


def http_only(c: Column) -> Column:
    return F.when(F.contains(F.lower(c), F.lit("http")), F.lit("http")).otherwise(c)


def unwrap_brackets(c: Column) -> Column:
    """Remove matching outer brackets, as many as wrap a non-empty text."""
    a = trim_all(c)
    depth = F.length(F.regexp_replace(F.regexp_extract(a, r"^((?:\[\s*)*)", 1), r"\s", ""))

    def peel(acc: Column, _: Column) -> Column:
        inner = trim_all(F.regexp_extract(acc, r"(?s)^\[(.*)\]$", 1))
        return F.when(acc.rlike(r"(?s)^\[.*\]$") & (inner != ""), inner).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), a, peel)


def tidy_timestamp(c: Column) -> Column:
    """Cut tokens glued in front of a clock time."""
    t = trim_all(c)
    p = F.split(t, r"\s+")
    head = F.get(p, F.lit(0))
    last_two = F.concat_ws(" ", F.get(p, F.lit(1)), F.get(p, F.lit(2)))
    two = F.concat_ws(" ", F.regexp_replace(head, "^.*:", ""), F.get(p, F.lit(1)))
    return (F.when(F.size(p) == 3, trim_all(F.regexp_replace(last_two, "^:", "")))
            .when(F.size(p) == 2, trim_all(two))
            .otherwise(t))


def strip_clock_half(c: Column) -> Column:
    return trim_all(F.regexp_replace(trim_all(c), ":(AM|PM)$", ""))


def grouping_key(c: Column) -> Column:
    """Normal form of a URL-like end, used only to find repeats."""
    s = trim_all(c)
    body = F.regexp_replace(s, r"^[:/\\][:/\\\s]*|[:/\\\s]*[:/\\]$", "")
    return F.when(s.rlike("[a-zA-Z]"), trim_all(F.replace(body, F.lit("://"), F.lit("")))).otherwise(s)


def action_lines(c: Column) -> Column:
    """Split a multi-line or column-gapped action into its parts (array)."""
    def tidy(parts: Column) -> Column:
        return F.filter(F.transform(parts, trim_all), lambda x: x != "")

    def at_gap(part: Column) -> Column:
        bits = F.split(part, r":(?:\t+| {3,})", 2)
        left = F.regexp_replace(trim_all(bits[0]), ":$", "")
        halves = F.array(F.concat(left, F.lit(":")), trim_all(F.get(bits, F.lit(1))))
        return F.when(F.size(bits) == 2, F.filter(halves, lambda x: x != "")).otherwise(F.array(part))

    lines = F.flatten(F.transform(tidy(F.split(c, "\n")), at_gap))
    gaps = tidy(F.split(c, r"\t+| {3,}"))
    return F.when(F.contains(c, F.lit("\n")), lines).when(c.rlike(r"\t| {3,}"), gaps).otherwise(F.array(c))


def colon_parts(c: Column) -> Column:
    """Split an action at every colon (array of non-empty parts)."""
    parts = F.filter(F.transform(F.split(c, ":"), trim_all), lambda x: x != "")
    return F.when(F.contains(c, F.lit(":")), parts).otherwise(F.array(c))


def comma_parts(c: Column) -> Column:
    """Split at commas outside parentheses, whatever their depth (array of non-empty parts).

    A fold over brackets, commas and the text between them; its state is the depth, the piece so far and the pieces before. A
    closing bracket without an opening one leaves the depth below zero, where nothing is split.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("piece"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, t: Column) -> Column:
        ends = (t == ",") & (s["depth"] == 0)
        return F.struct((s["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).alias("depth"),
                        F.when(ends, "").otherwise(F.concat(s["piece"], t)).alias("piece"),
                        F.when(ends, F.concat(s["parts"], F.array(s["piece"]))).otherwise(s["parts"]).alias("parts"))

    tokens = F.regexp_extract_all(c, F.lit(r"[^(),]+|[(),]"), F.lit(0))
    parts = F.aggregate(tokens, start, step, lambda s: F.concat(s["parts"], F.array(s["piece"])))
    return F.filter(F.transform(parts, trim_all), lambda x: x != "")


def action_before_equals(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("=")), trim_all(F.get(F.split(c, "="), F.lit(0)))).otherwise(c)


# --- edge line text ------------------------------------------------------------------------

def parse_edge_line(line: Column) -> dict[str, Column]:
    """Fields of one edge line; ``parse_ok`` is false when the line has another form."""
    def part(i: int) -> Column:
        return trim_all(F.regexp_extract(line, EDGE_LINE, i))
    ts = trim_all(F.regexp_replace(part(5), "^timestamp=", ""))
    ok = line.rlike(EDGE_LINE)
    back = part(4) == "<-"
    return {
        "parse_ok": ok,
        "src": F.when(back, part(2)).otherwise(part(1)),
        "dst": F.when(back, part(1)).otherwise(part(2)),
        "action": part(3),
        "direction": part(4),
        "ts_raw": F.when(ts.isin(UNKNOWN_TS, NO_TIMESTAMP), F.lit(NO_TIMESTAMP)).otherwise(ts),
        "has_label": part(3) != NO_LABEL,
    }


def format_edge_line(src: Column, dst: Column, action: Column, ts: Column) -> Column:
    def unquote(c: Column) -> Column:
        return F.regexp_replace(F.coalesce(c, F.lit("")), "^[\"']+|[\"']+$", "")
    a = F.when(action.isNull() | (action == NO_LABEL), F.lit(NO_LABEL)).otherwise(unquote(action))
    t = F.when(ts.isNull() | (ts == NO_TIMESTAMP), F.lit(UNKNOWN_TS)).otherwise(ts)
    return F.format_string("(%s, %s) A: [%s] {D=->} (timestamp=%s)", unquote(src), unquote(dst), a, t)


def format_name_line(entity: Column, name: Column) -> Column:
    """``id = name``, or the fixed 'No Regex' when either part is missing."""
    ok = (F.coalesce(entity, F.lit("")) != "") & (F.coalesce(name, F.lit("No Regex")) != "No Regex")
    return F.when(ok, F.concat_ws(" = ", entity, name)).otherwise(F.lit("No Regex"))


def tidy_entity_name(name: Column) -> Column:
    """Bring an extracted entity name to one clean token; null when nothing is left."""
    lines = F.filter(F.transform(F.split(trim_all(name), "\n"), trim_all), lambda x: x != "")
    one = F.get(lines, F.lit(0))
    parts = F.filter(F.transform(F.split(one, r"\t+| {3,}"), trim_all), lambda x: x != "")
    drive = r"[A-Za-z]:\\"

    def resolve(p: Column) -> Column:
        twin = rf"^({drive}[^:]+):({drive}[^:]+)$"
        return (F.when(p.rlike(twin), trim_all(F.regexp_extract(p, twin, 2)))
                .when(~F.contains(p, F.lit(":")) | p.rlike("^[A-Za-z]?:[^:]*$"), p)
                .otherwise(trim_all(F.regexp_replace(p, "^.*:", ""))))

    heads = F.filter(parts, lambda p: ~p.endswith(":") | p.rlike(drive))
    first = resolve(F.get(heads, F.lit(0)))
    rest = F.filter(F.reverse(parts), lambda p: ~(p.endswith(":") & ~p.rlike(r"[\p{Alnum}\\/].*:$")))
    many = F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(F.get(rest, F.lit(0)))
    gapped = one.rlike(r"\t| {3,}")
    got = (F.when(~gapped, one)
           .when(F.size(parts) >= 2, many)
           .otherwise(resolve(F.get(parts, F.lit(0)))))
    bare = F.regexp_replace(trim_all(got), '(?:"\\s*)+$', "")
    return F.when(bare != "", bare)


def tidy_pattern(c: Column) -> Column:
    """Clean stored pattern text: line breaks, 'NOT APPLICABLE' tails, stray quotes."""
    s = F.regexp_replace(c, r"[\n\r]", "")
    s = F.regexp_replace(s, r"(?i)\s*-\s*NOT\s+APPLICABLE.*$", "")
    return trim_all(F.regexp_replace(s, r"\s*'+\s*$", ""))


def tidy_answer_pattern(c: Column) -> Column:
    """Clean a pattern taken from an answer: bullets, quotes, back-ticks, doubled slashes."""
    s = F.regexp_replace(trim_all(c), "^[-•*]\\s*", "")
    s = F.regexp_replace(s, "(?s)^([\"'])(.*)\\1$", "$2")
    s = F.regexp_replace(s, "^`+|`+$", "")
    s = F.translate(s, "｛｝", "{}")
    s = F.regexp_replace(s, r"\\+", r"\\")
    return trim_all(F.regexp_replace(s, r"[^\x20-\x7e]", ""))


def is_usable_pattern(c: Column) -> Column:
    t = trim_all(c)
    shaped = (F.contains(c, F.lit("(")) & F.contains(c, F.lit(")"))) | c.rlike(r"[\[\]{}\\+*?^$.]")
    named = t.rlike("^(Name:|ID:|REGEX:)")
    repeats = F.regexp_count(c, F.lit("REGEX:")) > 1
    words = F.lower(c).isin("not applicable", "none", "null", "no regex")
    return F.coalesce((c != "") & ~words & shaped & (F.length(c) >= 3) & ~named & ~repeats, F.lit(False))
