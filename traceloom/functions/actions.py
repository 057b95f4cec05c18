"""Normal form of an action text: a short lower-case token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rewrites, the first pattern found wins.
ACTION_REWRITES = [
    (r"the handle to an object was closed", "handle_closed"),
    (r"a handle to an object was requested", "handle_requested"),
    (r"a handle to an object was (\w+)", r"handle_$1"),
    (r"the handle to an object was (\w+)", r"handle_$1"),
    (r"an attempt was made to access an object", "access_attempt"),
    (r"an attempt was made to access", "access_attempt"),
    (r"an object was deleted", "object_deleted"),
    (r"accesses readdata \(or listdirectory\)", "read_data"),
    (r"accesses readdata", "read_data"),
    (r"readdata \(or listdirectory\)", "read_data"),
    (r"readdata", "read_data"),
    (r"accesses read_control", "read_control"),
    (r"accesses synchronize", "synchronize"),
    (r"accesses readattributes", "read_attributes"),
    (r"accesses execute/traverse", "execute"),
    (r"accesses execute", "execute"),
    (r"^http$", "http"),
    (r"^connect$", "connect"),
    (r"^outbound$", "outbound"),
    (r"^inbound$", "inbound"),
    (r"^transport$", "transport"),
    (r"^main thread$", "main_thread"),
    (r"^accesses\s+(.+)$", r"$1"),
    (r".*access\s+mask.*", "access_mask"),
    (r".*access\s+reasons.*", "access_reasons"),
]

# Words dropped from an over-long action.
FILLER_WORDS = ["an", "a", "the", "to", "was", "were", "is", "are", "of", "in", "on", "at", "for", "and", "or",
                "object", "handle"]
MAX_LEN = 50


def _token(c: Column) -> Column:
    c = F.regexp_replace(c, "[^a-z0-9_-]", "_")
    return F.regexp_replace(F.regexp_replace(c, "_+", "_"), "^_+|_+$", "")


def normalize_action(action: Column) -> Column:
    """Lower-case token of at most 50 characters; 'unknown' when nothing is left."""
    text = F.regexp_replace(F.lower(F.trim(F.regexp_replace(action, r"\s+", " "))), r"^\s+|\s+$", "")
    # One array element per stage keeps each stage evaluated once for the next.
    def stage(value: Column, fn) -> Column:
        return F.get(F.transform(F.array(value), fn), F.lit(0))

    def rewrite(a: Column) -> Column:
        out = None
        for pattern, repl in ACTION_REWRITES:
            hit = F.regexp_replace(a, pattern, repl)
            out = F.when(a.rlike(pattern), hit) if out is None else out.when(a.rlike(pattern), hit)
        return out.otherwise(a)

    def shorten(a: Column) -> Column:
        keep = F.filter(F.split(a, r"\s+"), lambda w: ~w.isin(FILLER_WORDS) & (F.length(w) > 2))
        return (F.when((F.length(a) > MAX_LEN) & (F.size(keep) > 0), F.array_join(F.slice(keep, 1, 5), "_"))
                .otherwise(a))

    def clip(a: Column) -> Column:
        return F.when(F.length(a) > MAX_LEN, F.regexp_replace(F.substring(a, 1, MAX_LEN), "_+$", "")).otherwise(a)

    handle = r" (?:a|the) handle to an object was "
    verb = F.concat(F.lit("handle_"), F.regexp_extract(text, r"was\s+(\w+)", 1))
    general = stage(stage(stage(stage(text, rewrite), shorten), _token), clip)
    out = F.when(text.rlike(handle) & text.rlike(r"was\s+\w"), _token(verb)).otherwise(general)
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit("unknown")).otherwise(out)


def clean_node_name(name: Column) -> Column:
    return F.translate(F.coalesce(name, F.lit("")), " \t", "__")
