"""Row filters over edges, names and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions import edge_text as T
from traceloom.functions import names as N
from traceloom.operators.common import with_group_stats

# Event types whose data flows from the object to the subject.
REVERSE_TYPES = ["EVENT_READ", "EVENT_READ_SOCKET_PARAMS", "EVENT_RECVFROM", "EVENT_RECVMSG"]


def usable_timestamps(e: DataFrame, ts: str = "ts") -> DataFrame:
    return e.filter(T.has_usable_timestamp(F.col(ts)))


def usable_actions(e: DataFrame) -> DataFrame:
    return e.filter(T.has_usable_action(F.col("action")))


def lettered_actions(e: DataFrame) -> DataFrame:
    return e.filter(T.has_letter(F.col("action")))


def no_self_loops(e: DataFrame) -> DataFrame:
    return e.filter(T.not_self_loop(F.col("src"), F.col("dst")))


def no_integer_ends(e: DataFrame) -> DataFrame:
    return e.filter(T.ends_not_integer(F.col("src"), F.col("dst")))


def no_empty_ends(e: DataFrame) -> DataFrame:
    return e.filter(T.ends_not_empty(F.col("src"), F.col("dst")))


def no_near_equal_ends(e: DataFrame) -> DataFrame:
    return e.filter(T.ends_not_near_equal(F.col("src"), F.col("dst")))


def no_single_char_ends(e: DataFrame) -> DataFrame:
    return e.filter(T.ends_not_single_char(F.col("src"), F.col("dst")))


def action_not_timestamp(e: DataFrame, ts: str = "ts") -> DataFrame:
    return e.filter(T.action_not_in_timestamp(F.col("action"), F.col(ts)))


def action_not_an_end(e: DataFrame, log: str = "log_idx") -> DataFrame:
    """Drop edges whose action is the source or target of any edge of the same log."""
    ends = e.select(log, F.explode(F.array("src", "dst")).alias("action")).distinct()
    return e.join(ends, [log, "action"], "left_anti").select(*e.columns)


def not_entity_names(e: DataFrame, names: DataFrame, log: str = "log_idx") -> DataFrame:
    """Drop edges with an end or action equal to an entity name found in the same log."""
    found = names.filter(F.trim("name") != "").select(log, F.trim("name").alias("_name")).distinct()
    for c in ("src", "dst", "action"):
        e = e.join(found.withColumnRenamed("_name", c), [log, c], "left_anti").select(*e.columns)
    return e


def named_entities(names: DataFrame) -> DataFrame:
    """Drop entity names of one character (and rows without a name)."""
    return names.filter((F.coalesce(F.trim("name"), F.lit("")) != "") & (F.length(F.trim("name")) != 1))


def digit_id_pairs(e: DataFrame) -> DataFrame:
    return e.filter(T.ids_have_digits_and_differ(F.col("src"), F.col("dst")))


def edge_quality(e: DataFrame, graph: str, ts: str = "ts") -> DataFrame:
    """Within a graph, prefer edges with a real timestamp once any edge has one."""
    ok = e.filter(F.length(T.trim_all(F.col("action"))) > 1).withColumn("_real", T.is_real_timestamp(F.col(ts)))
    ok = with_group_stats(ok, [graph], F.max("_real").alias("_any"))
    return ok.filter(F.col("_real") | ~F.col("_any")).drop("_real", "_any")


def drop_no_label(e: DataFrame) -> DataFrame:
    return e.filter(F.col("action") != T.NO_LABEL)


def no_label_counts(e: DataFrame, *by: str) -> DataFrame:
    """Kept and removed edges per group for :func:`drop_no_label`."""
    gone = F.col("action") == T.NO_LABEL
    return e.groupBy(*by).agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("removed"))


def valid_actions(e: DataFrame, validity: DataFrame | None) -> DataFrame:
    """Keep actions that the lookup (action, status) calls VALID or does not know."""
    e = drop_no_label(e)
    if validity is None:
        return e
    v = validity.select("action", F.col("status").alias("_st"))
    return e.join(v, "action", "left").filter(F.coalesce("_st", F.lit("VALID")) == "VALID").select(*e.columns)


def valid_edge_types(e: DataFrame, validity: DataFrame | None) -> DataFrame:
    """Keep edges whose lower-cased action is a VALID type, or any labelled action without a lookup."""
    if validity is None:
        return e.filter(F.col("action").isNotNull() & ~F.lower("action").isin("no label", "no_label"))
    ok = validity.filter("status = 'VALID'").select(F.lower("action").alias("_a")).distinct()
    return e.join(ok, F.lower(e["action"]) == ok["_a"], "left_semi")


def profile_names(names: DataFrame, validity: DataFrame) -> DataFrame:
    """Names kept for profiling; ``names.name`` is joined to ``validity(name, class)``."""
    n = names.join(validity.select("name", "class"), "name")
    letters = F.length("name") - F.length(F.regexp_replace("name", r"\p{L}", ""))
    weak = (letters < 3) | ~F.contains(F.col("name"), F.lit("/")) | ~F.contains(F.col("name"), F.lit("."))
    return n.filter((F.col("class") != "INVALID") | ~weak)


def without_addresses(names: DataFrame) -> DataFrame:
    return names.filter(~N.is_ip_address(F.col("name")))


def not_benign_text(df: DataFrame, text: str, kind: str = "default") -> DataFrame:
    return df.filter(~N.has_benign_keyword(F.col(text), kind))


def benign_only(e: DataFrame) -> DataFrame:
    return e.filter("label = 0")


def frequent_actions(e: DataFrame, floor: int = 1000) -> DataFrame:
    """Keep actions seen at least ``floor`` times over the whole input."""
    often = e.groupBy("action").count().filter(F.col("count") >= floor).select("action")
    return e.join(often, "action", "left_semi")


def in_date_range(df: DataFrame, window_name: str, first: str | None, last: str | None) -> DataFrame:
    """Keep windows whose start day lies in [first, last]; malformed names are skipped."""
    if not first and not last:
        return df
    day = F.regexp_extract(window_name, r"^(\d{4}-\d{2}-\d{2})[ _]", 1).try_cast("date")
    cond = day.isNotNull()
    if first:
        cond = cond & (day >= F.lit(first).cast("date"))
    if last:
        cond = cond & (day <= F.lit(last).cast("date"))
    return df.filter(cond)


def at_least(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.filter(F.col(score) >= threshold)


def drop_noise_names(e: DataFrame) -> DataFrame:
    """Drop resolved edges with a 'NONE' or whole-integer end."""
    return e.filter(~T.is_noise_name(F.col("src")) & ~T.is_noise_name(F.col("dst")))


def drop_step_names(names: DataFrame) -> DataFrame:
    """Drop name rows that are left-over reasoning text instead of entities."""
    bad_id = F.col("entity").contains("**Step") | F.col("entity").contains("- Step") | F.col("entity").rlike(r'^"?-|\\"')
    return names.filter(~bad_id & ~F.col("name").contains("**Step"))
