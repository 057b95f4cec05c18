"""Aggregations over edges, names and answers, and set operations on windows.

All of them combine on the map side. Where a value list is collected, the list is
part of the result (the actions of one edge in one log, the types of one node).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import edge_text as T
from traceloom.functions import names as N
from traceloom.operators.common import first_rows, with_group_stats
from traceloom.operators.ordered import row_index


def _non_blank(c: Column) -> Column:
    return F.filter(c, lambda a: F.coalesce(F.trim(a), F.lit("")) != "")


def merge_duplicate_edges(e: DataFrame, seq: str, include_log_type: bool = False) -> DataFrame:
    """One row per log and pair of ends: actions joined in order, label 1 if any, other columns of the first row.

    The default key has no log type, so equal log numbers of two log types merge.
    """
    keys = ["log_idx", "source_id", "source_name", "dest_id", "dest_name"] + (["log_type"] if include_log_type else [])
    keys = [k for k in keys if k in e.columns]
    e = e.na.fill("", [k for k in keys if k != "log_idx"])
    rest = [c for c in e.columns if c not in keys and c not in ("action", "label", seq)]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq), F.trim("action").alias("a")))), lambda s: s["a"])
    aggs = [F.array_join(_non_blank(ordered), " ").alias("action")]
    if "label" in e.columns:
        aggs.append(F.max(F.when(F.col("label") == 1, 1).otherwise(0)).cast("long").alias("label"))
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest]
    return e.groupBy(*keys).agg(*aggs)


def merge_actions(e: DataFrame, log: str, seq: str, smart: bool = False) -> DataFrame:
    """Per log and ends: one action stays, several become their distinct words, lower-cased and sorted."""
    s, d = T.rtrim_colons(F.trim("src")), T.rtrim_colons(F.trim("dst"))
    k1, k2 = s, d
    if smart:
        both = s.rlike("[a-zA-Z]") & d.rlike("[a-zA-Z]")
        k1, k2 = F.when(both, T.grouping_key(s)).otherwise(s), F.when(both, T.grouping_key(d)).otherwise(d)
    first = F.min_by(F.struct(s.alias("src"), d.alias("dst"), F.trim("action").alias("action"), F.col("ts")), F.col(seq))
    words = F.array_distinct(F.flatten(F.collect_list(F.split(T.trim_all(F.col("action")), r"\s+"))))
    g = e.groupBy(log, k1.alias("_k1"), k2.alias("_k2")).agg(
        first.alias("f"), F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.transform(words, F.lower)), " ").alias("w"))
    return g.select(log, "f.src", "f.dst", F.when(F.col("n") > 1, F.col("w")).otherwise(F.col("f.action")).alias("action"), "f.ts")


def action_frequencies(e: DataFrame) -> DataFrame:
    return e.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def frequency_classes(freq: DataFrame, floor: int = 1000) -> DataFrame:
    return freq.agg(F.count(F.lit(1)).alias("actions"), F.count_if(F.col("n") == 1).alias("once"),
                    F.count_if(F.col("n") < floor).alias("below_floor"), F.count_if(F.col("n") >= floor).alias("kept"))


def window_metadata(e: DataFrame, *by: str) -> DataFrame:
    """Totals per window; a window with any malicious edge belongs to the test split."""
    bad = F.col("label") == 1
    return e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_edges"), F.count_if(bad).alias("malicious_edges"),
        F.count_if(~bad).alias("benign_edges"), F.bool_or(bad).alias("is_test"),
        F.array_join(F.array_sort(F.collect_set("attack")), ",").alias("attack_types"))


def majority_value(votes: DataFrame, ident: str, value: str, seq: str) -> DataFrame:
    """Most frequent lower-cased value per id; a tie goes to the value seen first."""
    v = F.regexp_replace(F.lower(value), "[\"'{]", "")
    k = F.regexp_replace(ident, "[\"'{})]", "")
    c = votes.groupBy(k.alias(ident), v.alias(value)).agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_first"))
    return c.groupBy(ident).agg(F.max_by(value, F.struct("_n", (-F.col("_first")).alias("f"))).alias(value),
                                F.max("_n").alias("votes"))


def edge_consensus(votes: DataFrame, seq: str) -> DataFrame:
    """Agree on action and direction of each unordered pair and time.

    The action with most votes wins (the first seen on a tie), then the direction
    with most votes; an even split gives '<-'.
    """
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    forward = (F.col("direction") == "->") == (F.col("src") == a)
    per = votes.groupBy(a.alias("a"), b.alias("b"), "ts", "action").agg(
        F.count_if(forward).alias("_f"), F.count_if(~forward).alias("_r"), F.min(seq).alias("_first"))
    best = per.groupBy("a", "b", "ts").agg(F.max_by(F.struct("action", "_f", "_r"), F.struct(
        (F.col("_f") + F.col("_r")).alias("n"), (-F.col("_first")).alias("s"))).alias("w"))
    return best.select(F.col("a").alias("src"), F.col("b").alias("dst"), "ts", "w.action",
                       F.when(F.col("w._f") > F.col("w._r"), "->").otherwise("<-").alias("direction"))


def resolve_types(e: DataFrame, validity: DataFrame | None, log: Sequence[str] = ("log_idx",)) -> DataFrame:
    """Compound type per node from the type lists of its rows.

    A log is interactive when any of its actions is valid. A node seen in both
    kinds of logs takes its lists from the non-interactive ones.
    """
    v = e
    if validity is not None:
        v = e.join(validity.select("action", F.col("status").alias("_st")), "action", "left")
        ok = (F.col("action") != T.NO_LABEL) & (F.coalesce("_st", F.lit("VALID")) == "VALID")
    else:
        ok = F.col("action") != T.NO_LABEL
    v = with_group_stats(v.withColumn("_ok", ok), list(log), F.max("_ok").alias("_live"))
    ends = v.select("_live", F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("src_vtypes").alias("t")),
                                              F.struct(F.col("dst").alias("node"), F.col("dst_vtypes").alias("t")))))
    one = ends.filter("node <> '' AND size(t) > 0").select("node", "_live", F.explode("t").alias("t"))
    one = one.select("node", "_live", F.lower("t").alias("t")).distinct()
    sets = one.groupBy("node").agg(F.collect_set(F.when(~F.col("_live"), F.col("t"))).alias("_idle"),
                                   F.collect_set(F.when(F.col("_live"), F.col("t"))).alias("_act"))
    pick = F.when(F.size("_idle") > 0, F.col("_idle")).otherwise(F.col("_act"))
    return sets.select("node", F.array_join(F.array_sort(pick), "+").alias("vtype"))


def encode_labels(values: DataFrame, column: str, name: str = "code", fixed: Sequence[str] = ()) -> DataFrame:
    """Dense codes of the distinct values in sorted order; ``fixed`` values come first, in their order."""
    distinct = values.select(column).filter(F.col(column).isNotNull()).distinct()
    if not fixed:
        return row_index(distinct, [], [column], name)
    pos = F.array_position(F.array(*[F.lit(f) for f in fixed]), F.col(column)) - 1
    known = distinct.filter(pos >= 0).withColumn(name, pos)
    return known.unionByName(row_index(distinct.filter(pos < 0), [], [column], name, start=len(fixed)))


def code_or_zero(df: DataFrame, codes: DataFrame, column: str, name: str = "code") -> DataFrame:
    return df.join(codes, column, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def group_values(df: DataFrame, mapping: DataFrame, column: str, default: str | None = None) -> DataFrame:
    """Map values to groups; an unmapped value keeps itself or takes ``default``."""
    m = mapping.select(column, F.col("group").alias("_g"))
    other = F.lit(default) if default is not None else F.col(column)
    return df.join(m, column, "left").withColumn("group", F.coalesce("_g", other)).drop("_g")


def unlabelled_type_pairs(e: DataFrame, types: DataFrame) -> DataFrame:
    """Distinct type pairs of NO LABEL edges, sorted."""
    s = types.select(F.col("node").alias("src"), F.col("vtype").alias("src_vtype"))
    d = types.select(F.col("node").alias("dst"), F.col("vtype").alias("dst_vtype"))
    pairs = e.filter(F.col("action") == T.NO_LABEL).join(s, "src").join(d, "dst").select("src_vtype", "dst_vtype").distinct()
    return pairs.orderBy("src_vtype", "dst_vtype")


def distribution(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    n = with_group_stats(n, [], F.sum("n").alias("_all_n"))
    return n.select(column, "n", F.round(100.0 * F.col("n") / F.col("_all_n"), 6).alias("percent"))


def inverse_frequency(df: DataFrame, node: str, window: str) -> DataFrame:
    """ln(windows / (windows with the node + 1)) per node."""
    per = df.select(node, window).distinct().groupBy(node).agg(F.count(F.lit(1)).alias("df"))
    total = df.select(window).distinct().agg(F.count(F.lit(1)).alias("_windows"))
    # exactly one row
    out = per.withColumn("_all", F.lit(0)).join(F.broadcast(total.withColumn("_all", F.lit(0))), "_all")
    return out.select(node, "df", F.log(F.col("_windows") / (F.col("df") + 1)).alias("idf"), F.col("_windows").alias("windows"))


def rare_nodes(idf: DataFrame, share: float = 0.9) -> DataFrame:
    return idf.filter(F.col("idf") > F.log(F.col("windows") * share))


def anomaly_threshold(scores: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Mean, population deviation and variance, and mean + factor · deviation (0 when empty)."""
    c = F.col(column)
    return scores.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.var_pop(c).alias("var"),
                      F.coalesce(F.avg(c) + factor * F.stddev_pop(c), F.lit(0.0)).alias("threshold"))


def log_scores(edge_scores: DataFrame, edge_map: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest loss and number of scored edges per log."""
    j = edge_scores.join(edge_map, list(keys))
    return j.groupBy("log_idx", "log_type").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("edges"))


def node_scores_to_logs(e: DataFrame, node_scores: DataFrame) -> DataFrame:
    """Score of a log from its edges' ends: the largest node score."""
    inc = e.select("log_idx", "log_type", F.explode(F.array("src", "dst")).alias("node"))
    return inc.join(node_scores.select("node", "score"), "node").groupBy("log_idx", "log_type").agg(F.max("score").alias("score"))


def node_max_scores(df: DataFrame) -> DataFrame:
    return df.groupBy("node").agg(F.max("score").alias("score"))


def node_scores_by_type(nodes: DataFrame, typed_scores: DataFrame, default: float = 0.0) -> DataFrame:
    """One score per node from per-type score tables: the last type wins, 0.0 when unscored."""
    last = typed_scores.groupBy("node").agg(F.max_by("score", "vtype").alias("_s"))
    return nodes.join(last, "node", "left").withColumn("score", F.coalesce("_s", F.lit(default))).drop("_s")


def node_days(e: DataFrame) -> DataFrame:
    """Distinct (node, day) and (node, window) sightings, with their counts per node."""
    seen = e.select(F.explode(F.array("src", "dst")).alias("node"), "day", "window_key").distinct()
    return seen.groupBy("node").agg(F.countDistinct("day").alias("days"), F.count(F.lit(1)).alias("windows"),
                                    F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def node_sightings(e: DataFrame) -> DataFrame:
    """The exact sets of days and windows in which each node is seen, as sorted arrays: (node, days, windows).

    The sets are combined on the map side, so a hub travels once for each task and window; an array is as long as the time axis has
    windows, whatever the number of edges.
    """
    seen = e.select(F.explode(F.array("src", "dst")).alias("node"), "day", "window_key").filter("node IS NOT NULL")
    return seen.groupBy("node").agg(F.array_sort(F.collect_set("day")).alias("days"), F.array_sort(F.collect_set("window_key")).alias("windows"))


def name_clusters(mapped: DataFrame) -> DataFrame:
    """Processed name → the distinct original names that differ from it, one per row.

    A processed name without other originals has one row with a null member. Rows
    instead of lists keep a name shared by very many originals spread.
    """
    pairs = mapped.select("processed", F.when(F.col("name") != F.col("processed"), F.col("name")).alias("member")).distinct()
    named = pairs.filter("member IS NOT NULL")
    alone = pairs.select("processed").distinct().join(named.select("processed").distinct(), "processed", "left_anti")
    return named.unionByName(alone.withColumn("member", F.lit(None).cast("string")))


def reduction_report(mapped: DataFrame, is_file: str = "is_file") -> DataFrame:
    """Originals, distinct non-empty results and the share saved, for files and directories."""
    g = mapped.groupBy(is_file).agg(F.count(F.lit(1)).alias("originals"),
                                    F.count_distinct(F.when(F.col("processed") != "", F.col("processed"))).alias("processed"))
    return g.withColumn("reduction_percent", F.round(100.0 * (F.col("originals") - F.col("processed")) / F.col("originals"), 6))


def graph_statistics(e: DataFrame) -> DataFrame:
    ends = e.select("action", F.explode(F.array("src", "dst")).alias("node"))
    s = ends.agg(F.count_distinct("node").alias("nodes"), (F.count(F.lit(1)) / 2).cast("long").alias("edges"),
                 F.count_distinct("action").alias("edge_types"))
    return s.withColumn("avg_degree", F.round(2 * F.col("edges") / F.col("nodes"), 6))


def end_validity(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge ends missing from the node table, per side."""
    n = nodes.select("node").distinct().withColumn("_ok", F.lit(True))
    out = (e.join(n.withColumnRenamed("node", "src").withColumnRenamed("_ok", "_s"), "src", "left")
           .join(n.withColumnRenamed("node", "dst").withColumnRenamed("_ok", "_d"), "dst", "left"))
    return out.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("_s").isNull()).alias("bad_src"),
                   F.count_if(F.col("_d").isNull()).alias("bad_dst"))


def common_record_keys(samples: DataFrame, n: int | None = None) -> DataFrame:
    """Keys below ``datum`` of JSON samples with counts; ``n`` keeps the first samples only, as a report option."""
    s = samples.orderBy("log_idx").limit(n) if n else samples
    keys = s.select(F.explode(F.json_object_keys(F.get_json_object("line", "$.datum"))).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def target_templates(samples: DataFrame) -> DataFrame:
    return samples.select(N.mask_values(F.col("target")).alias("template")).groupBy("template").agg(F.count(F.lit(1)).alias("n"))


def first_assignments(df: DataFrame, ident: str, seq: str) -> DataFrame:
    """First row per id."""
    return first_rows(df, [ident], [seq])


def match_statistics(aligned: DataFrame) -> DataFrame:
    return distribution(aligned, "match_kind")


# --- set operations ------------------------------------------------------------------------

def union_log_types(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of edge tables of several log types; a missing text column becomes ''."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.na.fill("")


def upsert_window(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Merge a window of a second data set into the stored one, edge line by edge line.

    Columns: ``line, seq, label`` (null = benign, else the attack). A new line is
    appended; a repeat is appended only when both are malicious, relabels the last
    stored copy when only the new one is malicious, and is dropped otherwise.
    """
    last = existing.groupBy("line").agg(F.max("seq").alias("_last"), F.max_by("label", "seq").alias("_old"))
    latest = (new.filter("label IS NOT NULL").groupBy("line").agg(F.max_by("label", "seq").alias("_relabel")))
    kept = existing.join(last, "line").join(latest, "line", "left").select(
        "line", "seq", F.when((F.col("seq") == F.col("_last")) & F.col("label").isNull(), F.col("_relabel"))
        .otherwise(F.col("label")).alias("label"), F.lit("stored").alias("origin"))
    added = new.join(last, "line", "left").filter(
        "_last IS NULL OR (_old IS NOT NULL AND label IS NOT NULL)").select(
        "line", "seq", "label", F.lit("new").alias("origin"))
    return kept.unionByName(added)


def vocabulary(*parts: DataFrame, column: str) -> DataFrame:
    out = parts[0].select(column)
    for p in parts[1:]:
        out = out.union(p.select(column))
    return out.distinct()


def common_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def missing_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).subtract(b.select(column))


def distinct_first(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Distinct rows by ``keys``, each with the position of its first appearance."""
    return df.groupBy(*keys).agg(F.min(seq).alias(seq))
