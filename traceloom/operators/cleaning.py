"""Row-level cleaning steps over edge, name and response tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import edge_text as T
from traceloom.functions import names as N
from traceloom.operators.common import with_group_stats


def parse_edge_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Edge line text to columns; lines of another form keep ``parse_ok = false``."""
    return lines.withColumns(T.parse_edge_line(F.col(line)))


def _explode_action(e: DataFrame, parts: Column) -> DataFrame:
    return e.select(*[c for c in e.columns if c != "action"], F.posexplode_outer(parts).alias("part_no", "action")
                    ).filter("action IS NOT NULL")


def split_multi_actions(e: DataFrame) -> DataFrame:
    return _explode_action(e, T.action_lines(F.col("action")))


def split_colon_actions(e: DataFrame) -> DataFrame:
    return _explode_action(e, T.colon_parts(F.col("action")))


def split_comma_actions(e: DataFrame) -> DataFrame:
    return _explode_action(e, T.comma_parts(F.col("action")))


def drop_integer_words(e: DataFrame) -> DataFrame:
    return e.withColumn("action", T.drop_integer_words(F.col("action"))).filter("action <> ''")


def normalize_paths(names: DataFrame, known_extensions: DataFrame, name: str = "name", lower: bool = False) -> DataFrame:
    """Add ``processed``: the name with host-specific numbers removed.

    ``known_extensions(extension)`` holds extensions with their dot; the join is
    on lower case, as both cases count as known.
    """
    path = N.slash_path(F.lower(name) if lower else F.col(name))
    known = known_extensions.select(F.lower(F.trim("extension")).alias("_ext")).distinct().withColumn("_known", F.lit(True))
    n = names.withColumn("_path", path)
    n = n.withColumn("_ext", F.lower(N.long_extension(F.col("_path")))).join(known, "_ext", "left")
    return n.withColumn("processed", N.strip_numerics(F.col("_path"), F.col("_known"))).drop("_path", "_ext", "_known")


def repair_columns(e: DataFrame, file: str) -> DataFrame:
    """Edge rows with names only: an empty name falls back to the id of that row.

    A file whose name column is wholly empty takes ids throughout.
    """
    filled = with_group_stats(e, [file], F.max(F.trim("source_name") != "").alias("_s"),
                              F.max(F.trim("dest_name") != "").alias("_d"))

    def pick(has: str, name: str, ident: str) -> Column:
        return F.when(F.col(has) & (F.trim(name) != ""), F.col(name)).otherwise(F.col(ident))

    return filled.select(file, "log_idx", pick("_s", "source_name", "source_id").alias("source_name"),
                         pick("_d", "dest_name", "dest_id").alias("dest_name"), "action", "timestamp")


def orient(e: DataFrame, pairs: list[tuple[str, str]], direction: str = "direction") -> DataFrame:
    """Swap the column pairs of edges that point backwards ('<-')."""
    back = F.contains(F.col(direction), F.lit("<-"))
    swaps = {}
    for a, b in pairs:
        swaps[a] = F.when(back, F.col(b)).otherwise(F.col(a))
        swaps[b] = F.when(back, F.col(a)).otherwise(F.col(b))
    return e.withColumns(swaps)


def ids_from_type_lines(df: DataFrame, text: str) -> DataFrame:
    """One row per ``id = type`` line: the id without quotes and brackets."""
    lines = df.select("*", F.explode(F.split(text, "\n")).alias("_l")).filter(F.contains(F.col("_l"), F.lit("=")))
    ident = F.translate(F.get(F.split(T.trim_all(F.col("_l")), "="), F.lit(0)), "\"'{}()", "")
    return lines.withColumn("entity", ident).drop("_l")


def edge_sentences(e: DataFrame, names: DataFrame | None = None, renames: DataFrame | None = None) -> DataFrame:
    """Add ``sentence`` = 'source --action--> target' with display names.

    ``names(node, names array)`` gives display names, with the node id as
    fallback; ``renames(old, new)`` is an optional last replacement.
    """
    out = e
    for end in ("src", "dst"):
        shown = F.col(end)
        if names is not None:
            n = names.select(F.col("node").alias(end), F.col("names").alias("_n"))
            out = out.join(n, end, "left")
            known = (F.size("_n") > 0) & ~((F.size("_n") == 1) & (F.get("_n", F.lit(0)) == "unknown"))
            shown = F.when(F.coalesce(known, F.lit(False)), F.array_join("_n", " ")).otherwise(F.col(end))
        out = out.withColumn(end + "_name", shown)
        if names is not None:
            out = out.drop("_n")
        if renames is not None:
            r = renames.select(F.col("old").alias(end + "_name"), F.col("new").alias("_new"))
            out = out.join(r, end + "_name", "left").withColumn(end + "_name", F.coalesce("_new", end + "_name")).drop("_new")
    kind = F.coalesce("action", F.lit("unknown"))
    return out.withColumn("sentence", F.concat(F.col("src_name"), F.lit(" --"), kind, F.lit("--> "), F.col("dst_name")))
