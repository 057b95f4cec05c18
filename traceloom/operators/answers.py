"""Text answers of outside models, taken apart with DataFrame steps.

Answers are a table with one text per row; every step works on lines or tokens of
whole texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.edge_text import trim_all
from traceloom.operators.common import with_group_stats

# Names of attack stages, and spellings mapped to them.
STAGES = [
    "Reconnaissance", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion",
    "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact",
]
STAGE_ALIASES = {"Data Exfiltration": "Exfiltration", "Data exfiltration": "Exfiltration", "data exfiltration": "Exfiltration"}


def final_lines(a: DataFrame, keys: Sequence[str], text: str = "text", keep: str = "=") -> DataFrame:
    """Lines from '### Final Output' on that contain ``keep`` (any case): (keys, pos, line).

    ``keep`` '=' gives assignments, 'a: [...]' gives pairs, '' gives every longer line.
    """
    tail = F.regexp_extract(text, r"(?is)(### final output.*)$", 1)
    lines = a.select(*keys, F.posexplode(F.split(tail, "\n")).alias("pos", "line"))
    if keep:
        return lines.filter(F.contains(F.lower("line"), F.lit(keep)))
    return lines.filter((F.length("line") > 1) & ~F.contains(F.col("line"), F.lit("### Final Output")))


def last_type_block(a: DataFrame, text: str = "text") -> DataFrame:
    """Last '[ENTITY TYPES]' block of each text, null when there is none."""
    blocks = F.regexp_extract_all(text, F.lit(r"(\[ENTITY TYPES\](?:\n[^\[]+)+)"), F.lit(1))
    return a.withColumn("block", F.when(F.size(blocks) > 0, F.element_at(blocks, -1)))


def classification(text: Column) -> Column:
    """VALID, INVALID or COMMAND-LINE: from a 'Classification:' field if any, else from the whole text."""
    def kind(c: Column) -> Column:
        return (F.when(F.contains(c, F.lit("COMMAND-LINE")) | F.contains(c, F.lit("COMMANDLINE")), "COMMAND-LINE")
                .when(F.contains(c, F.lit("INVALID")), "INVALID").when(F.contains(c, F.lit("VALID")), "VALID"))

    # the field counts only on a line that also has a '|'
    named = F.upper(F.regexp_extract(text, r"(?m)^(?=.*\|).*?Classification:([^|\n]*)", 1))
    return F.coalesce(kind(named), kind(F.upper(text)), F.lit("INVALID"))


def keyed_fields(a: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """'key: value | key: value' lines as rows: (keys, line_no, field, value)."""
    lines = a.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "_l")).filter(F.contains("_l", F.lit("|")))
    parts = lines.select(*keys, "line_no", F.explode(F.split("_l", r"\|")).alias("_p"))
    form = r"^\s*([^:]+):\s*(.*)$"
    return parts.filter(F.col("_p").rlike(form)).select(
        *keys, "line_no", F.lower(F.trim(F.regexp_extract("_p", form, 1))).alias("field"),
        F.trim(F.get(F.split(F.regexp_extract("_p", form, 2), "###"), F.lit(0))).alias("value"))


def without_thoughts(text: Column) -> Column:
    c = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.regexp_replace(trim_all(c), r"\n\s*\n", "\n\n")


def verdicts(a: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """YES and NO words in order: (keys, pos, verdict)."""
    words = F.regexp_extract_all(F.upper(text), F.lit(r"\b(YES|NO)\b"), F.lit(1))
    return a.select(*keys, F.posexplode(words).alias("pos", "verdict"))


def stage_reasons(a: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(stage, reasoning) pairs: a reasoning line belongs to the last stage line before it, once."""
    lines = a.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "_raw")).withColumn("_l", trim_all(F.col("_raw")))
    plain = F.regexp_replace("_l", r"\*", "")
    starred = F.col("_l").rlike(r"^\*\*.*\*\*$")
    bare = F.lower(F.trim(F.replace("_l", F.lit("**"), F.lit(""))))
    known = F.lit(False)
    for s in STAGES:
        known = known | F.contains(bare, F.lit(s.lower())) | F.contains(F.lit(s.lower()), bare)
    stage = (F.when(F.contains("_l", F.lit("Stage:")), trim_all(F.regexp_replace(plain, r"^[^:]*:", "")))
             .when(starred & known, F.trim(F.replace("_l", F.lit("**"), F.lit("")))))
    reason = F.when(stage.isNull() & ~starred & F.contains("_l", F.lit("Reasoning:")), trim_all(F.regexp_replace("_l", r"^[^:]*:", "")))
    marks = lines.select(*keys, "pos", stage.alias("stage"), reason.alias("reasoning")).filter("stage IS NOT NULL OR reasoning IS NOT NULL")
    # one answer text is one group, so the window holds the lines of one text
    w = Window.partitionBy(*keys).orderBy("pos")
    pairs = marks.withColumn("_s", F.lag("stage").over(w))
    return pairs.filter("reasoning IS NOT NULL AND _s IS NOT NULL AND _s <> ''").select(*keys, "pos", F.col("_s").alias("stage"), "reasoning")


def normalize_stage(stage: Column, stages: Sequence[str] = STAGES) -> Column:
    """Official stage name by alias, exact or case-insensitive match; null when unknown."""
    out = F.lit(None).cast("string")
    for s in reversed(list(stages)):
        out = F.when(F.lower(stage) == s.lower(), F.lit(s)).otherwise(out)
    for a, s in STAGE_ALIASES.items():
        out = F.when(stage == a, F.lit(s)).otherwise(out)
    return out


def text_coverage(a: DataFrame, nodes: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Per text: share of graph nodes named in quotes, and share of quoted names that are no nodes.

    Coverage counts distinct names, hallucination counts repeats.
    """
    quoted = F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1))
    q = a.select(*keys, F.explode_outer(quoted).alias("node"))
    n = nodes.select("node").distinct()
    q = q.join(n.withColumn("_hit", F.lit(True)), "node", "left")
    per = q.groupBy(*keys).agg(F.count("node").alias("quoted"), F.count("_hit").alias("hits"),
                               F.count_distinct(F.when(F.col("_hit"), F.col("node"))).alias("covered"))
    total = n.agg(F.count(F.lit(1)).alias("total_nodes"), F.lit(0).alias("_all"))
    # exactly one row
    per = per.withColumn("_all", F.lit(0)).join(F.broadcast(total), "_all").drop("_all")
    return per.select(*keys, "covered", "total_nodes", F.when(F.col("total_nodes") > 0, F.col("covered") / F.col("total_nodes")).otherwise(0.0).alias("coverage"),
                      F.when(F.col("quoted") > 0, 1 - F.col("hits") / F.col("quoted")).otherwise(0.0).alias("hallucination"))


def agreement(votes: DataFrame, keys: Sequence[str], judge: str = "judge") -> DataFrame:
    """Per group: mean over positions of the largest share of one label, up to the shortest list.

    ``votes(keys, judge, pos, verdict)`` with positions from 0.
    """
    n = votes.groupBy(*keys, judge).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.min("_n").alias("_short"))
    v = votes.join(n, list(keys)).filter(F.col("pos") < F.col("_short"))
    per = v.groupBy(*keys, "pos", "verdict").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys, "pos").agg(
        (F.max("c") / F.sum("c")).alias("share"))
    return per.groupBy(*keys).agg(F.avg("share").alias("agreement"))


def judge_scores(votes: DataFrame, attack: str = "attack") -> DataFrame:
    """Share of YES per attack and judge."""
    return votes.groupBy(attack, "judge").agg((F.count_if(F.col("verdict") == "YES") / F.count(F.lit(1))).alias("score"))


def stage_correctness(votes: DataFrame, attack: str = "attack") -> DataFrame:
    """Share of stages on which never two or more judges said NO in one subgraph.

    A judge's last verdict on a stage counts.
    """
    last = votes.groupBy(attack, "stage", "subgraph", "judge").agg(F.max_by("verdict", "pos").alias("verdict"))
    per = last.groupBy(attack, "stage", "subgraph").agg(F.count_if(F.col("verdict") == "NO").alias("no"))
    st = per.groupBy(attack, "stage").agg((F.max("no") >= 2).alias("wrong"))
    return st.groupBy(attack).agg(F.count_if("wrong").alias("incorrect_stages"), F.count(F.lit(1)).alias("total_stages"),
                                  (1 - F.count_if("wrong") / F.count(F.lit(1))).alias("stage_correctness"))


def attack_averages(scores: DataFrame, columns: Sequence[str], attack: str = "attack") -> DataFrame:
    return scores.groupBy(attack).agg(*[F.avg(c).alias(c) for c in columns])


def candidate_table(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Training edges: resolved ends, no unlabelled action, no noise names."""
    from traceloom.operators.cleaning import orient
    from traceloom.operators.filters import drop_no_label, drop_noise_names, drop_step_names
    from traceloom.operators.lookup import resolve_ids
    good = (F.upper("name") != "NONE") & (F.col("name") != F.col("entity"))
    # only the first telling name and the first name at all can be shown
    lists = drop_step_names(names).groupBy("entity").agg(F.array_compact(F.array(
        F.min_by("name", F.when(good, F.col("seq"))), F.min_by("name", "seq"))).alias("names"))
    e = drop_no_label(edges)
    for end in ("src", "dst"):
        e = resolve_ids(e, lists, end).drop(end).withColumnRenamed("resolved", end)
    e = orient(e, [("src", "dst")])
    ts = F.trim(F.regexp_replace("ts", " UTC$", ""))
    return drop_noise_names(e).withColumn("ts", ts)


def type_lines(types: DataFrame) -> DataFrame:
    """'id = type' text per entity, noise rows left out."""
    ok = ~F.contains(F.col("entity"), F.lit("**Step")) & ~F.contains(F.col("vtype"), F.lit("**Step"))
    return types.filter(ok).select("entity", F.concat_ws(" = ", "entity", "vtype").alias("line"))
