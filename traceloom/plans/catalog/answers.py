"""Queries over answer texts and judge verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import answers as R
from traceloom.operators import lookup as J
from traceloom.plans.registry import query

KEYS = ["conv_id", "turn"]
# the answer text repeats the source text after its own lines
LINES = "unnest(string_split(regexp_extract(text, '(?is)(### final output.*)$', 1), chr(10))) AS line, generate_subscripts(string_split(regexp_extract(text, '(?is)(### final output.*)$', 1), chr(10)), 1) - 1 AS pos"

for _n, _keep in (("final_assignments", "="), ("final_pairs", "a: [...]")):
    query(_n, f"SELECT conv_id, turn, pos::BIGINT AS pos, line FROM (SELECT conv_id, turn, {LINES} FROM answers) WHERE contains(lower(line), '{_keep}')", "answers")(
        lambda t, keep=_keep: R.final_lines(t.answers, KEYS, keep=keep))


@query("final_description", f"SELECT conv_id, turn, pos::BIGINT AS pos, line FROM (SELECT conv_id, turn, {LINES} FROM answers) WHERE length(line) > 1 AND NOT contains(line, '### Final Output')", "answers")
def _(t):
    return R.final_lines(t.answers, KEYS, keep="")


@query("last_type_block", """
SELECT conv_id, turn, '[ENTITY TYPES]' || chr(10) || 'U' || conv_id || ' = process' || chr(10) AS block FROM answers""", "answers")
def _(t):
    x = F.concat(F.lit("[ENTITY TYPES]\nold = x\n[ENTITY TYPES]\nU"), "conv_id", F.lit(" = process\n[END]"))
    return R.last_type_block(t.answers.select(*KEYS, x.alias("text"))).drop("text")


@query("classification", """
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'INVALID' WHEN 1 THEN 'VALID' ELSE 'COMMAND-LINE' END AS class FROM answers""", "answers")
def _(t):
    return t.answers.select(*KEYS, R.classification(F.col("text")).alias("class"))


@query("keyed_fields", """
SELECT conv_id, turn, unnest(['filename', 'classification', 'type']) AS field,
 unnest(['a' || turn, CASE turn % 3 WHEN 0 THEN 'INVALID' WHEN 1 THEN 'valid' ELSE 'Command-Line' END, 'tool']) AS value, 6::BIGINT AS line_no FROM answers""", "answers")
def _(t):
    return R.keyed_fields(t.answers, KEYS)


@query("without_thoughts", """
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '(?is)<think>.*?</think>', '', 'g'), '^\\s+|\\s+$', '', 'g'), '\\n\\s*\\n', chr(10) || chr(10), 'g') AS text FROM answers""", "answers")
def _(t):
    return t.answers.select(*KEYS, R.without_thoughts(F.col("text")).alias("text"))


@query("verdicts", """
SELECT conv_id, turn, unnest(w) AS verdict, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT conv_id, turn, regexp_extract_all(upper(body), '\\b(YES|NO)\\b', 1) AS w
 FROM (SELECT conv_id, turn, split_part(text, ' because YES', 1) || ' YES' AS body FROM answers))""", "answers")
def _(t):
    body = F.concat(F.get(F.split("text", " because YES"), F.lit(0)), F.lit(" YES"))
    return R.verdicts(t.answers.select(*KEYS, body.alias("text")), KEYS)


STAGE_OF = "(['Reconnaissance', 'initial access', 'Execution', 'Data Exfiltration', 'Unknown Step'])[turn % 5 + 1]"


@query("stage_reasons", f"SELECT conv_id, turn, {STAGE_OF} AS stage, 'turn ' || turn || ' of the chain' AS reasoning, 2::BIGINT AS pos FROM answers", "answers")
def _(t):
    return R.stage_reasons(t.answers, KEYS)


@query("normalized_stages", f"""
SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Reconnaissance' WHEN 1 THEN 'Initial Access' WHEN 2 THEN 'Execution' WHEN 3 THEN 'Exfiltration' END AS stage FROM answers""", "answers")
def _(t):
    s = R.stage_reasons(t.answers, KEYS)
    return s.select(*KEYS, R.normalize_stage(F.col("stage")).alias("stage"))


@query("text_coverage", """
WITH q AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '"([^"]*)"', 1)) AS node FROM answers), n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
SELECT conv_id, turn, count(DISTINCT q.node) FILTER (n.node IS NOT NULL) AS covered, (SELECT count(*) FROM n) AS total_nodes,
 round(count(DISTINCT q.node) FILTER (n.node IS NOT NULL) / (SELECT count(*) FROM n)::DOUBLE, 6) AS coverage, round(1 - count(n.node) / count(*)::DOUBLE, 6) AS hallucination
FROM q LEFT JOIN n ON n.node = q.node GROUP BY conv_id, turn""", "answers edges")
def _(t):
    c = R.text_coverage(t.answers, J.nodes_of(t.edges), KEYS)
    return c.withColumns({"coverage": F.round("coverage", 6), "hallucination": F.round("hallucination", 6)})


VOTE_SQL = """(SELECT l_partkey % 50 AS attack, 'j' || (l_suppkey % 3) AS judge, l_partkey % 7 AS subgraph, 's' || (l_orderkey % 4) AS stage,
 CASE WHEN l_quantity > 2 THEN 'YES' ELSE 'NO' END AS verdict, row_number() OVER (PARTITION BY l_partkey % 50, l_suppkey % 3 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem)"""


def _votes(t):
    from traceloom.operators.ordered import row_index
    li = t.read("lineitem").withColumns({
        "attack": F.col("l_partkey") % 50, "judge": F.concat(F.lit("j"), F.col("l_suppkey") % 3), "subgraph": F.col("l_partkey") % 7,
        "stage": F.concat(F.lit("s"), F.col("l_orderkey") % 4), "verdict": F.when(F.col("l_quantity") > 2, "YES").otherwise("NO")})
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return row_index(li.select("attack", "judge", "subgraph", "stage", "verdict", *cols), ["attack", "judge"], cols, "pos")


@query("judge_agreement", f"""
WITH v AS {VOTE_SQL}, s AS (SELECT attack, min(n) AS short FROM (SELECT attack, judge, count(*) AS n FROM v GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT v.attack, pos, verdict, count(*) AS c FROM v JOIN s ON s.attack = v.attack WHERE pos < short GROUP BY 1, 2, 3)
SELECT attack, round(avg(x), 6) AS agreement FROM (SELECT attack, pos, max(c) / sum(c)::DOUBLE AS x FROM c GROUP BY 1, 2) GROUP BY attack""")
def _(t):
    return R.agreement(_votes(t), ["attack"]).withColumn("agreement", F.round("agreement", 6))


@query("judge_scores", f"SELECT attack, judge, round(count(*) FILTER (verdict = 'YES') / count(*)::DOUBLE, 6) AS score FROM {VOTE_SQL} GROUP BY 1, 2")
def _(t):
    return R.judge_scores(_votes(t)).withColumn("score", F.round("score", 6))


@query("stage_correctness", f"""
WITH j AS (SELECT attack, stage, subgraph, judge, max_by(verdict, pos) AS verdict FROM {VOTE_SQL} GROUP BY 1, 2, 3, 4),
p AS (SELECT attack, stage, subgraph, count(*) FILTER (verdict = 'NO') AS n FROM j GROUP BY 1, 2, 3), s AS (SELECT attack, stage, max(n) >= 2 AS wrong FROM p GROUP BY 1, 2)
SELECT attack, count(*) FILTER (wrong) AS incorrect_stages, count(*) AS total_stages, round(1 - count(*) FILTER (wrong) / count(*)::DOUBLE, 6) AS stage_correctness FROM s GROUP BY attack""")
def _(t):
    return R.stage_correctness(_votes(t)).withColumn("stage_correctness", F.round("stage_correctness", 6))


@query("attack_averages", "SELECT attack, round(avg(score), 6) AS score, round(avg(y), 6) AS y FROM scores GROUP BY attack", "scores")
def _(t):
    a = R.attack_averages(t.scores, ["score", "y"])
    return a.withColumns({"score": F.round("score", 6), "y": F.round("y", 6)})


@query("candidate_table", """
WITH e AS (SELECT log_idx, CASE WHEN log_idx % 2 = 0 THEN 'id-' || src ELSE src END AS a, dst AS b, action, CASE WHEN log_idx % 3 = 0 THEN '<-' ELSE '->' END AS d, ts_ns::VARCHAR AS ts, src FROM edges),
r AS (SELECT *, CASE WHEN log_idx % 2 = 0 THEN CASE WHEN substr(src, 2)::BIGINT % 3 = 0 THEN 'NONE' WHEN substr(src, 2)::BIGINT % 3 = 1 THEN 'nm-' || src ELSE 'none' END ELSE a END AS x FROM e)
SELECT log_idx, CASE WHEN d = '<-' THEN b ELSE x END AS src, CASE WHEN d = '<-' THEN x ELSE b END AS dst, action, d AS direction, ts FROM r WHERE upper(x) <> 'NONE'""", "edges")
def _(t):
    i, n = F.col("log_idx"), F.substring("src", 2, 20).cast("long")
    e = t.edges.select("log_idx", F.when(i % 2 == 0, F.concat(F.lit("id-"), "src")).otherwise(F.col("src")).alias("src"), "dst", "action",
                       F.when(i % 3 == 0, "<-").otherwise("->").alias("direction"), F.concat(F.col("ts_ns").cast("string"), F.lit(" UTC")).alias("ts"))
    names = t.edges.select("src").distinct().filter(n % 3 != 0).select(F.concat(F.lit("id-"), "src").alias("entity"), F.posexplode(F.when(
        n % 3 == 1, F.array(F.lit("None"), F.concat(F.lit("nm-"), "src"), F.lit("**Step 2"))).otherwise(F.array(F.lit("none")))).alias("seq", "name"))
    return R.candidate_table(e, names)


@query("type_lines", "SELECT node AS entity, node || ' = ' || vtype AS line FROM types WHERE vtype <> 'type_3'", "types")
def _(t):
    v = F.when(F.col("vtype") == "type_3", "**Step 3").otherwise(F.col("vtype"))
    return R.type_lines(t.types.select(F.col("node").alias("entity"), v.alias("vtype")))
