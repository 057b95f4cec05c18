"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import metrics as M
from traceloom.plans.registry import query

RANK = """
g AS (SELECT {k} score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM {src} GROUP BY {k} score),
r AS (SELECT *, sum(pos) OVER ({p} ORDER BY score DESC)::BIGINT AS tp, sum(neg) OVER ({p} ORDER BY score DESC)::BIGINT AS fp FROM g)"""
AUC = """{k} sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives, round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) AS auc_roc,
 round(sum(pos * (tp / (tp + fp)::DOUBLE)) / sum(pos), 6) AS auc_pr FROM r"""


def _rounded(df, *cols, d=6):
    return df.withColumns({c: F.round(c, d) for c in cols})


@query("ranking_metrics", "WITH " + RANK.format(k="", p="", src="scores") + " SELECT " + AUC.format(k=""), "scores")
def _(t):
    return _rounded(M.ranking_metrics(t.scores), "auc_roc", "auc_pr")


@query("ranking_metrics_by_type", "WITH " + RANK.format(k="log_type,", p="PARTITION BY log_type", src="scores") + " SELECT " + AUC.format(k="log_type,") + " GROUP BY log_type", "scores")
def _(t):
    return _rounded(M.ranking_metrics(t.scores, ["log_type"]), "auc_roc", "auc_pr")


@query("ranking_metrics_logs", "WITH " + RANK.format(k="", p="", src="log_scores") + " SELECT " + AUC.format(k=""), "log_scores")
def _(t):
    return _rounded(M.ranking_metrics(t.log_scores), "auc_roc", "auc_pr")


METRICS = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6)::DOUBLE AS f1, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END, 6) AS fpr,
 round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS tpr"""
RATES = ("precision", "recall", "f1", "fpr", "tpr")


@query("confusion_metrics", f"""
SELECT log_type, tp, fp, tn, fn, {METRICS} FROM (SELECT log_type, count(*) FILTER (score > 100 AND y = 1) AS tp, count(*) FILTER (score > 100 AND y = 0) AS fp,
 count(*) FILTER (score <= 100 AND y = 0) AS tn, count(*) FILTER (score <= 100 AND y = 1) AS fn FROM scores GROUP BY log_type)""", "scores")
def _(t):
    hit, bad = F.col("score") > 100, F.col("y") == 1
    c = t.scores.groupBy("log_type").agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"),
                                         F.count_if(~hit & ~bad).alias("tn"), F.count_if(~hit & bad).alias("fn"))
    return _rounded(M.confusion_metrics(c), *RATES)


BEST = """
b0 AS (SELECT *, {n} AS n_neg, {ps} AS n_pos FROM r),
b AS (SELECT *, row_number() OVER ({p} ORDER BY round(2.0::DOUBLE * tp / (tp + fp + n_pos), 12) DESC, score) AS rn FROM b0)
SELECT {k} score AS threshold, tp, fp, (n_neg - fp)::BIGINT AS tn, (n_pos - tp)::BIGINT AS fn, """


@query("best_f1", "WITH " + RANK.format(k="", p="", src="scores") + "," + BEST.format(k="", p="", n="sum(neg) OVER ()", ps="sum(pos) OVER ()")
       + METRICS.replace("fn", "(n_pos - tp)").replace("tn", "(n_neg - fp)") + " FROM b WHERE rn = 1", "scores")
def _(t):
    return _rounded(M.best_f1(t.scores), *RATES)


@query("percentile_confusion", f"""
SELECT *, {METRICS} FROM (SELECT log_type, round(max(th), 6) AS threshold, count(*) FILTER (score > th AND y = 1) AS tp, count(*) FILTER (score > th AND y = 0) AS fp,
 count(*) FILTER (score <= th AND y = 0) AS tn, count(*) FILTER (score <= th AND y = 1) AS fn FROM (SELECT *, quantile_cont(score, 0.99) OVER (PARTITION BY log_type) AS th FROM scores) GROUP BY log_type)""", "scores")
def _(t):
    return _rounded(M.percentile_confusion(t.scores, ["log_type"]), "threshold", *RATES)


@query("pooled_confusion", f"""
SELECT *, {METRICS} FROM (SELECT count(*) FILTER (score > th AND y = 1) AS tp, count(*) FILTER (score > th AND y = 0) AS fp,
 count(*) FILTER (score <= th AND y = 0) AS tn, count(*) FILTER (score <= th AND y = 1) AS fn FROM (SELECT *, quantile_cont(score, 0.95) OVER (PARTITION BY attack) AS th FROM scores))""", "scores")
def _(t):
    return _rounded(M.pooled_confusion(t.scores, "attack", 0.05), *RATES)


CURVE = """
o AS (SELECT id, score, y, attack, row_number() OVER (ORDER BY score DESC, id) AS rnk, sum(y) OVER (ORDER BY score DESC, id) AS tp FROM scores),
f AS (SELECT attack, min(rnk) AS rnk FROM o WHERE y = 1 GROUP BY attack),
c AS (SELECT {prec} AS p, (sum(CASE WHEN n IS NULL THEN 0 ELSE n END) OVER (ORDER BY o.rnk))::DOUBLE / (SELECT count(*) FROM f) AS d FROM o LEFT JOIN (SELECT rnk, count(*) AS n FROM f GROUP BY rnk) q ON q.rnk = o.rnk),
u AS (SELECT p, max(d) AS d FROM (SELECT p, d FROM c UNION ALL SELECT 0.0, 0.0) GROUP BY p)"""
AREA = "SELECT round(sum((p - pp) * (d + dd) / 2), 6) AS adp FROM (SELECT p, d, lag(p) OVER (ORDER BY p) AS pp, lag(d) OVER (ORDER BY p) AS dd FROM {u})"


def _attacks(t):
    return t.scores.filter("y = 1").select("id", "attack")


@query("attack_detection_precision", "WITH " + CURVE.format(prec="round((tp / o.rnk)::DOUBLE, 6)") +
       ", e AS (SELECT p, max(d) AS d FROM (SELECT * FROM u UNION ALL SELECT 1.0, max_by(d, p) FROM u) GROUP BY p) " + AREA.format(u="e"), "scores")
def _(t):
    return _rounded(M.attack_detection_precision(t.scores, _attacks(t)), "adp")


@query("attack_detection_precision_plain", "WITH " + CURVE.format(prec="(tp / o.rnk)::DOUBLE") + " " + AREA.format(u="u"), "scores")
def _(t):
    return _rounded(M.attack_detection_precision_plain(t.scores, _attacks(t)), "adp")


@query("detection_at_false_alarms", """
WITH o AS (SELECT sum(y) OVER w AS tp, sum(1 - y) OVER w AS fp, sum(y) OVER () AS p, sum(1 - y) OVER () AS n FROM scores WINDOW w AS (ORDER BY score DESC, id))
SELECT round((max(tp) FILTER (fp <= ceil(0.01 * n)) + max(tp) FILTER (fp <= ceil(0.05 * n)) + max(tp) FILTER (fp <= ceil(0.1 * n))) / 3.0::DOUBLE / max(p), 6) AS adp FROM o""", "scores")
def _(t):
    return _rounded(M.detection_at_false_alarms(t.scores), "adp")


@query("evaluate_logs", """
WITH a AS (SELECT DISTINCT attack AS attack FROM log_scores WHERE y = 1),
l AS (SELECT a.attack, CASE WHEN l.scored THEN l.score ELSE 0.0 END AS score, (l.y = 1 AND l.attack = a.attack)::BIGINT AS y, l.scored FROM log_scores l, a),
""" + RANK.format(k="attack,", p="PARTITION BY attack", src="l") + """,
m AS (SELECT """ + AUC.format(k="attack,") + """ GROUP BY attack),
n AS (SELECT attack, count(*) AS logs, count(*) FILTER (scored) AS extracted FROM l GROUP BY attack)
SELECT m.*, logs, extracted, logs - extracted AS missed, round(extracted / logs::DOUBLE, 6) AS extraction_rate FROM m JOIN n ON n.attack = m.attack""", "log_scores")
def _(t):
    ls = t.log_scores
    truth = ls.select("log_idx", "log_type", F.when(F.col("y") == 1, F.array("attack")).otherwise(F.array().cast("array<string>")).alias("attacks"))
    return _rounded(M.evaluate_logs(ls.filter("scored").select("log_idx", "log_type", "score"), truth), "auc_roc", "auc_pr", "extraction_rate").select(
        "attack", "positives", "negatives", "auc_roc", "auc_pr", "logs", "extracted", "missed", "extraction_rate")


@query("evaluate_nodes", """
WITH b AS (SELECT node, max(score) AS score FROM scores GROUP BY node),
gt AS (SELECT DISTINCT s.node, s.attack FROM scores s WHERE s.y = 1 AND s.day = '2024-01-1' || (substr(s.attack, 2))),
a AS (SELECT DISTINCT attack FROM gt),
l AS (SELECT a.attack, b.score, ((b.node, a.attack) IN (SELECT (node, attack) FROM gt))::BIGINT AS y FROM b, a),
""" + RANK.format(k="attack,", p="PARTITION BY attack", src="l") + """,
m AS (SELECT """ + AUC.format(k="attack,") + """ GROUP BY attack),
b2 AS (SELECT *, sum(neg) OVER (PARTITION BY attack) AS n_neg, sum(pos) OVER (PARTITION BY attack) AS n_pos FROM r),
b3 AS (SELECT *, row_number() OVER (PARTITION BY attack ORDER BY round(2.0::DOUBLE * tp / (tp + fp + n_pos), 12) DESC, score) AS rn FROM b2)
SELECT m.*, score AS threshold, tp, fp, (n_neg - fp)::BIGINT AS tn, (n_pos - tp)::BIGINT AS fn, round(2.0 * tp / (2 * tp + fp + n_pos - tp)::DOUBLE, 6) AS f1
FROM m JOIN b3 ON b3.attack = m.attack AND rn = 1""", "scores")
def _(t):
    gt = t.scores.filter("y = 1").select("node", "attack", F.concat(F.lit("2024-01-1"), F.substring("attack", 2, 1)).alias("day")).distinct()
    return _rounded(M.evaluate_nodes(t.scores.select("node", "score"), t.scores.filter("y = 1").select("node", "day"), gt), "auc_roc", "auc_pr", "f1").drop(
        "precision", "recall", "fpr", "tpr")


ADP = """
o AS (SELECT id, y, row_number() OVER (ORDER BY score DESC, id) AS rnk, sum(y) OVER (ORDER BY score DESC, id) AS tp FROM l),
f AS (SELECT attack, min(rnk) AS rnk FROM o JOIN h ON h.id = o.id GROUP BY attack),
c AS (SELECT round((tp / o.rnk)::DOUBLE, 6) AS p, (sum(coalesce(n, 0)) OVER (ORDER BY o.rnk))::DOUBLE / (SELECT count(*) FROM f) AS d
 FROM o LEFT JOIN (SELECT rnk, count(*) AS n FROM f GROUP BY rnk) q ON q.rnk = o.rnk),
u AS (SELECT p, max(d) AS d FROM (SELECT p, d FROM c UNION ALL SELECT 0.0, 0.0) GROUP BY p),
e AS (SELECT p, max(d) AS d FROM (SELECT * FROM u UNION ALL SELECT 1.0, max_by(d, p) FROM u) GROUP BY p),
a AS (""" + AREA.format(u="e") + "),"


@query("evaluate_logs_overall", """
WITH h AS (SELECT DISTINCT (log_type, log_idx) AS id, attack FROM log_scores WHERE y = 1),
l AS (SELECT (log_type, log_idx) AS id, CASE WHEN scored THEN score ELSE 0.0 END AS score, (y = 1)::BIGINT AS y FROM log_scores),
""" + ADP + RANK.format(k="", p="", src="l") + " SELECT m.*, a.adp FROM (SELECT " + AUC.format(k="") + ") m, a", "log_scores")
def _(t):
    ls = t.log_scores
    truth = ls.select("log_idx", "log_type", F.when(F.col("y") == 1, F.array("attack")).otherwise(F.array().cast("array<string>")).alias("attacks"))
    return _rounded(M.evaluate_logs_overall(ls.filter("scored").select("log_idx", "log_type", "score"), truth), "auc_roc", "auc_pr", "adp")


@query("evaluate_nodes_overall", """
WITH h AS (SELECT DISTINCT node AS id, attack FROM scores WHERE y = 1 AND day = '2024-01-1' || (substr(attack, 2))),
l AS (SELECT node AS id, max(score) AS score, (node IN (SELECT id FROM h))::BIGINT AS y FROM scores GROUP BY node),
""" + ADP + RANK.format(k="", p="", src="l") + " SELECT m.*, a.adp FROM (SELECT " + AUC.format(k="") + ") m, a", "scores")
def _(t):
    gt = t.scores.filter("y = 1").select("node", "attack", F.concat(F.lit("2024-01-1"), F.substring("attack", 2, 1)).alias("day")).distinct()
    return _rounded(M.evaluate_nodes_overall(t.scores.select("node", "score"), t.scores.filter("y = 1").select("node", "day"), gt), "auc_roc", "auc_pr", "adp")


@query("confusion_by_type", """
SELECT log_type, round(max(th), 6) AS threshold, count(*) FILTER (score > th AND y = 1) AS tp, count(*) FILTER (score > th AND y = 0) AS fp,
 count(*) FILTER (score <= th AND y = 0) AS tn, count(*) FILTER (score <= th AND y = 1) AS fn,
 coalesce(string_agg(DISTINCT attack, ',' ORDER BY attack) FILTER (y = 1), '') AS attacks,
 coalesce(string_agg(DISTINCT attack, ',' ORDER BY attack) FILTER (y = 1 AND score > th), '') AS attacks_seen
FROM (SELECT *, quantile_cont(score, 0.99) OVER (PARTITION BY log_type) AS th FROM scores) GROUP BY log_type""", "scores")
def _(t):
    m = _rounded(M.confusion_by_type(t.scores, "log_type"), "threshold")
    return m.select("log_type", "threshold", "tp", "fp", "tn", "fn", *[F.array_join(c, ",").alias(c) for c in ("attacks", "attacks_seen")])


@query("ground_truth_summary", """
SELECT attack, window_key, log_type, count(*) FILTER (y = 1) AS malicious, count(*) FILTER (y <> 1) AS benign, count(*) AS total FROM scores GROUP BY ROLLUP (attack, window_key, log_type)""", "scores")
def _(t):
    return M.ground_truth_summary(t.scores, "attack", "window_key", "log_type")


@query("class_weights", """
SELECT action, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight FROM edges GROUP BY action""", "edges")
def _(t):
    return _rounded(M.class_weights(t.edges, "action"), "weight")


@query("results_table", """
WITH m AS (SELECT log_type, avg(score) FILTER (y = 1 AND log_type <> 'dns') AS a, max(score) AS b FROM scores GROUP BY log_type)
SELECT log_type, coalesce(format('{:.4f}', a), 'N/A') AS malicious_mean, format('{:.4f}', b) AS top FROM m""", "scores")
def _(t):
    m = t.scores.groupBy("log_type").agg(F.avg(F.when((F.col("y") == 1) & (F.col("log_type") != "dns"), F.col("score"))).alias("malicious_mean"),
                                         F.max("score").alias("top"))
    return M.results_table(m, ["malicious_mean", "top"])
