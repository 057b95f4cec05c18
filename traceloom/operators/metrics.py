"""Detection quality: ranking metrics, confusion counts and ground-truth summaries.

Ranking metrics first group equal scores, then take prefix sums over score order
with the sliced scans, so no step needs the whole ranking in one task. Every
metric takes grouping ``keys`` (for example the attack name) and works for all
groups at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators.common import with_group_stats
from traceloom.operators.lookup import nodes_on_date
from traceloom.operators.ordered import SLICE, lagged, running_sum, slice_by
from traceloom.operators.time_windows import percentile_threshold
from traceloom.session import cut


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def ranked(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """One row per score, best first, with running positive and negative counts (``tp``, ``fp``)."""
    g = df.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    order = [(score, "desc")]
    return running_sum(slice_by(g, keys, order), keys, order, tp="pos", fp="neg").drop(SLICE)


def ranking_metrics(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "y") -> DataFrame:
    """AUC-ROC and average precision per group; both 0 when only one class is present."""
    r = ranked(df, keys, score, label)
    half = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    agg = r.groupBy(*keys).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(half).alias("_auc"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return agg.select(*keys, "positives", "negatives",
                      F.when(both, F.col("_auc") / (F.col("positives") * F.col("negatives"))).otherwise(0.0).alias("auc_roc"),
                      F.when(both, F.col("_ap") / F.col("positives")).otherwise(0.0).alias("auc_pr"))


def confusion_metrics(c: DataFrame) -> DataFrame:
    """Precision, recall, F1, FPR and TPR from ``tp, fp, tn, fn``; 0 when undefined."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2.0 * tp, 2 * tp + fp + fn),
        "fpr": ratio(fp, fp + tn), "tpr": ratio(tp, tp + fn)})


def best_f1(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "y") -> DataFrame:
    """Score threshold with the best F1; the lowest such threshold on a tie."""
    r = with_group_stats(ranked(df, keys, score, label), keys, F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    f1 = ratio(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("_p"))
    best = r.groupBy(*keys).agg(F.max_by(F.struct(F.col(score).alias("threshold"), "tp", "fp", "_p", "_n"),
                                         F.struct(F.round(f1, 12), -F.col(score))).alias("b"))
    out = best.select(*keys, "b.threshold", "b.tp", "b.fp", (F.col("b._n") - F.col("b.fp")).alias("tn"),
                      (F.col("b._p") - F.col("b.tp")).alias("fn"))
    return confusion_metrics(out)


def percentile_confusion(df: DataFrame, keys: Sequence[str] = (), contamination: float = 0.01,
                         score: str = "score", label: str = "y") -> DataFrame:
    """Confusion counts for score > the (1 − contamination) percentile of the group."""
    t = percentile_threshold(df, keys, score, 1 - contamination)
    if keys:
        d = df.join(t, list(keys))
    else:
        # exactly one row
        d = df.withColumn("_all", F.lit(0)).join(F.broadcast(t.withColumn("_all", F.lit(0))), "_all").drop("_all")
    hit, bad = F.col(score) > F.col("threshold"), F.col(label) == 1
    c = d.groupBy(*keys).agg(F.first("threshold").alias("threshold"), F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"),
                             F.count_if(~hit & ~bad).alias("tn"), F.count_if(~hit & bad).alias("fn"))
    return confusion_metrics(c)


def pooled_confusion(df: DataFrame, by: str, contamination: float = 0.01) -> DataFrame:
    """Thresholds per type, confusion counts pooled over the types."""
    per = percentile_confusion(df, [by], contamination)
    return confusion_metrics(per.agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")]))


def confusion_by_type(df: DataFrame, by: str, attack: str = "attack", contamination: float = 0.01) -> DataFrame:
    """``percentile_confusion`` of each type with the attacks that its malicious rows belong to and those seen above the threshold.

    Attack names are sorted arrays; a type has as many as there are attacks.
    """
    per = percentile_confusion(df, [by], contamination)
    bad = df.filter(F.col("y") == 1).join(per.select(by, "threshold"), by)
    names = bad.groupBy(by).agg(F.array_sort(F.collect_set(attack)).alias("attacks"),
                                F.array_sort(F.collect_set(F.when(F.col("score") > F.col("threshold"), F.col(attack)))).alias("attacks_seen"))
    none = F.array().cast("array<string>")
    return per.join(names, by, "left").withColumns({c: F.coalesce(c, none) for c in ("attacks", "attacks_seen")})


def _attack_curve(df: DataFrame, attacks: DataFrame, ident: str, score: str) -> DataFrame:
    """Rank rows by (score desc, id asc) with precision and the share of attacks seen so far.

    ``df(id, score, y)``; ``attacks(id, attack)`` names the attacks of malicious rows.
    """
    order = [(score, "desc"), ident]
    s = slice_by(df.select(ident, score, "y").withColumn("_one", F.lit(1).cast("long")), [], order)
    s = running_sum(s.withColumn("y", (F.col("y") == 1).cast("long")), [], order, rank="_one", tp="y")
    # rank of the first row of each attack
    at = attacks.select(ident, "attack").distinct().join(s.select(ident, "rank"), ident)
    firsts = at.groupBy("attack").agg(F.min("rank").alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("_new"))
    s = s.join(firsts, "rank", "left").withColumn("_new", F.coalesce("_new", F.lit(0).cast("long")))
    s = running_sum(s, [], order, _seen="_new")
    s = with_group_stats(s, [], F.sum("_new").alias("_attacks"))
    return s.select((F.col("tp") / F.col("rank")).alias("precision"), "_attacks",
                    F.when(F.col("_attacks") > 0, F.col("_seen") / F.col("_attacks")).otherwise(0.0).alias("detected"))


def _area(points: DataFrame) -> DataFrame:
    """Trapezoid area under detected(precision), points unique in precision."""
    p = lagged(slice_by(points, [], ["precision"]), [], ["precision"], _px="precision", _py="detected")
    return p.agg(F.coalesce(F.sum((F.col("precision") - F.col("_px")) * (F.col("detected") + F.col("_py")) / 2), F.lit(0.0)).alias("adp"))


def attack_detection_precision(df: DataFrame, attacks: DataFrame, ident: str = "id", score: str = "score") -> DataFrame:
    """ADP: area under the attack share over precision (6 digits), padded to precision 0 and 1."""
    c = _attack_curve(df, attacks, ident, score)
    c = c.select(F.round("precision", 6).alias("precision"), "detected")
    start = df.sparkSession.range(1).select(F.lit(0.0).alias("precision"), F.lit(0.0).alias("detected"))
    pts = c.unionByName(start).groupBy("precision").agg(F.max("detected").alias("detected"))
    # the last point is carried to precision 1
    end = pts.agg(F.max_by("detected", "precision").alias("detected")).select(F.lit(1.0).alias("precision"), "detected")
    pts = pts.unionByName(end).groupBy("precision").agg(F.max("detected").alias("detected"))
    return _area(pts).select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "adp")).alias("adp"))


def attack_detection_precision_plain(df: DataFrame, attacks: DataFrame, ident: str = "id", score: str = "score") -> DataFrame:
    """ADP without rounding and without padding at precision 1."""
    c = _attack_curve(df, attacks, ident, score).select("precision", "detected")
    start = df.sparkSession.range(1).select(F.lit(0.0).alias("precision"), F.lit(0.0).alias("detected"))
    return _area(c.unionByName(start).groupBy("precision").agg(F.max("detected").alias("detected")))


def detection_at_false_alarms(df: DataFrame, rates: Sequence[float] = (0.01, 0.05, 0.1), ident: str = "id",
                              score: str = "score") -> DataFrame:
    """Share of positives found before the allowed false alarms are exceeded, averaged over the rates."""
    order = [(score, "desc"), ident]
    s = df.select(ident, score, (F.col("y") == 1).cast("long").alias("_p"), (F.col("y") != 1).cast("long").alias("_n"))
    s = running_sum(slice_by(s, [], order), [], order, tp="_p", fp="_n")
    s = with_group_stats(s, [], F.sum("_p").alias("_pos"), F.sum("_n").alias("_neg"))
    # the scan stops at the row that exceeds the allowance, which is a negative: tp up to there
    found = [F.max(F.when(F.col("fp") <= F.ceil(F.lit(r) * F.col("_neg")), F.col("tp"))) for r in rates]
    share = sum((F.coalesce(f, F.lit(0)) for f in found[1:]), F.coalesce(found[0], F.lit(0)))
    out = s.agg((share / len(rates)).alias("_s"), F.max("_pos").alias("_pos"), F.max("_neg").alias("_neg"))
    return out.select(F.when((F.col("_pos") > 0) & (F.col("_neg") > 0), F.col("_s") / F.col("_pos")).otherwise(0.0).alias("adp"))


def per_attack_metrics(df: DataFrame, hits: DataFrame, ident: Sequence[str]) -> DataFrame:
    """AUC-ROC, average precision and best F1 of each attack over the same ranking.

    ``df(ident, score)`` is ranked once; ``hits(ident, attack)`` are the positives
    of each attack, all other rows (also those of other attacks) are its
    negatives. Only positives are joined to the ranking, so nothing is repeated
    per attack: a positive's share of AUC is the number of rows below it, less the
    part that are positives themselves (P²/2 in total).
    """
    g = df.groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    order = [("score", "desc")]
    g = running_sum(slice_by(g, [], order), [], order, _cum="_n").drop(SLICE)
    g = with_group_stats(g, [], F.sum("_n").alias("rows"))
    pos = df.join(hits.select(*ident, "attack").distinct(), list(ident)).groupBy("attack", "score").agg(F.count(F.lit(1)).alias("_p"))
    pos = pos.join(g, "score")
    pos = running_sum(slice_by(pos, ["attack"], order), ["attack"], order, tp="_p").drop(SLICE)
    pos = with_group_stats(pos, ["attack"], F.sum("_p").alias("positives"))
    below = F.col("rows") - F.col("_cum") + F.col("_n") / 2
    f1 = 2.0 * F.col("tp") / (F.col("_cum") + F.col("positives"))
    m = pos.groupBy("attack").agg(
        F.first("positives").alias("positives"), F.first("rows").alias("_rows"), F.sum(F.col("_p") * below).alias("_auc"),
        F.sum(F.col("_p") * F.col("tp") / F.col("_cum")).alias("_ap"),
        F.max_by(F.struct(F.col("score").alias("threshold"), "tp", "_cum"), F.struct(F.round(f1, 12), -F.col("score"))).alias("b"))
    p, n = F.col("positives"), F.col("_rows") - F.col("positives")
    auc = (F.col("_auc") - p * p / 2) / (p * n)
    out = m.select("attack", "positives", n.alias("negatives"), F.when(n > 0, auc).otherwise(0.0).alias("auc_roc"),
                   F.when(n > 0, F.col("_ap") / p).otherwise(0.0).alias("auc_pr"), "b.threshold", "b.tp",
                   (F.col("b._cum") - F.col("b.tp")).alias("fp"), (n - F.col("b._cum") + F.col("b.tp")).alias("tn"),
                   (p - F.col("b.tp")).alias("fn"))
    return confusion_metrics(out)


def evaluate_logs(scores: DataFrame, truth: DataFrame, miss_penalty: float = 0.0) -> DataFrame:
    """Log-level evaluation over all labelled logs; a log without a score takes ``miss_penalty``.

    ``scores(log_idx, log_type, score)``, ``truth(log_idx, log_type, attacks array)``
    with an empty array for benign logs. Per attack, all other logs are negative.
    """
    ids = ["log_idx", "log_type"]
    t = truth.join(scores.select(*ids, "score").withColumn("_has", F.lit(True)), ids, "left")
    t = t.withColumn("score", F.coalesce("score", F.lit(miss_penalty))).withColumn("_has", F.coalesce("_has", F.lit(False)))
    m = per_attack_metrics(t.select(*ids, "score"), truth.select(*ids, F.explode("attacks").alias("attack")), ids)
    n = t.agg(F.count(F.lit(1)).alias("logs"), F.count_if("_has").alias("extracted"), F.lit(0).alias("_all"))
    # exactly one row
    m = m.withColumn("_all", F.lit(0)).join(F.broadcast(n), "_all").drop("_all")
    return m.withColumn("missed", F.col("logs") - F.col("extracted")).withColumn("extraction_rate", ratio(F.col("extracted"), F.col("logs")))


def overall_metrics(df: DataFrame, hits: DataFrame, ident: str = "id", score: str = "score") -> DataFrame:
    """One row for a whole evaluation: positives, negatives, auc_roc, auc_pr and adp.

    ``df(ident, score)`` is one ranking (one row per ident), ``hits(ident, attack)`` names the attacks of its positives; a row is
    positive when any attack holds it. ADP runs over the attacks, so a row of two attacks counts for both.
    """
    own = hits.select(ident).distinct().withColumn("y", F.lit(1))
    marked = df.select(ident, F.col(score).alias("score")).join(own, ident, "left").withColumn("y", F.coalesce("y", F.lit(0)))
    # both sides have exactly one row
    adp = attack_detection_precision(marked, hits, ident)
    return ranking_metrics(marked).withColumn("_all", F.lit(0)).join(F.broadcast(adp.withColumn("_all", F.lit(0))), "_all").drop("_all")


def evaluate_logs_overall(scores: DataFrame, truth: DataFrame, miss_penalty: float = 0.0) -> DataFrame:
    """AUC, average precision and ADP over all labelled logs; a log without a score takes ``miss_penalty``.

    Tables as in ``evaluate_logs``; ties stand by log type, then log number.
    """
    ids = ["log_type", "log_idx"]
    t = truth.join(scores.select(*ids, "score"), ids, "left").select(
        F.struct(*ids).alias("id"), F.coalesce("score", F.lit(miss_penalty)).alias("score"), "attacks")
    t = cut(t)
    return overall_metrics(t.select("id", "score"), t.select("id", F.explode("attacks").alias("attack")))


def evaluate_nodes_overall(scores: DataFrame, sightings: DataFrame, gt: DataFrame) -> DataFrame:
    """AUC, average precision and ADP over all nodes; positives as in ``evaluate_nodes``."""
    best = cut(scores.groupBy("node").agg(F.max("score").alias("score")))
    return overall_metrics(best, nodes_on_date(sightings, gt).select("node", "attack"), "node")


def evaluate_nodes(scores: DataFrame, sightings: DataFrame, gt: DataFrame) -> DataFrame:
    """Node-level evaluation per attack: a node is positive when it is listed and seen on the attack day."""
    best = scores.groupBy("node").agg(F.max("score").alias("score"))
    return per_attack_metrics(best, nodes_on_date(sightings, gt), ["node"])


def ground_truth_summary(logs: DataFrame, *levels: str) -> DataFrame:
    """Malicious, benign and total logs at every level from the finest to the grand total."""
    bad = F.col("y") == 1
    return logs.rollup(*levels).agg(F.count_if(bad).alias("malicious"), F.count_if(~bad).alias("benign"), F.count(F.lit(1)).alias("total"))


def class_weights(labels: DataFrame, column: str) -> DataFrame:
    """Balanced class weights n / (classes · count)."""
    n = labels.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    n = with_group_stats(n, [], F.sum("n").alias("_all_n"), F.count(F.lit(1)).alias("_classes"))
    return n.select(column, "n", (F.col("_all_n") / (F.col("_classes") * F.col("n"))).alias("weight"))


def results_table(m: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Text form of a metric table; a missing value shows 'N/A'."""
    return m.select(*[c for c in m.columns if c not in columns],
                    *[F.when(F.col(c).isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f", F.col(c).cast("double"))).alias(c)
                      for c in columns])
