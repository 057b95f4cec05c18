"""Vector, feature and projection queries."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from traceloom.functions import names as N
from traceloom.functions import vectors as VF
from traceloom.operators import aggregates as A
from traceloom.operators import lookup as J
from traceloom.operators import profiles as P
from traceloom.operators import time_windows as W
from traceloom.operators import vectors as V
from traceloom.plans.registry import query

# Vectors of the first half of the labels are the known (train, typed) side; all vectors are scored.
def _train(t):
    return t.vecs.filter("label < 5").select("id", "v")


def _joined(df, column="v", digits=6):
    text = F.transform(column, lambda x: F.format_string(f"%.{digits}f", F.round(x.cast("double"), digits) + F.lit(0.0)))
    return df.withColumn(column, F.array_join(text, ","))


@query("l2_normalize", """
SELECT id, round(sqrt(list_sum([x::DOUBLE * x for x in v])) , 6) AS n0, round(v[1]::DOUBLE * 3 / (sqrt(list_sum([x::DOUBLE * x * 9 for x in v])) + 1e-12), 6) AS first FROM vecs""", "vecs")
def _(t):
    d = t.vecs.select("id", "v", F.transform("v", lambda x: x.cast("double") * 3).alias("w"))
    d = V.normalize_rows(d, "w")
    return d.select("id", F.round(VF.norm(F.col("v")), 6).alias("n0"), F.round(F.get("w", F.lit(0)), 6).alias("first"))


@query("z_scores", """
WITH s AS (SELECT i, avg(v[i]) AS m, stddev_pop(v[i]) AS sd FROM (SELECT v, unnest(range(1, 65)) AS i FROM vecs WHERE label < 5) GROUP BY i)
SELECT id, round(sum((v[i] - m) / (sd + 1e-6) * i), 4) AS z FROM vecs, s GROUP BY id""", "vecs")
def _(t):
    z = V.z_scores(t.vecs.select("id", "v"), V.dimension_stats(_train(t)))
    weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return z.select("id", F.round(weighted, 4).alias("z"))


KNN = """
s AS (SELECT i, avg(v[i]::DOUBLE) AS m, stddev_pop(v[i]::DOUBLE) + 1e-6 AS sd FROM (SELECT v, unnest(range(1, 65)) AS i FROM vecs WHERE label < 5) GROUP BY i),
ss AS (SELECT list(m ORDER BY i) AS m, list(sd ORDER BY i) AS sd FROM s),
z AS (SELECT id, label, list_transform(range(1, 65), lambda i: (v[i]::DOUBLE - m[i]) / sd[i]) AS z FROM vecs, ss),
d AS (SELECT a.id, a.label, b.id AS b, list_distance(a.z, b.z) AS d FROM z a, z b WHERE b.label < 5),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, b) AS rn FROM d)"""


@query("knn_scores", f"""
WITH {KNN} SELECT id, round(avg(d) / (SELECT avg(d) FROM k WHERE rn <= 10 AND label < 5), 6) AS score FROM k WHERE rn <= 10 GROUP BY id""", "vecs")
def _(t):
    return V.knn_scores(_train(t), t.vecs.select("id", "v")).withColumn("score", F.round("score", 6))


@query("nearest_rows", """
SELECT qid, tid, round(distance, 6) AS distance FROM (SELECT a.id AS qid, b.id AS tid, list_distance(a.v::DOUBLE[], b.v::DOUBLE[]) AS distance,
 row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v::DOUBLE[], b.v::DOUBLE[]), b.id) AS rn FROM vecs a, vecs b WHERE b.label < 5) WHERE rn <= 3""", "vecs")
def _(t):
    d = V.nearest(t.vecs.select("id", F.col("v").cast("array<double>").alias("v")), _train(t).select("id", F.col("v").cast("array<double>").alias("v")), 3, block_rows=64, query_rows=50)
    return d.withColumn("distance", F.round("distance", 6))


@query("nearest_hashed_recall", """
SELECT count(*) AS n_queries, 3 * count(*) AS n_pairs, true AS complete, true AS recall_reached FROM vecs""", "vecs")
def _(t):
    q, tr = (x.select("id", F.col("v").cast("array<double>").alias("v")) for x in (t.vecs, _train(t)))
    plan = V.fit_hashes(q, tr, 3, recall=0.95, bucket_rows=32)
    found, true = V.nearest_hashed(q, tr, 3, plan), V.nearest(q, tr, 3)
    hits = found.join(true.select("qid", "tid", F.lit(1).alias("hit")), ["qid", "tid"], "left")
    per = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    return per.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n").alias("n_pairs"), (F.min("n") == 3).alias("complete"),
                   (F.sum("hits") / F.sum("n") >= 0.95).alias("recall_reached"))


@query("nearest_type_transfer", """
WITH m AS (SELECT a.id AS qid, arg_max(b.id, round(list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]), 9)) AS tid, max(list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[])) AS s
 FROM vecs a, vecs b WHERE a.label >= 5 AND b.label < 5 GROUP BY a.id)
SELECT qid AS node, 'type_' || t.label AS vtype, 'func_' || (t.id % 7) AS functionality, tid AS inherited_from, round(s, 6) AS similarity, 1::BIGINT AS n_candidates
FROM m JOIN vecs t ON t.id = m.tid""", "vecs")
def _(t):
    m = V.most_similar(t.vecs.filter("label >= 5").select("id", "v"), _train(t))
    typed = t.vecs.select(F.col("id").alias("node"), F.concat(F.lit("type_"), "label").alias("vtype"), F.concat(F.lit("func_"), F.col("id") % 7).alias("functionality"))
    return V.transfer_labels(m, typed).withColumn("similarity", F.round("similarity", 6))


@query("tie_break_by_names", """
WITH n AS (SELECT id, v, label, 'n' || (id % 40) AS name FROM vecs),
nv AS (SELECT 'n' || (id % 40) AS name, min_by(v::DOUBLE[], id) AS v FROM vecs GROUP BY 1),
c AS (SELECT q.id AS qid, q.name AS qname, t.id AS tid, t.name AS tname FROM n q, n t WHERE q.label >= 5 AND t.label < 5 AND q.label % 5 = t.label % 5 AND t.id % 3 <> 0),
w AS (SELECT c.qid, c.tid, row_number() OVER (PARTITION BY c.qid ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, c.tname, c.tid) AS rn,
  count(*) OVER (PARTITION BY c.qid) AS x FROM c JOIN nv a ON a.name = c.qname JOIN nv b ON b.name = c.tname)
SELECT w.qid, w.tid, 1.0::DOUBLE AS similarity, (SELECT count(*) FROM n t, n q WHERE q.id = w.qid AND t.label < 5 AND t.label = q.label % 5) AS n_candidates FROM w WHERE rn = 1""", "vecs")
def _(t):
    # profiles repeat: every vector of a label class is the same one-hot row, so all of a class tie
    prof = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == F.col("label") % 5, 1.0).otherwise(0.0))
    rows = t.vecs.select("id", prof.alias("v"), "label", F.concat(F.lit("n"), F.col("id") % 40).alias("name"))
    q, typed = rows.filter("label >= 5"), rows.filter("label < 5")
    nv = t.vecs.groupBy(F.concat(F.lit("n"), F.col("id") % 40).alias("name")).agg(F.min_by("v", "id").alias("v"))
    # names whose holder id is a multiple of three carry no type
    named = typed.filter("id % 3 <> 0").select("id", "name")
    out = V.infer_types(q.select("id", "v"), typed.select("id", "v"), q.select("id", "name"), named, nv, named.select("name").distinct())
    return out.withColumn("similarity", F.round("similarity", 6))


@query("one_class_scores", """
WITH s AS (SELECT i, avg(v[i]::DOUBLE) AS m FROM (SELECT v, unnest(range(1, 65)) AS i FROM vecs WHERE label < 5) GROUP BY i),
c AS (SELECT list(CASE WHEN abs(m) >= 0.1 THEN m WHEN m < 0 THEN -0.1 ELSE 0.1 END ORDER BY i) AS c FROM s)
SELECT id, round(list_sum([(v[i]::DOUBLE - c[i]) * (v[i]::DOUBLE - c[i]) for i in range(1, 65)]), 6) AS score FROM vecs, c""", "vecs")
def _(t):
    return V.one_class_scores(_train(t), t.vecs).withColumn("score", F.round("score", 6))


@query("min_max_scaled", """
WITH g AS (SELECT node, count(*) AS n, max(score) AS top, 1.0::DOUBLE AS flat FROM scores GROUP BY node), s AS (SELECT min(n) AS a, max(n) AS b, min(top) AS c, max(top) AS d FROM g)
SELECT node, round((n - a) / (b - a)::DOUBLE, 6) AS n, round((top - c) / (d - c), 6) AS top, 0.0::DOUBLE AS flat FROM g, s""", "scores")
def _(t):
    g = t.scores.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.lit(1.0).alias("flat"))
    out = V.apply_min_max(g, V.fit_min_max(g, ["n", "top", "flat"]), ["n", "top", "flat"])
    return out.select("node", F.round("n", 6).alias("n"), F.round("top", 6).alias("top"), "flat")


@query("margin_confidence", """
WITH m AS (SELECT id, label, (list_sort(v, 'DESC')[1]::DOUBLE - list_sort(v, 'DESC')[2]::DOUBLE) / (list_sort(v, 'DESC')[1]::DOUBLE + 1e-12) AS m FROM vecs)
SELECT id, label, round((m - min(m) OVER (PARTITION BY label)) / (max(m) OVER (PARTITION BY label) - min(m) OVER (PARTITION BY label)), 6) AS confidence FROM m""", "vecs")
def _(t):
    d = t.vecs.select("id", "label", F.col("v").cast("array<double>").alias("class_scores"))
    return V.margin_confidence(d, ["label"]).select("id", "label", F.round("confidence", 6).alias("confidence"))


@query("embedding_matrix", """
WITH n AS (SELECT DISTINCT src AS name FROM edges)
SELECT n.name, dense_rank() OVER (ORDER BY n.name) - 1 AS "row", round(coalesce(v.v[3], 0)::DOUBLE, 6) AS v3 FROM n LEFT JOIN vecs v ON n.name = 'U' || v.id""", "edges vecs")
def _(t):
    m = V.embedding_matrix(t.edges.select(F.col("src").alias("name")), t.vecs.select(F.concat(F.lit("U"), "id").alias("name"), "v"), 64)
    return m.select("name", "row", F.round(F.get("v", F.lit(2)).cast("double"), 6).alias("v3"))


@query("edge_message_vectors", """
WITH c AS (SELECT action, dense_rank() OVER (ORDER BY action) - 1 AS code FROM (SELECT DISTINCT action FROM edges)),
x AS (SELECT id, [v[1]::DOUBLE, v[2]::DOUBLE] AS v FROM vecs)
SELECT e.log_idx, len(s.v) + (SELECT count(*) FROM c) + len(d.v) AS size, c.code AS hot, round(s.v[1] + 2 * d.v[2], 6) AS mix FROM edges e JOIN x s ON e.src = 'U' || s.id OR e.src = 'K' || s.id
JOIN x d ON e.dst = 'K' || d.id OR e.dst = 'U' || d.id JOIN c ON c.action = e.action""", "edges vecs")
def _(t):
    two = t.vecs.select("id", F.slice("v", 1, 2).alias("v"))
    nodes = two.select(F.explode(F.array(F.concat(F.lit("U"), "id"), F.concat(F.lit("K"), "id"))).alias("node"), "v")
    m = V.edge_messages(t.edges.select("log_idx", "src", "dst", "action"), nodes, A.encode_labels(t.edges, "action"))
    hot = VF.hot_position(F.slice("msg", F.lit(3), F.size("msg") - 4))
    return m.select("log_idx", F.size("msg").alias("size"), hot.alias("hot"), F.round(F.get("msg", F.lit(0)) + 2 * F.element_at("msg", -1), 6).alias("mix"))


@query("hashed_name_features", """
SELECT name, array_to_string([CAST(list_sum([CASE WHEN c % 16 <> b THEN 0 WHEN (c // 16) % 2 = 0 THEN 1 ELSE -1 END for c in codes])::BIGINT AS VARCHAR) for b in range(0, 16)], ',') AS buckets
FROM (SELECT name, [('0x' || substr(md5(x), 1, 8))::BIGINT for x in string_split(name, '')] AS codes FROM names)""", "names")
def _(t):
    b = VF.hashed_buckets(F.filter(F.split("name", ""), lambda x: x != ""))
    return t.names.select("name", F.array_join(F.transform(b, lambda x: x.cast("long").cast("string")), ",").alias("buckets"))


@query("hashed_prefix_features", """
SELECT name, array_to_string([CAST(list_sum([CASE WHEN c % 16 <> b THEN 0 WHEN (c // 16) % 2 = 0 THEN 1 ELSE -1 END for c in codes])::BIGINT AS VARCHAR) for b in range(0, 16)], ',') AS buckets
FROM (SELECT name, [('0x' || substr(md5(array_to_string((string_split(name, '/'))[1:i], '/')), 1, 8))::BIGINT for i in range(1, len(string_split(name, '/')) + 1)] AS codes FROM names)""", "names")
def _(t):
    b = VF.hashed_buckets(N.prefixes(F.col("name"), "/"))
    return t.names.select("name", F.array_join(F.transform(b, lambda x: x.cast("long").cast("string")), ",").alias("buckets"))


@query("one_hot_actions", """
WITH c AS (SELECT action, dense_rank() OVER (ORDER BY action) - 1 AS code FROM (SELECT DISTINCT action FROM edges))
SELECT log_idx, array_to_string([CASE WHEN i = code THEN '1' ELSE '0' END for i in range(0, 5)], '') AS hot FROM edges e JOIN c ON c.action = e.action""", "edges")
def _(t):
    e = t.edges.select("log_idx", "action").join(A.encode_labels(t.edges, "action"), "action")
    hot = VF.one_hot(F.col("code").cast("int"), F.lit(5))
    return e.select("log_idx", F.array_join(F.transform(hot, lambda x: x.cast("int").cast("string")), "").alias("hot"))


DEG = ", ".join(f"count(*) FILTER (f = '{s}_{k}') AS {s}_{k}" for k in ("execute", "open", "read", "write", "sendto") for s in ("out", "in"))
DEG_FROM = """FROM (SELECT src AS node, 'out_' || lower(replace(action, 'EVENT_', '')) AS f FROM edges UNION ALL SELECT dst, 'in_' || lower(replace(action, 'EVENT_', '')) FROM edges) GROUP BY node"""


@query("degree_features", f"SELECT node, {DEG} {DEG_FROM}", "edges")
def _(t):
    return V.degree_features(t.edges)


@query("degree_counts", """
SELECT node, feature, count(*) AS n FROM (SELECT src AS node, 'out_' || lower(action) AS feature FROM edges_big UNION ALL SELECT dst, 'in_' || lower(action) FROM edges_big) GROUP BY ALL""", "edges_big")
def _(t):
    return V.degree_counts(t.edges_big)


_nm = ["{s}_{k}".format(s=s, k=k) for k in ("execute", "open", "read", "write", "sendto") for s in ("out", "in")]
_sq = "sqrt(" + " + ".join(f"{c} * {c}" for c in _nm) + ")::DOUBLE"


@query("node_features", f"""
WITH d AS (SELECT node, {DEG} {DEG_FROM}),
g AS (SELECT * FROM (WITH s AS (SELECT src AS node, ts_ns FROM edges UNION SELECT dst, ts_ns FROM edges),
 p AS (SELECT node, (ts_ns - lag(ts_ns) OVER (PARTITION BY node ORDER BY ts_ns)) / 1000000000.0::DOUBLE AS gap FROM s)
 SELECT node, coalesce(round_even(avg(gap) FILTER (gap >= 1), 0), 0) AS avg_idle_time, coalesce(round_even(sum(gap), 0), 0) AS lifespan FROM p GROUP BY node))
SELECT d.node, {", ".join(f"round({c} / {_sq}, 6) AS {c}" for c in _nm)},
 round((avg_idle_time - min(avg_idle_time) OVER ()) / (max(avg_idle_time) OVER () - min(avg_idle_time) OVER ()), 6) AS avg_idle_time,
 round((lifespan - min(lifespan) OVER ()) / (max(lifespan) OVER () - min(lifespan) OVER ()), 6) AS lifespan FROM d JOIN g ON g.node = d.node""", "edges")
def _(t):
    f = V.degree_features(t.edges)
    kinds = [c for c in f.columns if c != "node"]
    f = V.normalize_columns(f, kinds).join(W.gap_features(t.edges).select("node", "avg_idle_time", "lifespan"), "node")
    f = V.apply_min_max(f, V.fit_min_max(f, ["avg_idle_time", "lifespan"]), ["avg_idle_time", "lifespan"])
    return f.select("node", *[F.round(c, 6).alias(c) for c in f.columns if c != "node"])


# --- forms without a SQL twin ------------------------------------------------------------------

@query("farthest_seeds")
def _(t):
    v = t.vecs.select("id", "v", F.concat(F.lit("w"), F.floor(F.col("id") / 100)).alias("window_key"), (F.col("label") % 3).alias("log_type"))
    return V.farthest_seeds(v, ["window_key", "log_type"], 8)


@query("pca_projection")
def _(t):
    out, _ = V.pca_project(_train(t), t.vecs, 8)
    return _joined(out.select("id", "v"), digits=4)


@query("node_phrases", """
WITH w AS (SELECT unnest([src, dst]) AS node, unnest([0, 1]) AS side, ts_ns, log_idx, [x for x in [coalesce(s.functionality, ''), action, coalesce(d.functionality, '')] if x <> ''] AS ws
 FROM edges e LEFT JOIN types s ON s.node = e.src LEFT JOIN types d ON d.node = e.dst),
u AS (SELECT node, side, ts_ns, log_idx, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)
SELECT node, row_number() OVER (PARTITION BY node ORDER BY ts_ns, log_idx, side, i) - 1 AS pos, word FROM u""", "edges types")
def _(t):
    return V.node_phrases(_message_edges(t), ["ts_ns", "log_idx"])


def _message_edges(t):
    return J.add_messages(t.edges.select("log_idx", "ts_ns", "src", "dst", "action"), t.types.select(F.col("node").alias("id"), F.col("functionality").alias("message")))


@query("word2vec_nodes")
def _(t):
    from traceloom.session import cut
    phrases = cut(V.node_phrases(_message_edges(t), ["ts_ns", "log_idx"]))
    words = V.word_vectors(V.phrase_sentences(phrases), 30)
    return _joined(V.phrase_vectors(phrases, words, 30), digits=4)


@query("svd_profiles")
def _(t):
    prof = P.one_hop_profiles(t.edges, t.types.select("node", "vtype"), None)
    docs = prof.groupBy("node").agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))
    model = CountVectorizer(inputCol="patterns", outputCol="features", binary=True).fit(docs)
    f = model.transform(docs)
    sparse = P.sparse_parts(f)
    sample = W.sample_per_group(f.join(t.types.select("node", "vtype"), "node"), ["vtype"], 1000, "svd", "node")
    return _joined(V.truncated_svd(sparse, sample, 6).select("node", "v"), digits=4)
