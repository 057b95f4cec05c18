"""Graph operators against brute force on small graphs."""

import numpy as np
import pytest

from traceloom.operators import graph as G
from traceloom.operators import lookup as J
from traceloom.operators import metrics as M
from traceloom.operators import profiles as P
from traceloom.session import cut


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(9)
    rows = [(i, f"n{a}", f"n{b}", f"EVENT_{'RW'[c]}") for i, (a, b, c) in enumerate(zip(rng.integers(0, 14, 60), rng.integers(0, 14, 60), rng.integers(0, 2, 60)))]
    return rows, spark.createDataFrame(rows, "log_idx long, src string, dst string, action string")


@pytest.mark.parametrize("cap", [1000, 3])
def test_causal_paths(spark, small, cap):
    rows, e = small
    types = {f"n{i}": f"t{i % 3}" for i in range(14) if i % 4}
    got = P.causal_profiles(e, spark.createDataFrame(list(types.items()), "node string, vtype string"), "log_idx", max_nodes=cap)
    adj = {}
    for _, s, d, a in rows:
        step = f"{a.lower()}_{types.get(d)}"
        if d in types and (d, step) not in adj.setdefault(s, []):
            adj[s].append((d, step))
    want = set()
    for start in types:
        if not adj.get(start):
            continue
        seen, queue, done = {start}, [(start, "")], 0
        while queue and done < cap:
            node, path = queue.pop(0)
            done += 1
            for d, step in adj.get(node, []):
                p = f"{path}|{step}" if path else step
                want.add((start, p))
                if d not in seen:
                    seen.add(d)
                    queue.append((d, p))
    assert {(r.node, r.pattern) for r in got.collect()} == want


def test_causal_levels_in_numbers(spark, head=2):
    """A head smaller than a level gives the paths of a plain search; a tree's row is numbers, and later nodes get a place only if needed."""
    rng = np.random.default_rng(4)
    rows = [(i, f"n{a}", f"n{b}", f"EVENT_{'RWX'[c]}") for i, (a, b, c) in enumerate(zip(rng.integers(0, 8, 30), rng.integers(0, 8, 30), rng.integers(0, 3, 30)))]
    rows += [(30 + i, f"n{a}", f"n{b}", "EVENT_R") for i, (a, b) in enumerate([(54, 60 + k) for k in range(6)] + [(62, 54)])]
    types = {f"n{i}": f"t{i % 3}" for i in range(70) if i % 7}
    e = spark.createDataFrame(rows, "log_idx long, src string, dst string, action string")
    kinds = spark.createDataFrame(list(types.items()), "node string, vtype string")
    got = P.causal_profiles(e, kinds, "log_idx", head=head)
    adj, every = {}, {}
    for _, s, d, a in rows:
        if d in types:
            step = f"{a.lower()}_{types[d]}"
            adj.setdefault(s, {}).setdefault(d, step)
            every.setdefault(s, set()).add(step)
    want = set()
    for start in types:
        paths, queue = {start: ""}, [start]
        for node in queue:
            want |= {(start, f"{paths[node]}|{step}" if paths[node] else step) for step in every.get(node, ())}
            for d, step in adj.get(node, {}).items():
                if d not in paths:
                    paths[d] = f"{paths[node]}|{step}" if paths[node] else step
                    queue.append(d)
    out = [(r.node, r.pattern) for r in got.collect()]
    assert len(out) == len(set(out)) and set(out) == want
    nodes, steps, edges, _ = P.numbered_graph(e, kinds, "log_idx")
    levels = P.causal_levels(nodes, steps, edges, head=head)
    next(levels)
    front = next(levels)[0]
    assert set(dict(front.dtypes).values()) == {"bigint"}
    assert front.filter("pos is not null").groupBy("start").count().agg({"count": "max"}).first()[0] <= head


@pytest.mark.parametrize("bounds", [{}, {"max_depth": 2}, {"max_nodes": 5}])
def test_causal_search_in_tasks(spark, monkeypatch, bounds):
    """Starts searched in tasks give the patterns of the search in tables, and no row of a tree is written or moved."""
    from traceloom.operators import causal_search as S
    rng = np.random.default_rng(6)
    rows = [(i, f"n{a}", f"n{b}", f"EVENT_{c}") for i, (a, b, c) in enumerate(zip(rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.integers(0, 90, 150)))]
    rows += [(200 + i, f"n{41 + i}", f"n{42 + i}", "") for i in range(12)] + [(300, None, "n1", "EVENT_1"), (301, "n1", "n1", "EVENT_2|t1")]
    e = spark.createDataFrame(rows, "log_idx long, src string, dst string, action string")
    kinds = spark.createDataFrame([(f"n{i}", f"t{i % 3}") for i in range(60) if i % 7] + [("n1", "t1|t2")], "node string, vtype string")
    want = sorted(map(tuple, P.causal_profiles(e, kinds, "log_idx", **bounds, held=0).collect()))
    for name, most in (("EDGES", 3), ("TEXTS", 50), ("ROWS", 40)):
        monkeypatch.setattr(S, name, most)
    with monkeypatch.context() as m:
        m.setattr(P, "causal_levels", None)  # not called
        got = P.causal_profiles(e, kinds, "log_idx", **bounds)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300


def test_causal_search_of_a_hub():
    """Levels beyond one chunk of edges, from either side, enter nodes in the order of a queue."""
    from traceloom.operators.causal_search import Search
    rng = np.random.default_rng(3)
    # starts to hubs, hubs to many, many back to hubs: bipartite as logs are
    src = np.concatenate([rng.integers(0, 300, 1500), rng.integers(300, 330, 9000)])
    dst = np.concatenate([rng.integers(300, 330, 1500), rng.integers(0, 300, 9000)])
    src, dst = (x[np.sort(np.unique(src * 1000 + dst, return_index=True)[1])] for x in (src, dst))
    order = np.lexsort((rng.random(len(src)), src))
    src, dst, code = src[order].astype(np.int32), dst[order].astype(np.int32), rng.integers(0, 70, len(order)).astype(np.int32)
    sets = {}
    for s, c in zip(src.tolist(), code.tolist()):
        sets[s, c // 64] = sets.get((s, c // 64), 0) | 1 << c % 64
    sets = np.array([[s, w, m - (1 << 64) * (m >= 1 << 63)] for (s, w), m in sets.items()], np.int64).T
    search = Search([np.stack([src, dst, code])[:, i:i + 700].tobytes() for i in range(0, len(src), 700)], [sets.tobytes()], [f"s{i}".encode() for i in range(70)])
    out = {}
    for a, b, c in zip(src.tolist(), dst.tolist(), code.tolist()):
        out.setdefault(a, []).append((b, c))
    for start in (0, 7, 305):
        search.add(start, str(start))
        got = [p for b in search.rows() for p in b.column(1).to_pylist()]
        paths, queue, want = {start: ""}, [start], set()
        for node in queue:
            for b, c in out.get(node, []):
                text = f"{paths[node]}|s{c}" if paths[node] else f"s{c}"
                want.add(text)
                if b not in paths:
                    paths[b] = text
                    queue.append(b)
        assert len(got) == len(set(got)) and set(got) == want and len(queue) > 300


def test_split_parts(spark, small):
    rows, e = small
    from pyspark.sql import functions as F
    g = e.withColumn("graph", F.lit("g"))
    parts = G.split_parts(g, "graph", 4)
    p = parts.toPandas()
    assert p.groupby("part").size().max() <= 4 and p.node.is_unique
    edges = G.part_edges(g, parts, "graph").collect()
    at = dict(zip(p.node, p.part))
    assert len(edges) == len(rows) and all(r.part == max(at[r.src], at[r.dst]) for r in edges)
    order = G.part_order(G.part_links(g, parts, "graph"), parts, "graph").toPandas().sort_values("position")
    assert sorted(order.part) == sorted(p.part.unique()) and order.part.iloc[0] == 0
    adj = {}
    for _, a, b, _ in rows:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    for r in parts.collect():
        assert r.incoming == any(at[n] < r.part for n in adj[r.node]) and r.outgoing == any(at[n] > r.part for n in adj[r.node])


def test_part_order(spark):
    """Against a heap of free parts, with cycles and self links."""
    import heapq
    rng = np.random.default_rng(2)
    links, parts, want = [], [], []
    for g in range(12):
        n = int(rng.integers(1, 9))
        own = {(int(a), int(b)) for a, b in rng.integers(0, n, (int(rng.integers(0, 9)), 2)) if g % 3 == 0 or a < b or (g % 3 == 1 and a != b and a % 2)}
        links += [(g, a, b) for a, b in own]
        parts += [(g, i) for i in range(n)]
        need = {i: {a for a, b in own if b == i} for i in range(n)}
        ready, done = [i for i in need if not need[i]], []
        while ready:
            x = heapq.heappop(ready)
            done.append(x)
            for m in need:
                if x in need[m]:
                    need[m].discard(x)
                    if not need[m]:
                        heapq.heappush(ready, m)
        done += sorted(set(need) - set(done))
        want += [(g, x, i) for i, x in enumerate(done)]
    got = G.part_order(spark.createDataFrame(links, "graph long, from_part long, to_part long"), spark.createDataFrame(parts, "graph long, part long"), "graph")
    assert sorted((r.graph, r.part, r.position) for r in got.collect()) == sorted(want)


def test_extract_subgraphs(spark, small):
    rows, e = small
    score = spark.createDataFrame([(f"n{i}", float(i)) for i in range(14)], "node string, score double")
    out = G.extract_subgraphs(e, score, 8.0, seeds=4, min_nodes=3, max_edges=500).toPandas()
    assert len(out) and out["rank"].min() == 0
    for _, g in out.groupby("subgraph"):
        nodes = set(g.src) | set(g.dst)
        assert len(nodes) >= 3
        s = [float(n[1:]) if float(n[1:]) >= 8 else 0.0 for n in nodes]
        assert g.anomaly_score.iloc[0] == pytest.approx(0.7 * np.mean(s) + 0.3 * max(s))


def test_communities_split(spark):
    clique = lambda names: [(a, b) for a in names for b in names if a < b]
    pairs = clique([f"a{i}" for i in range(5)]) + clique([f"b{i}" for i in range(5)]) + [("a0", "b0")]
    e = spark.createDataFrame([("s", a, b, "x") for a, b in pairs], "subgraph string, src string, dst string, action string")
    out = G.split_communities(e, 12).toPandas()
    assert out.subgraph.nunique() == 2 and len(out) == 20
    out = G.split_communities(e, 6).toPandas()
    assert out.groupby("subgraph").size().tolist() == [6, 4, 6, 4]  # a clique is dealt out whole


def test_names_containing_matches_brute_force(spark):
    names = ["C:/Payload.exe", "x.evil.com", "plain", "a", "EVIL"]
    labels = ["payload.exe", "evil", "a", "longer than any name in the table"]
    got = J.names_containing(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(x,) for x in labels], "label string"))
    assert {r.name for r in got.collect()} == {n for n in names if any(x in n.lower() for x in labels)}


def test_per_attack_metrics_match_one_against_rest(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(0, 30)), "ab"[i % 2] if i % 5 == 0 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, score double, attack string")
    got = {r.attack: r for r in M.per_attack_metrics(df.select("id", "score"), df.filter("attack IS NOT NULL").select("id", "attack"), ["id"]).collect()}
    for a in "ab":
        one = df.selectExpr("score", f"cast(coalesce(attack = '{a}', false) as int) as y")
        m, b = M.ranking_metrics(one).first(), M.best_f1(one).first()
        assert got[a].auc_roc == pytest.approx(m.auc_roc) and got[a].auc_pr == pytest.approx(m.auc_pr)
        assert (got[a].threshold, got[a].tp, got[a].fp, got[a].tn, got[a].fn) == (b.threshold, b.tp, b.fp, b.tn, b.fn)


def test_one_class_only_gives_zero(spark):
    m = M.ranking_metrics(spark.createDataFrame([(1.0, 0), (2.0, 0)], "score double, y int")).first()
    assert (m.auc_roc, m.auc_pr) == (0.0, 0.0)


def test_duplicate_subgraphs_of_many_edges(spark):
    """Sums of the hashes of more than some thousand edges exceed a long."""
    from pyspark.sql import functions as F
    e = spark.range(20000).select(F.concat(F.lit("a"), "id").alias("src"), F.concat(F.lit("b"), "id").alias("dst"), F.lit("R").alias("action"))
    other = e.withColumn("dst", F.when(F.col("src") == "a7", "c").otherwise(F.col("dst")))
    g = e.withColumn("subgraph", F.lit("y")).union(e.withColumn("subgraph", F.lit("x"))).union(other.withColumn("subgraph", F.lit("z")))
    assert {r.subgraph for r in G.drop_duplicate_subgraphs(g).select("subgraph").distinct().collect()} == {"x", "z"}


def test_coloured_lines_are_not_gathered_by_graph(spark):
    """Lines are numbered in slices, and the last line of a graph is found by its number: no join or window brings all lines of a graph together."""
    from traceloom.plans.catalog.graph import _dot
    from traceloom.plans.views import Tables
    e = G.coloured_edges(_dot(Tables(spark, "/root/testdata/sf0.001")).withColumnRenamed("no", "line_no"), "graph", "line_no")
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(log_type" not in plan
    joins = [x for x in plan.split("\n") if "LeftAnti" in x]
    assert joins and all("= _last" in x for x in joins)
    assert not any("Join Inner" in x and "_g_graph" in x for x in plan.split("\n"))


def test_coloured_edges_of_a_graph_without_name(spark):
    lines = ["digraph {", "a", "b", '"a" [color=red label="x"]', '"b" [color=blue label="y"]', '"a" -> "b" [label=R color=blue]', "}"]
    d = spark.createDataFrame([(g, i, x) for g in ("g", None) for i, x in enumerate(lines)], "graph string, line_no long, line string")
    got = G.coloured_edges(d, "graph", "line_no").collect()
    assert sorted((r.graph or "", r.no, r.src, r.dst, r.action, r.any_red) for r in got) == [("", 0, "x", "y", "R", True), ("g", 0, "x", "y", "R", True)]


def test_breadth_levels_of_a_path(spark, monkeypatch):
    """Roots and hops are the names' and ints again; a round's minimum is over longs, which needs no sort."""
    rows = [(g, f"{g}{i:02d}", f"{g}{i + 1:02d}") for g in "ab" for i in range(9)]
    both = spark.createDataFrame([r for g, x, y in rows for r in ((g, x, y), (g, y, x))], "graph string, node string, nb string")
    written = []
    monkeypatch.setattr(G, "cut", lambda df: written.append(df) or cut(df))
    got = {(r.graph, r.node): (r.root, r.dist) for r in G.breadth_levels(both, "graph").collect()}
    assert got == {(g, f"{g}{i:02d}"): (f"{g}00", i) for g in "ab" for i in range(10)}
    assert "SortAggregate" not in written[-1]._jdf.queryExecution().executedPlan().toString()
