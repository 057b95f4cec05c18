"""Behaviour profiles: which typed neighbours a node acts on, and how."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.operators.causal_search import Search
from traceloom.operators.common import top_rows, with_group_stats
from traceloom.operators.ordered import row_index
from traceloom.session import cut, keep, scratch


def assign_types(rows: DataFrame, validity: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed and untyped nodes from the names seen with them.

    ``rows(node, seq, names array)`` hold processed names, ``validity(name, class)``
    and ``features(name, vtype, functionality)`` are lookups. The first row that
    yields a type decides; its distinct types (and functionalities) join with '|'
    in name order. A node is untyped when a row before its first typed row had a
    usable name; such a node may still become typed later and then is in both tables.
    """
    lists = rows.groupBy("node", "names").agg(F.min("seq").alias("seq"))
    n = lists.select("node", "seq", F.posexplode("names").alias("pos", "name")).join(validity, "name")
    letters = F.length("name") - F.length(F.regexp_replace("name", r"\p{L}", ""))
    weak = (letters < 3) | ~F.contains("name", F.lit("/")) | ~F.contains("name", F.lit("."))
    n = n.filter((F.col("class") != "INVALID") | ~weak).join(features, "name", "left")
    good = F.col("class") != "INVALID"
    t = F.when(good & (F.col("vtype") != "") & ~F.upper("vtype").isin("NO LABEL", "NO_LABEL"), F.lower("vtype"))
    f = F.when(good & (F.col("functionality") != ""), F.col("functionality"))

    def ordered(c: Column, name: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("pos", c.alias("x")))))
        return F.array_join(F.array_distinct(F.transform(found, lambda s: s["x"])), "|").alias(name)

    per = n.groupBy("node", "seq").agg(ordered(t, "vtype"), ordered(f, "functionality"))
    first = F.min(F.when(F.col("vtype") != "", F.col("seq")))
    per = with_group_stats(per, ["node"], first.alias("_first"))
    typed = per.filter(F.col("seq") == F.col("_first")).select("node", "vtype", F.when(F.col("functionality") != "", F.col("functionality")).alias("functionality"))
    untyped = per.filter((F.col("vtype") == "") & (F.col("_first").isNull() | (F.col("seq") < F.col("_first")))).select("node").distinct()
    return typed, untyped


def one_hop_profiles(e: DataFrame, types: DataFrame, untyped: DataFrame | None) -> DataFrame:
    """Distinct (node, pattern): 'act_type' for a source, 'act_by_type' for a target.

    The neighbour must be typed; profiles exist for typed nodes and for ``untyped``.
    """
    act = F.lower("action")
    pairs = e.select("src", "dst", act.alias("act")).distinct()
    s = types.select(F.col("node").alias("src"), F.col("vtype").alias("_st"))
    d = types.select(F.col("node").alias("dst"), F.col("vtype").alias("_dt"))
    out = pairs.join(d, "dst").select(F.col("src").alias("node"), F.concat_ws("_", "act", "_dt").alias("pattern"))
    inc = pairs.join(s, "src").select(F.col("dst").alias("node"), F.concat_ws("_by_", "act", "_st").alias("pattern"))
    owners = types.select("node")
    if untyped is not None:
        owners = owners.union(untyped.select("node"))
    return out.union(inc).distinct().join(owners.distinct(), "node", "left_semi")


SALTS = 16  # parts of a node's starts
HELD = 20 << 20  # edges and steps of nodes of a graph that a task holds whole, some 20 bytes each
WAY = 31  # bits of an edge's number in a way: a place in the queue and an edge, which sort as one long


def numbered_graph(e: DataFrame, types: DataFrame, seq: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Typed out-edges in numbers: nodes (name, id, typed), steps (step, code), edges (edge, src, dst, code), sets (node, word, mask).

    An edge leads to a typed node. Of several between two nodes the earliest stays in ``edges``; their numbers ascend by source, then
    time, step and target. ``sets`` has all distinct steps out of a node as bits, 64 codes to a word.
    """
    t = types.select(F.col("node").alias("dst"), F.col("vtype").alias("_t"))
    typed = cut(e.filter("src IS NOT NULL").select("src", "dst", F.lower("action").alias("act"), F.col(seq).alias("_s")).join(t, "dst").select(
        "src", "dst", F.concat_ws("_", "act", "_t").alias("step"), "_s"))
    adj = cut(typed.groupBy("src", "dst").agg(F.min_by("step", F.struct("_s", "step")).alias("step"), F.min("_s").alias("_s")))
    names = adj.select(F.col("src").alias("name")).union(adj.select("dst")).distinct()
    known = types.select(F.col("node").alias("name"), F.lit(True).alias("typed")).distinct()
    nodes = cut(row_index(names, [], ["name"], "id").join(known, "name", "left").select("name", "id", F.coalesce("typed", F.lit(False)).alias("typed")))
    steps = cut(row_index(typed.select("step").distinct(), [], ["step"], "code"))
    src, dst = (nodes.select(F.col("name").alias(c), F.col("id").alias("_" + c)) for c in ("src", "dst"))
    edges = cut(row_index(adj, [], ["src", "_s", "step", "dst"], "edge").join(src, "src").join(dst, "dst").join(steps, "step").select(
        "edge", F.col("_src").alias("src"), F.col("_dst").alias("dst"), "code"))
    sets = cut(typed.select("src", "step").distinct().join(src, "src").join(steps, "step").groupBy(
        F.col("_src").alias("node"), F.expr("code div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(code % 64 AS INT))")).alias("mask")))
    return nodes, steps, edges, sets


def causal_levels(nodes: DataFrame, steps: DataFrame, edges: DataFrame, max_depth: int | None = None, max_nodes: int | None = None,
                  head: int = 64) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Breadth-first trees from every typed node of a ``numbered_graph``, a level at a time: rows (start, node, way, pos, path), texts (path, text).

    From a start node only typed neighbours along out-edges are followed; each is entered once, by the earliest parent, then edge.
    ``pos`` ascends along the start's queue; it is the place there with ``max_nodes``. All start nodes advance together, with or without a bound of depth. A row is some numbers:
    equal paths share one, and a text is built once for a path. The way that enters a node is the least of one long, so most
    edges of a level end in the map-side aggregate; nodes entered before take part with a lesser one. The first ``head`` nodes of a level
    go before its others, as they enter most of what is left, and a start that has entered all targets of edges is done. The others get
    a ``pos`` only where their start is not done by then, from a range-partitioned scan, so such a start is spread over tasks.
    """
    spark, one, zero = nodes.sparkSession, F.lit(1).cast("long"), F.lit(0).cast("long")
    # only typed nodes are entered, so edges out of others lead nowhere
    edges = cut(edges.join(nodes.filter("typed").select(F.col("id").alias("src")), "src", "left_semi"))
    targets = cut(edges.select(F.col("dst").alias("start")).distinct())
    every = targets.count()
    degree = cut(edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree")))
    starts = edges.select(F.col("src").alias("start")).distinct().join(nodes.filter("typed").select(F.col("id").alias("start")), "start", "left_semi")
    own = targets.withColumn("own", F.lit(True))
    front = cut(starts.select("start", F.col("start").alias("node"), zero.alias("way"), zero.alias("pos"), zero.alias("path")))
    # nodes in a start's queue, and how many there may be
    queue = cut(starts.join(own, "start", "left").select("start", one.alias("n"), (every + F.when(F.col("own"), 0).otherwise(1)).alias("most")))
    texts = spark.range(1).select(F.col("id").alias("path"), F.lit("").alias("text"))
    seen, depth = [front.select("start", "node")], 1
    yield front, texts
    while max_depth is None or depth < max_depth:
        rows, words = [], []
        for lead in (True, False):
            with scratch(spark):
                open_ = front.filter(F.col("pos").isNotNull() if lead else F.col("pos").isNull())
                if max_nodes is not None:
                    open_ = open_.filter(F.col("pos") < max_nodes)
                open_ = cut(open_.join(queue.filter("n < most").select("start", "n"), "start"))
                if open_.isEmpty():
                    continue
                if not lead:
                    open_ = cut(row_index(open_, ["start"], ["way"], "_r").withColumn("pos", F.col("n") + F.col("_r")))
                # few nodes may hold most edges, so the join is dealt by node and start, to tasks of some million ways
                many = open_.join(degree, "node").agg(F.sum("degree")).first()[0] or 0
                tasks = max(4 * spark.sparkContext.defaultParallelism, many // 4_000_000)
                dealt = open_.withColumn("salt", F.pmod(F.xxhash64("start"), F.lit(SALTS))).repartition(tasks, "node", "salt")
                out = edges.select(F.col("src").alias("node"), "dst", "edge", F.explode(F.sequence(zero, F.lit(SALTS - 1).cast("long"))).alias("salt"))
                ways = dealt.join(out.repartition(tasks, "node", "salt").hint("shuffle_hash"), ["node", "salt"]).select(
                    "start", F.col("dst").alias("node"), (F.shiftleft("pos", WAY) + F.col("edge")).alias("way"))
                # of the nodes entered before, only those take part that these edges lead to
                to = cut(edges.join(open_.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("node")).distinct())
                for more in seen:
                    ways = ways.union(more.join(to, "node", "left_semi").select("start", "node", F.lit(-1).cast("long")))
                enter = cut(ways.groupBy("start", "node").agg(F.min("way").alias("way")).filter("way >= 0"))
                if max_nodes is not None:
                    placed = row_index(enter, ["start"], ["way"], "_r").join(queue, "start").withColumn("pos", F.col("n") + F.col("_r"))
                elif lead:
                    place = F.row_number().over(Window.partitionBy("start").orderBy("way"))
                    first = enter.select("start", "way", place.alias("_r")).filter(F.col("_r") <= head).join(queue, "start").select(
                        "start", "way", (F.col("n") + F.col("_r") - 1).alias("pos"))
                    placed = enter.join(first, ["start", "way"], "left")
                else:
                    placed = enter.withColumn("pos", F.lit(None).cast("long"))
                by = edges.select("edge", F.col("src").alias("parent"), "code")
                up = open_.select("start", F.col("node").alias("parent"), F.col("path").alias("up"))
                placed = placed.withColumn("edge", F.col("way").bitwiseAND((1 << WAY) - 1))
                new = cut(placed.join(by, "edge").join(up, ["start", "parent"]).select("start", "node", "way", "pos", "up", "code"))
                if new.isEmpty():
                    continue
                paths = cut(new.select("up", "code").distinct().withColumn("path", F.monotonically_increasing_id() * 2 + int(lead)))
                before = texts.select(F.col("path").alias("up"), F.col("text").alias("before"))
                words.append(keep(paths.join(before, "up").join(steps, "code").select(
                    "path", F.when(F.col("before") == "", F.col("step")).otherwise(F.concat_ws("|", "before", "step")).alias("text"))))
                rows.append(keep(new.join(paths, ["up", "code"]).select("start", "node", "way", "pos", "path")))
                seen.append(rows[-1].select("start", "node"))
                more = rows[-1].groupBy("start").agg(F.count(F.lit(1)).alias("more"))
                queue = keep(queue.join(more, "start", "left").select("start", (F.col("n") + F.coalesce("more", zero)).alias("n"), "most"))
        if not rows:
            return
        front, texts = rows[0], words[0]
        for r, w in zip(rows[1:], words[1:], strict=True):
            front, texts = front.union(r), texts.union(w)
        depth += 1
        yield front, texts
        if len(seen) > 8:  # a deep search keeps its plan short
            whole = seen[0]
            for more in seen[1:]:
                whole = whole.union(more)
            seen = [cut(whole)]


def causal_profiles(e: DataFrame, types: DataFrame, seq: str, max_depth: int | None = None,
                    max_nodes: int | None = None, head: int = 64, held: int = HELD) -> DataFrame:
    """Distinct (node, pattern) of causal paths, breadth first from every typed node.

    Every typed out-edge of every node of a start's tree adds the path to it and its own step as a pattern. The search
    of a node ends when nothing new is reached; ``max_depth`` bounds the steps of a pattern, ``max_nodes`` the expansions.

    A graph of up to ``held`` edges and steps of nodes goes to every task, which searches its starts one by one (``causal_search.Search``), so
    no tree is ever a table. A larger graph is searched in tables (``causal_levels``): a row for every pair of a start and a node it
    reaches, and the steps out of all nodes with one path are joined as bits before a pattern becomes a row.
    """
    nodes, steps, edges, sets = numbered_graph(e, types, seq)
    own = nodes.filter("typed").select(F.col("id").alias("src"))
    sizes = [edges.count(), sets.count(), steps.agg(F.coalesce(F.sum(F.octet_length("step") + 64), F.lit(0))).first()[0] // 16]
    if sum(sizes) <= held:
        return _held_profiles(nodes, steps, edges.join(own, "src", "left_semi"), sets.join(own, F.col("node") == F.col("src"), "left_semi"), max_depth, max_nodes)
    out = None
    for front, texts in causal_levels(nodes, steps, edges, max_depth, max_nodes, head):
        rows = front if max_nodes is None else front.filter(F.col("pos") < max_nodes)
        found = rows.select("start", "node", "path").join(sets, "node").groupBy("start", "path", "word").agg(F.bit_or("mask").alias("mask"))
        found = found.join(texts, "path").select("start", "text", "word", "mask")
        out = found if out is None else out.union(found)
    bits = F.expr("explode(filter(sequence(0L, 63L), b -> bit_get(mask, cast(b AS INT)) = 1))").alias("b")
    out = out.select("start", "text", "word", bits).select("start", "text", (F.col("word") * 64 + F.col("b")).alias("code"))
    pattern = F.when(F.col("text") == "", F.col("step")).otherwise(F.concat_ws("|", "text", "step"))
    return out.join(steps, "code").join(nodes.select("name", F.col("id").alias("start")), "start").select(
        F.col("name").alias("node"), pattern.alias("pattern")).distinct()


def _held_profiles(nodes: DataFrame, steps: DataFrame, edges: DataFrame, sets: DataFrame, max_depth: int | None, max_nodes: int | None) -> DataFrame:
    """``causal_profiles`` with the whole graph in every task: the graph goes to as many tasks as twice the cores, starts are dealt among them."""
    tasks = 2 * nodes.sparkSession.sparkContext.defaultParallelism
    # in the order of their numbers, a batch in one row: kind, its place, its columns as bytes
    ordered = edges.repartitionByRange("edge").sortWithinPartitions("edge")
    part = "kind int, at bigint, data binary"
    graph = ordered.select("edge", "src", "dst", "code").mapInArrow(_in_rows(0, np.int32), part).union(
        sets.select(F.monotonically_increasing_id().alias("at"), "node", "word", "mask").mapInArrow(_in_rows(1, np.int64), part)).union(
        steps.select(F.lit(2).alias("kind"), F.col("code").alias("at"), F.encode("step", "UTF-8").alias("data")))
    # one plan is read by every task, so it is written once
    graph = cut(graph).select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "kind", "at", "data")
    starts = edges.select(F.col("src").alias("id")).distinct().join(nodes.select("id", "name"), "id").select(
        F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int").alias("task"), F.lit(3).alias("kind"), F.col("id").alias("at"), F.encode("name", "UTF-8").alias("data"))
    dealt = graph.union(starts).repartitionById(tasks, "task").sortWithinPartitions("task", "kind", "at")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list] = [[], [], []]
        search = None
        for b in batches:
            kinds, at, data = b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3)
            for i, kind in enumerate(kinds.tolist()):
                if kind < 3:
                    if search is not None:  # the graph of another task, whose rows follow here
                        yield from search.rows()
                        search, parts = None, [[], [], []]
                    parts[kind].append(data[i].as_py())
                else:
                    if search is None:
                        search, parts = Search(*parts, max_depth, max_nodes), [[], [], []]
                    search.add(at[i], data[i].as_py().decode())
                    if search.full:
                        yield from search.rows()
        if search is not None:
            yield from search.rows()

    return dealt.mapInArrow(run, "node string, pattern string")


def _in_rows(kind: int, width: type) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of numbers as one row each: kind, the first number of the first column, the other columns as bytes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                data = np.stack([c.to_numpy(zero_copy_only=False).astype(width) for c in b.columns[1:]]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([b.column(0)[0].as_py()], pa.int64()), pa.array([data], pa.binary())], ["kind", "at", "data"])
    return run


def profile_matrix(profiles: DataFrame, max_patterns: int = 5000) -> DataFrame:
    """Wide 0/1 matrix with one column per pattern in sorted order, for small vocabularies.

    The long form stays the primary one; beyond ``max_patterns`` use it or
    ``CountVectorizer``.
    """
    cols = sorted(r[0] for r in profiles.select("pattern").distinct().limit(max_patterns + 1).collect())
    if len(cols) > max_patterns:
        raise ValueError("too many patterns for a wide matrix; keep the long form")
    return profiles.groupBy("node").agg(*[F.max((F.col("pattern") == c).cast("long")).alias(c) for c in cols])


def sparse_parts(df: DataFrame, column: str = "features") -> DataFrame:
    """Add the indices and values of a sparse vector column as arrays."""
    dense = vector_to_array(column)
    hits = F.filter(F.transform(dense, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] != 0)
    return df.withColumn("_h", hits).withColumns({"indices": F.transform("_h", lambda s: s["i"]), "values": F.transform("_h", lambda s: s["x"])}).drop("_h")
