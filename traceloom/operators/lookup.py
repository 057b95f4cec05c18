"""Lookups, alignments and membership tests between edge, node and log tables.

No join here carries a broadcast hint: adaptive execution broadcasts a side when
its measured size is under the session threshold and splits skewed partitions
otherwise. Lookup sides are unique on their key, so a hub key never multiplies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import names as N


def add_messages(e: DataFrame, messages: DataFrame) -> DataFrame:
    """Add ``exec`` and ``path``: the messages of both ends, '' when unknown."""
    for end, out in (("src", "exec"), ("dst", "path")):
        m = messages.select(F.col("id").alias(end), F.col("message").alias(out))
        e = e.join(m, end, "left").withColumn(out, F.coalesce(out, F.lit("")))
    return e


def node_messages(e: DataFrame, messages: DataFrame) -> DataFrame:
    """Message of every node of the edges, looked up by lower-cased id."""
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    m = messages.select(F.col("id").alias("_id"), "message")
    return ends.join(m, F.lower("node") == F.col("_id")).drop("_id")


def add_names(e: DataFrame, names: DataFrame, log: str = "log_idx", seq: str = "seq") -> DataFrame:
    """Names of both ends from the name table of the same log; the last name of an id wins."""
    last = names.groupBy(log, "entity").agg(F.max_by("name", seq).alias("_n"))
    for end in ("src", "dst"):
        n = last.select(log, F.col("entity").alias(end), F.col("_n").alias(end + "_name"))
        e = e.join(n, [log, end], "left").withColumn(end + "_name", F.coalesce(end + "_name", F.lit("")))
    return e


def names_containing(names: DataFrame, labels: DataFrame, gram: int = 6) -> DataFrame:
    """Distinct ``name`` values that contain any ``label`` as a substring, ignoring case.

    An equi-join on label prefixes of up to ``gram`` characters replaces the
    all-pairs test: a name can only contain a label whose prefix is one of the
    name's substrings. Exact for any number of labels.
    """
    lab = labels.select(F.lower(F.trim("label")).alias("_label")).filter("_label <> ''").distinct()
    lab = lab.withColumn("_key", F.substring("_label", 1, gram))
    # at most ``gram`` different prefix lengths
    sizes = sorted(r[0] for r in lab.select(F.length("_key")).distinct().collect())
    low = names.select("name").distinct().withColumn("_low", F.lower("name"))
    grams = F.flatten(F.array(*[_grams(F.col("_low"), n) for n in sizes]))
    hit = low.select("name", "_low", F.explode(F.array_distinct(grams)).alias("_key")).join(lab, "_key")
    return hit.filter(F.contains("_low", F.col("_label"))).select("name").distinct()


def _grams(text: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))
                  ).otherwise(F.array().cast("array<string>"))


def label_edges(e: DataFrame, labels: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Add ``label``: 1 when either end contains a malicious substring."""
    ends = e.select(F.explode(F.array(src, dst)).alias("name")).filter("name IS NOT NULL").distinct()
    bad = names_containing(ends, labels)
    for end, flag in ((src, "_s"), (dst, "_d")):
        e = e.join(bad.select(F.col("name").alias(end), F.lit(1).alias(flag)), end, "left")
    return e.withColumn("label", F.coalesce("_s", "_d", F.lit(0)).cast("long")).drop("_s", "_d")


def induced_edges(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in the node set."""
    n = nodes.select("node").distinct()
    e2 = e.join(n, e["src"] == n["node"], "left_semi")
    return e2.join(n, e2["dst"] == n["node"], "left_semi")


def nodes_of(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def not_done(items: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that is left: items without a finished twin."""
    return items.join(done.select(*keys).distinct(), list(keys), "left_anti")


def align_embeddings(names: DataFrame, vectors: DataFrame, dim: int, fallback: DataFrame | None = None) -> DataFrame:
    """Vector per name: exact name, then host-neutral name, then fallback.

    ``fallback(name, v)`` is an optional table; otherwise a zero vector is used.
    ``match_kind`` tells which step hit.
    """
    v = vectors.select("name", "v")
    norm = v.withColumn("_key", N.host_neutral_name(F.col("name"))).groupBy("_key").agg(F.min_by("v", "name").alias("_nv"))
    n = names.select("name").distinct().withColumn("_key", N.host_neutral_name(F.col("name")))
    out = n.join(v.withColumnRenamed("v", "_ev"), "name", "left").join(norm, "_key", "left")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    if fallback is not None:
        out = out.join(fallback.select("name", F.col("v").alias("_fv")), "name", "left")
        zero = F.coalesce("_fv", zero)
    kind = F.when(F.col("_ev").isNotNull(), "exact").when(F.col("_nv").isNotNull(), "normalized").otherwise("fallback")
    return out.select("name", F.coalesce("_ev", "_nv", zero).alias("v"), kind.alias("match_kind"))


def embeddings_with_group_fallback(nodes: DataFrame, vectors: DataFrame, group_vectors: DataFrame) -> DataFrame:
    """Vector per (node, group): its own, else that of its group."""
    own = vectors.select(F.col("name").alias("node"), F.col("v").alias("_own"))
    grp = group_vectors.select("group", F.col("v").alias("_grp"))
    out = nodes.join(own, "node", "left").join(grp, "group", "left")
    return out.select(*nodes.columns, F.coalesce("_own", "_grp").alias("v"), F.col("_own").isNull().alias("from_group"))


def merge_type_tables(typed: DataFrame, untyped: DataFrame, precedence: str = "typed") -> DataFrame:
    """Union of two (node, vtype, functionality) tables, one side winning on conflicts."""
    if precedence not in ("typed", "untyped"):
        raise ValueError("precedence is 'typed' or 'untyped'")
    a, b = (typed, untyped) if precedence == "typed" else (untyped, typed)

    def clean(d: DataFrame) -> DataFrame:
        return d.filter(~F.upper("vtype").isin("NO LABEL", "NO_LABEL"))

    x = clean(a).select("node", F.col("vtype").alias("_t1"), F.col("functionality").alias("_f1"), F.lit(True).alias("_in"))
    y = clean(b).select("node", F.col("vtype").alias("_t2"), F.col("functionality").alias("_f2"))
    out = x.join(y, "node", "full_outer")
    return out.select("node", F.coalesce("_t1", "_t2").alias("vtype"),
                      F.when(F.col("_in"), F.col("_f1")).otherwise(F.col("_f2")).alias("functionality"))


def entity_info(nodes: DataFrame, typed: DataFrame, untyped: DataFrame) -> DataFrame:
    """Type and functionality of each node: typed table, then untyped, then fixed defaults."""
    t = typed.select("node", F.col("vtype").alias("_t1"), F.col("functionality").alias("_f1"))
    u = untyped.select("node", F.col("vtype").alias("_t2"), F.col("functionality").alias("_f2"))
    out = nodes.join(t, "node", "left").join(u, "node", "left")
    return out.select(*nodes.columns, F.coalesce("_t1", "_t2", F.lit("unknown")).alias("vtype"),
                      F.coalesce("_f1", "_f2", F.lit("N/A")).alias("functionality"))


def edge_to_log_map(rows: DataFrame, seq: str = "edge_seq") -> DataFrame:
    """(edge position → log) pairs; rows whose log number is no integer are skipped."""
    m = rows.select(seq, F.col("log_idx").try_cast("bigint").alias("log_idx"), "log_type")
    return m.filter("log_idx IS NOT NULL AND log_type <> ''")


def nodes_on_date(nodes: DataFrame, gt: DataFrame) -> DataFrame:
    """Ground-truth nodes confirmed by being seen on their attack date.

    ``nodes(node, day)`` are sightings, ``gt(node, attack, day)`` the truth.
    """
    seen = nodes.select("node", "day").distinct()
    return gt.select("node", "attack", "day").distinct().join(seen, ["node", "day"], "left_semi")


def fill_unknown_actions(e: DataFrame, actions: DataFrame) -> DataFrame:
    """Replace NO LABEL by the action known for the type pair of the ends."""
    a = actions.select("src_vtype", "dst_vtype", F.col("action").alias("_a"))
    out = e.join(a, ["src_vtype", "dst_vtype"], "left")
    return out.withColumn("action", F.when(F.col("action") == "NO LABEL", F.coalesce("_a", "action"))
                          .otherwise(F.col("action"))).drop("_a").select(*e.columns)


def inherit_parent_names(e: DataFrame) -> DataFrame:
    """A nameless 'parent' end takes the names of the other end, when only one end is a parent."""
    def parent(c: str) -> Column:
        return F.exists(c, lambda v: F.contains(F.lower(v), F.lit("parent")))

    s, d = N.telling_names(F.col("src_names")), N.telling_names(F.col("dst_names"))
    e = e.withColumns({"_s": s, "_d": d, "_sp": parent("src_vtypes"), "_dp": parent("dst_vtypes")})
    take_d = F.col("_sp") & ~F.col("_dp") & (F.size("_s") == 0) & (F.size("_d") > 0)
    take_s = F.col("_dp") & ~F.col("_sp") & (F.size("_d") == 0) & (F.size("_s") > 0)
    return e.withColumns({"src_names": F.when(take_d, F.col("_d")).otherwise(F.col("_s")),
                          "dst_names": F.when(take_s, F.col("_s")).otherwise(F.col("_d"))}).drop("_s", "_d", "_sp", "_dp")


def resolve_ids(df: DataFrame, names: DataFrame, entity: str = "entity") -> DataFrame:
    """Display name of 'id-…' entities: first name that is not 'NONE' or the id itself, else the first, else 'NONE'."""
    n = names.select(F.col("entity").alias(entity), F.col("names").alias("_n"))
    out = df.join(n, entity, "left")
    good = F.filter("_n", lambda x: (F.upper(x) != "NONE") & (x != F.col(entity)))
    pick = F.coalesce(F.get(good, F.lit(0)), F.get("_n", F.lit(0)), F.lit("NONE"))
    return out.withColumn("resolved", F.when(F.col(entity).startswith("id-"), pick).otherwise(F.col(entity))).drop("_n")


def hash_to_uuid(nodes: DataFrame) -> DataFrame:
    """Node hash to uuid; the last uuid of a hash wins."""
    return nodes.groupBy("node").agg(F.max_by("uuid", "seq").alias("uuid"))


def reindex_features(node_index: DataFrame, features: DataFrame, malicious: DataFrame) -> DataFrame:
    """Features in node-index order: missing rows are zero, plus a malicious flag."""
    cols = [c for c in features.columns if c != "node"]
    bad = malicious.select("node").distinct().withColumn("_bad", F.lit(1).cast("long"))
    out = node_index.join(features, "node", "left").na.fill(0, cols)
    return out.join(bad, "node", "left").withColumn("malicious", F.coalesce("_bad", F.lit(0).cast("long"))).drop("_bad")


def seed_vectors(seeds: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of seeds by (scenario, log_type, window, position), of the expected length only."""
    key = ["scenario", "log_type", "window_key", "log_pos"]
    return seeds.join(vectors.filter(F.size("v") == dim), key)
