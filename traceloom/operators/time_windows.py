"""Time windows, splits, ordered scans and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import times
from traceloom.operators.common import first_rows, top_rows, with_group_stats
from traceloom.operators.ordered import SLICE, filled, lagged, row_index, running_sum, slice_by

NS = times.NS


def fill_timestamps(e: DataFrame, file: str, seq: str, ts: str = "ts_ns") -> DataFrame:
    """Fill missing times in file order from the next row, else from the previous one."""
    out = filled(slice_by(e, [file], [seq]), [file], [seq], ts, "_ts")
    return out.withColumn(ts, F.col("_ts")).drop("_ts", SLICE).select(*e.columns)


def gap_features(e: DataFrame, seq: str = "log_idx", active_below: float = 1.0) -> DataFrame:
    """Idle and active time per node from the gaps between its events.

    Gaps under ``active_below`` seconds count as active. Values are whole seconds,
    rounded half to even; a node with a single event has zeros.
    """
    ev = e.select(F.explode(F.array("src", "dst")).alias("node"), "ts_ns", seq)
    # both ends of a self loop are two sightings, as in the edge list
    ev = ev.groupBy("node", "ts_ns").agg(F.count(F.lit(1)).alias("_n"))
    ev = lagged(slice_by(ev, ["node"], ["ts_ns"]), ["node"], ["ts_ns"], _prev_ts="ts_ns")
    gap = (F.col("ts_ns") - F.col("_prev_ts")) / NS
    idle = F.when(gap >= active_below, gap)

    def whole(c: Column) -> Column:
        return F.coalesce(F.bround(c, 0).cast("long"), F.lit(0).cast("long"))

    return ev.groupBy("node").agg(
        whole(F.avg(idle)).alias("avg_idle_time"), whole(F.max(idle)).alias("max_idle_time"),
        whole(F.min(idle)).alias("min_idle_time"),
        whole(F.sum(F.when(gap < active_below, gap))).alias("cumulative_active_time"), whole(F.sum(gap)).alias("lifespan"))


def collapse_runs(e: DataFrame, order: Sequence, keys: Sequence[str] = (), text: str = "sentence") -> DataFrame:
    """Collapse consecutive equal (src, dst, action) edges; the text of a run gets ' (xN)'."""
    same = ["src", "dst", "action"]
    s = slice_by(e, keys, order).withColumn("_one", F.lit(1))
    s = lagged(s, keys, order, **{"_p_" + c: c for c in same}, _p_any="_one")
    new = F.col("_p_any").isNull()
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.col("_p_" + c))
    s = running_sum(s.withColumn("_new", new.cast("long")), keys, order, _run="_new")
    names = [o if isinstance(o, str) else o[0] for o in order]
    g = s.groupBy(*keys, "_run").agg(F.min_by(F.struct(*same, text, *[n for n in names if n not in same]), F.struct(*names)).alias("f"),
                                     F.count(F.lit(1)).alias("n"))
    shown = F.when(F.col("n") > 1, F.concat(F.col("f." + text), F.lit(" (x"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("f." + text))
    return g.select(*keys, F.col("_run").alias("run"), "f.src", "f.dst", "f.action", shown.alias(text), "n")


def edge_sequence(e: DataFrame, keys: Sequence[str], order: Sequence, name: str = "edge_seq") -> DataFrame:
    """Position of each edge within its window by time."""
    return row_index(e, keys, order, name)


def synthetic_time(e: DataFrame, window_start_ns: str, line_no: str) -> DataFrame:
    return e.withColumn("t", F.col(window_start_ns) + F.col(line_no))


def first_edge_per_pair(e: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Simple directed graph: the first edge of each pair of ends wins."""
    return first_rows(e, [*keys, "src", "dst"], [seq])


def last_labels(e: DataFrame, seq: str) -> DataFrame:
    """Last written label and first position of every node."""
    ends = e.select(F.col(seq).alias("_s"), F.inline(F.array(
        F.struct(F.col("src").alias("node"), F.col("src_label").alias("label"), F.lit(0).alias("_side")),
        F.struct(F.col("dst").alias("node"), F.col("dst_label").alias("label"), F.lit(1).alias("_side")))))
    pos = F.col("_s") * 2 + F.col("_side")
    return ends.groupBy("node").agg(F.max_by("label", pos).alias("label"), F.min(pos).alias("first_pos"))


def percentile_threshold(df: DataFrame, keys: Sequence[str], score: str, q: float) -> DataFrame:
    """Linear-interpolated percentile per key, found by rank instead of collecting the values."""
    counts = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"))
    s = running_sum(slice_by(counts, keys, [score]), keys, [score], _upto="_n")
    s = with_group_stats(s, keys, F.sum("_n").alias("_total"))
    at = (F.col("_total") - 1) * q
    lo, hi = F.floor(at), F.ceil(at)
    first = F.col("_upto") - F.col("_n")

    def value_at(i: Column) -> Column:
        return F.max(F.when((first <= i) & (i < F.col("_upto")), F.col(score)))

    g = s.groupBy(*keys).agg(value_at(lo).alias("_lo"), value_at(hi).alias("_hi"), F.max(at - lo).alias("_f"))
    return g.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("threshold"))


def radius_value(df: DataFrame, keys: Sequence[str], score: str, contamination: float) -> DataFrame:
    """The score at sorted position floor((1 − contamination) · n)."""
    counts = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"))
    s = running_sum(slice_by(counts, keys, [score]), keys, [score], _upto="_n")
    s = with_group_stats(s, keys, F.sum("_n").alias("_total"))
    i = F.floor((1 - contamination) * F.col("_total"))
    here = (F.col("_upto") - F.col("_n") <= i) & (i < F.col("_upto"))
    return s.groupBy(*keys).agg(F.max(F.when(here, F.col(score))).alias("radius"))


def new_clusters(members: DataFrame, by: Sequence[str], cluster: str = "cluster", window: str = "window_key") -> DataFrame:
    """Rows of clusters in the window where the cluster appears first; noise ('-1') is left out."""
    real = members.filter(F.col(cluster) != -1)
    real = with_group_stats(real, [*by, cluster], F.min(window).alias("_first"))
    return real.filter(F.col(window) == F.col("_first")).drop("_first")


# --- windows and splits --------------------------------------------------------------------

def hourly(e: DataFrame, ts: str = "ts_ns") -> DataFrame:
    return e.withColumns({"window_key": times.hour_key(F.col(ts)), "window_start_ns": times.hour_start_ns(F.col(ts))})


def split_by_dates(e: DataFrame, train: tuple[str, str], test: tuple[str, str], ts: str = "ts_ns") -> DataFrame:
    """Add ``split`` by the edge's day (inclusive bounds); edges outside both and bad times are dropped."""
    sec = F.when(F.col(ts) > 1e15, F.col(ts) / NS).otherwise(F.col(ts).cast("double"))
    day = F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd")
    split = F.when(day.between(*train), "train").when(day.between(*test), "test")
    return e.filter((sec >= 0) & (sec <= 4e9)).withColumn("split", split).filter("split IS NOT NULL")


def split_nodes(e: DataFrame) -> DataFrame:
    """Nodes of each split; a node may be in both."""
    return e.select(F.explode(F.array("src", "dst")).alias("node"), "split").distinct()


def exclusive_test_nodes(nodes: DataFrame) -> DataFrame:
    """Train nodes, and test nodes that never occur in training."""
    train = nodes.filter("split = 'train'")
    test = nodes.filter("split = 'test'").join(train.select("node"), "node", "left_anti")
    return train.unionByName(test)


def split_windows(e: DataFrame, window: str = "window_key", label: str = "label") -> DataFrame:
    """Windows with any malicious edge go to the test split."""
    out = with_group_stats(e, [window], F.max(F.col(label) == 1).alias("_bad"))
    return out.withColumn("split", F.when(F.col("_bad"), "test").otherwise("train")).drop("_bad")


def merge_sorted(parts: Sequence[DataFrame], ts: str = "ts_ns", as_text: bool = False, nulls_first: bool = True) -> DataFrame:
    """Union in time order; bad times come first (or last). ``as_text`` keeps the order of the text form."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    c = F.col(ts).cast("string") if as_text else F.col(ts)
    return out.orderBy(c.asc_nulls_first() if nulls_first else c.asc_nulls_last())


def hour_calendar(windows: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Hour windows of a date range that have data."""
    spark = windows.sparkSession
    hours = spark.sql(f"SELECT explode(sequence(timestamp'{first_day} 00:00:00', timestamp'{last_day} 23:00:00', interval 1 hour)) AS h")
    keys = hours.select(F.date_format("h", "yyyy-MM-dd_HH").alias("window_key"))
    return keys.join(windows.select("window_key").distinct(), "window_key", "left_semi")


def graph_windows(e: DataFrame, *by: str) -> DataFrame:
    """Per window: distinct nodes, distinct pairs, edges and action kinds.

    Every edge gives four tagged values (two nodes, a pair, an action) that one aggregate makes distinct, combined on the
    map side; counting them is a second, small one.
    """
    def value(kind: str, a: str, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("_k"), F.col(a).cast("string").alias("_a"), b.cast("string").alias("_b"))
    none = F.lit(None)
    values = e.select(*by, F.inline(F.array(value("node", "src", none), value("node", "dst", none), value("pair", "src", F.col("dst")),
                                            value("action", "action", none))))
    once = values.groupBy(*by, "_k", "_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    pair = F.col("_k") == "pair"
    return once.groupBy(*by).agg(F.count_if((F.col("_k") == "node") & F.col("_a").isNotNull()).alias("nodes"), F.count_if(pair).alias("pairs"),
                                 F.sum(F.when(pair, F.col("_n"))).alias("edges"),
                                 F.count_if((F.col("_k") == "action") & F.col("_a").isNotNull()).alias("actions"))


# --- limits and samples --------------------------------------------------------------------

def top_seeds(nodes: DataFrame, k: int, score: str = "score", ident: str = "node") -> DataFrame:
    """The k highest scores; ties by id."""
    return nodes.orderBy(F.col(score).desc(), F.col(ident).asc()).limit(k)


def hash_order(seed: str, *cols: str) -> Column:
    """A repeatable random order that other engines can reproduce."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(seed)))


def sample_per_group(df: DataFrame, by: Sequence[str], n: int, seed: str, ident: str) -> DataFrame:
    """Up to ``n`` rows of each group in a repeatable random order."""
    return top_rows(df, by, [hash_order(seed, ident), F.col(ident)], n)


def sample_distinct(df: DataFrame, column: str, n: int, seed: str) -> DataFrame:
    """``n`` random distinct values, for example pools."""
    d = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return d.orderBy(hash_order(seed, column)).limit(n)


def edge_pairs(lines: DataFrame, line: str = "line") -> DataFrame:
    """Pairs written as '(a, b)' in edge lines, as distinct prompts and ids."""
    pair = r"\(([\w.\-]+(?::\d+)?),\s*([\w.\-]+(?::\d+)?)\)"
    return lines.select(F.explode(F.arrays_zip(F.regexp_extract_all(line, F.lit(pair), 1).alias("a"),
                                               F.regexp_extract_all(line, F.lit(pair), 2).alias("b"))).alias("p")).select("p.a", "p.b").distinct()
