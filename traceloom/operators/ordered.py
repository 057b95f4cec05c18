"""Ordered scans that do not need a whole group in one task.

A Spark window with ``PARTITION BY key ORDER BY ts`` sends every row of a key to
one task, and a window without PARTITION BY sends the table to one task. Hub
nodes, large sources and whole-table rankings break that. The scans here work in
two levels instead:

1. ``slice_by`` range-partitions on (keys, order) and numbers the slices, so a
   heavy key is spread over as many slices as its size needs;
2. a scan runs inside each (slice, key), and the little that must flow from one
   slice to the next is computed from one summary row per (slice, key).

Only the first and the last key of a slice can continue in a neighbour, so the
carry table has at most two rows per slice and is safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.session import cut

SLICE = "_slice"


def _order(order: Sequence[str | tuple[str, str]]) -> list[tuple[str, bool]]:
    return [(o, True) if isinstance(o, str) else (o[0], o[1] == "asc") for o in order]


def _sort_cols(order) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in _order(order)]


def slice_by(df: DataFrame, keys: Sequence[str], order: Sequence, partitions: int | None = None) -> DataFrame:
    """Range-partition on (keys, order), number the slices and store the result.

    ``order`` must identify rows uniquely inside a key; entries are a column name
    or ``(name, "asc"|"desc")``.
    """
    cols = [F.col(k).asc_nulls_first() for k in keys] + _sort_cols(order)
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return cut(ranged.withColumn(SLICE, F.spark_partition_id()))


def _carry(sliced: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """One row per (key, slice), for keys that span more than one slice."""
    per = sliced.groupBy(*keys, SLICE).agg(*aggs)
    spread = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return per.withColumn("_n", F.count(F.lit(1)).over(spread)).filter("_n > 1").drop("_n")


def _attach(sliced: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    # At most two carry rows per slice, so the broadcast is bounded by the slice count.
    cond = sliced[SLICE] == carry["_c_slice"]
    for k in keys:
        cond = cond & sliced[k].eqNullSafe(carry["_c_" + k])
    return sliced.join(F.broadcast(carry), cond, "left").drop("_c_slice", *["_c_" + k for k in keys])


def _renamed(carry: DataFrame, keys: list[str]) -> DataFrame:
    for k in [SLICE, *keys]:
        carry = carry.withColumnRenamed(k, "_c_" + k if k != SLICE else "_c_slice")
    return carry


def running_sum(sliced: DataFrame, keys: Sequence[str], order: Sequence, **sums: str) -> DataFrame:
    """Add inclusive running sums ``out=column`` in ``order`` within ``keys``."""
    keys = list(keys)
    here = Window.partitionBy(SLICE, *keys).orderBy(*_sort_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE)
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = _carry(sliced, keys, [F.sum(c).alias("_t_" + o) for o, c in sums.items()])
    carry = carry.select(*keys, SLICE, *[F.sum("_t_" + o).over(before).alias("_o_" + o) for o in sums])
    out = sliced
    for o, c in sums.items():
        out = out.withColumn(o, F.sum(c).over(here))
    out = _attach(out, _renamed(carry, keys), keys)
    for o in sums:
        out = out.withColumn(o, F.col(o) + F.coalesce(F.col("_o_" + o), F.lit(0)))
    return out.drop(*["_o_" + o for o in sums])


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence, name: str, start: int = 0,
              partitions: int | None = None) -> DataFrame:
    """Dense position of each row in ``order`` within ``keys``."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    out = running_sum(slice_by(one, keys, order, partitions), keys, order, **{name: "_one"})
    return out.withColumn(name, F.col(name) + (start - 1)).drop("_one", SLICE)


def lagged(sliced: DataFrame, keys: Sequence[str], order: Sequence, **lags: str) -> DataFrame:
    """Add ``out`` = ``column`` of the row just before, within ``keys``."""
    keys = list(keys)
    names = [c for c, _ in _order(order)]
    here = Window.partitionBy(SLICE, *keys).orderBy(*_sort_cols(order))
    last = F.max_by if all(up for _, up in _order(order)) else None
    if last is None:
        raise ValueError("lagged needs an ascending order")
    per = [F.max_by(F.struct(*[F.col(c).alias(o) for o, c in lags.items()]), F.struct(*names)).alias("_last")]
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE)
    carry = _carry(sliced, keys, per).select(*keys, SLICE, F.lag("_last").over(across).alias("_prev"))
    out = sliced.withColumn("_pos", F.row_number().over(here))
    for o, c in lags.items():
        out = out.withColumn(o, F.lag(c).over(here))
    out = _attach(out, _renamed(carry, keys), keys)
    for o in lags:
        out = out.withColumn(o, F.when(F.col("_pos") == 1, F.col("_prev." + o)).otherwise(F.col(o)))
    return out.drop("_pos", "_prev")


def filled(sliced: DataFrame, keys: Sequence[str], order: Sequence, column: str, out: str,
           directions: Sequence[str] = ("back", "forward")) -> DataFrame:
    """Fill nulls of ``column`` from the next ("back") or previous ("forward") value.

    Directions are tried in turn, so the default takes the next value first and
    the previous one where no later value exists.
    """
    keys = list(keys)
    names = [c for c, _ in _order(order)]
    back = [(c, "desc" if up else "asc") for c, up in _order(order)]
    # a frame from the current row to the end is recomputed per row; the reversed order needs only a running frame
    upto = (Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(SLICE, *keys).orderBy(*_sort_cols(back)).rowsBetween(*upto)
    behind = Window.partitionBy(SLICE, *keys).orderBy(*_sort_cols(order)).rowsBetween(*upto)
    across = Window.partitionBy(*(keys or [F.lit(0)])).rowsBetween(Window.unboundedPreceding, -1)
    has = F.when(F.col(column).isNotNull(), F.struct(*names))
    carry = _carry(sliced, keys, [F.min_by(column, has).alias("_f"), F.max_by(column, has).alias("_l")])
    carry = carry.select(*keys, SLICE, F.last("_f", ignorenulls=True).over(across.orderBy(F.desc(SLICE))).alias("_next"),
                         F.last("_l", ignorenulls=True).over(across.orderBy(SLICE)).alias("_prior"))
    res = sliced.withColumn("_b", F.last(column, ignorenulls=True).over(ahead))
    res = res.withColumn("_w", F.last(column, ignorenulls=True).over(behind))
    res = _attach(res, _renamed(carry, keys), keys)
    pick = {"back": F.coalesce("_b", "_next"), "forward": F.coalesce("_w", "_prior")}
    return res.withColumn(out, F.coalesce(*[pick[d] for d in directions])).drop("_b", "_w", "_next", "_prior")
