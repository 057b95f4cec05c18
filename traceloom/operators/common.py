"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_group_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach aggregates of each row's group.

    Aggregating first and joining back combines on the map side and leaves a
    heavy group splittable in the join; a window over the group would pull it
    into one task. With no keys the one total row is broadcast.
    """
    if not keys:
        total = df.agg(*aggs).withColumn("_all", F.lit(0))
        # exactly one row
        return df.withColumn("_all", F.lit(0)).join(F.broadcast(total), "_all").drop("_all")
    stats = df.groupBy(*keys).agg(*aggs)
    renamed = stats.select(*[F.col(k).alias("_g_" + k) for k in keys], *[c for c in stats.columns if c not in keys])
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(renamed["_g_" + k])
        cond = c if cond is None else cond & c
    return df.join(renamed, cond, "inner").drop(*["_g_" + k for k in keys])


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each group by ``order``, as a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each group; Spark limits each map task to ``n`` rows per group first."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def parsed_rows(df: DataFrame, carry: Sequence[str], required: Sequence[str], **fields: Column) -> DataFrame:
    """Parse each row once and keep it when all ``required`` fields were found.

    A plain filter above the parsing would be pushed below it and repeat every
    pattern; a generator with zero or one row is evaluated once and stays put. The
    outer form also keeps Spark from adding a pushed-down size test on its input.
    """
    def whole(r: Column) -> Column:
        ok = F.lit(True)
        for n in required:
            ok = ok & r[n].isNotNull()
        return ok

    one = F.struct(*[c.alias(n) for n, c in fields.items()])
    return df.select(*carry, F.inline_outer(F.filter(F.array(one), whole))).filter(F.col(required[0]).isNotNull())
