"""Registry of named queries over the driver tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.plans.views import Tables, with_views

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(tables) -> DataFrame``; ``views`` names the SQL views the twin reads."""
    def keep(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = with_views(views.split(), sql)
        return fn
    return keep


def _wide(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and reals as DOUBLE, so both engines agree on types."""
    wide = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select(*[F.col(f"`{c}`").cast(wide[t]).alias(c) if t in wide else F.col(f"`{c}`") for c, t in df.dtypes])


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: _wide(fn(Tables(spark, sf_dir)))
    return {name: bind(fn) for name, fn in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    return dict(_SQL)
