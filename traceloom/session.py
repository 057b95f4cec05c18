"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())  # the folders written in each open scope of this thread


def build_session(name: str = "traceloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume.

    AQE stays on: it coalesces small shuffle partitions, picks a broadcast join
    only from measured sizes, and splits skewed join partitions.
    """
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut points: the cluster's ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may fall back to a temporary folder; on a
    cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_DIRS[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches must see the *same* physical rows (range slices)
    and where an iteration would otherwise grow its lineage. A written table
    survives the loss of executors and keeps column pruning for its readers.
    Inside ``scratch`` it goes at the end of the scope, otherwise it stays.
    """
    return _written(df, next(iter(_SCOPES.get()[-1:]), None))


def keep(df: DataFrame) -> DataFrame:
    """``cut`` for a result that has to outlive the innermost ``scratch``: the table belongs to the scope around it."""
    return _written(df, next(iter(_SCOPES.get()[-2:-1]), None))


def _written(df: DataFrame, scope: list[str] | None) -> DataFrame:
    path = os.path.join(shared_dir(df.sparkSession), "traceloom-" + uuid.uuid4().hex)
    if scope is not None:
        scope.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(df: DataFrame) -> int:
    """Buckets for ``bucketed``: one for each split of ``df``, but no fewer than a shuffle has partitions."""
    return min(max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 100_000)


def bucketed(df: DataFrame, key: str, n: int, outer: bool = False) -> DataFrame:
    """``cut`` (with ``outer``: ``keep``) into ``n`` buckets by ``key``: joins on ``key`` move only their other side.

    ``df`` has to come from ``repartition(n, key)``, so that every task writes one file. The table is in the session's catalog as long as its folder is there.
    """
    spark, name = df.sparkSession, "traceloom_" + uuid.uuid4().hex
    path = os.path.join(shared_dir(spark), name)
    scope = next(iter(_SCOPES.get()[-2:-1] if outer else _SCOPES.get()[-1:]), None)
    if scope is not None:
        scope.append(path)
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name, format="parquet")
    return spark.table(name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``cut`` writes inside, when the scope ends.

    Only tables written by ``keep``, or frames that read none of the scope's tables, may be used afterwards.
    """
    made: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in made:
            if os.path.basename(path).startswith("traceloom_"):
                spark.sql(f"DROP TABLE IF EXISTS {os.path.basename(path)}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-heavy step all cores when its input has fewer splits than the cluster has.

    A large input has many splits and is returned unchanged, without a shuffle.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
