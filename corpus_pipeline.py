"""The training-data pipeline: toxic documents go, near copies go, repeated passages go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import chaining, minhash, packing, toxicity
from traceloom.llm.common import table
from traceloom.llm.queries import VOCABULARY
from traceloom.session import keep, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below the threshold.

    Every row is scored for itself, also one whose id is null or repeated; null and empty texts get the score of a text without words. Other
    columns are not read and may have any names. An empty table stays empty.
    """
    flat = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    scored = toxicity.toxicity(docs.toDF(*flat), table(spark, sf_dir, "labels"), flat)
    return scored.filter("predicted = 0").select(*flat).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, any of its rows; a row without an id only where no row has one.

    Rows without words link with nothing and stay. Other columns may have any names. An empty table stays empty.
    """
    flat = [f"c{i}" for i in range(len(docs.columns))]
    own, text = (flat[docs.columns.index(c)] for c in ("doc_id", "text"))
    with scratch(spark):
        rows = minhash.numbered(docs.toDF(*flat), outer=True)
        # the operator links rows; the one kept of a component is the first by its document's id
        linked = minhash.linked(rows.select("id", F.col(text).alias("text"))).join(rows.select("id", F.col(own).alias("own")), "id")
        first = F.min_by("id", F.struct(F.col("own").isNull(), "own", "id"))
        kept = keep(linked.groupBy("component").agg(first.alias("id")).select("id"))
    return rows.join(kept.hint("shuffle_hash"), "id", "left_semi").select(*flat).toDF(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has, as ``chaining.without_repeats`` says; no row goes."""
    return chaining.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence: each row's own, also where ids are null or repeated; a null text is empty."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_copies), ("substring_dedup", drop_repeated_passages),
          ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over ``documents``; what a stage has written for itself goes once its own result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark):
            docs = keep(stage(spark, docs, sf_dir))
    return docs
