"""Sharding by a k-d tree over metadata, with weighted medians found by distributed radix descent.

DataFrame expressions only. A node is split along the dimension in which its documents spread widest, where half of
its bytes lie on either side. The coordinate of a document is a 48-bit number: its place in that dimension, then the
hash of its text, so that equal texts stay together, then the hash of its row for texts too heavy to stay in one shard.
A median takes four counting passes of 12 bits, each returning at most 4096 sums for a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators import ordered
from traceloom.session import cut

DIGIT = 12


def _by_node(values: dict[int, int | str]) -> Column:
    out = F.lit(None)
    for node, v in values.items():
        out = F.when(F.col("node") == node, F.col(v) if isinstance(v, str) else F.lit(v)).otherwise(out)
    return out


def assign(units: DataFrame, shards: int, dims: list[str], bits: int = 16) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) to rows with ``size``, ``dims`` (0 to 65535), ``group_hash`` and ``row_hash`` (0 to 65535).

    The rows are read once for each counting pass and not moved. What reaches the driver is bounded by the number of shards.
    """
    # a node is a range of shards, named by its first
    open_nodes = {0: shards}
    state = units.withColumn("node", F.lit(0))
    while any(n > 1 for n in open_nodes.values()):
        parts = {k: n for k, n in open_nodes.items() if n > 1}
        here = state.filter(F.col("node").isin(list(parts)))
        spread = here.groupBy("node").agg(F.sum("size").alias("total"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).collect()
        total = {r["node"]: r["total"] for r in spread}
        widest = {r["node"]: max(dims, key=lambda d, r=r: (r[d] or 0, -dims.index(d))) for r in spread}
        if not total:
            break
        goal = {k: total[k] * (parts[k] // 2) / parts[k] for k in total}
        coordinate = F.shiftleft(_by_node(widest).cast("long"), 32) + F.shiftleft(F.col("group_hash").cast("long"), 16) + F.col("row_hash")
        placed = here.select("node", "size", coordinate.alias("c"))
        prefix, below = dict.fromkeys(total, 0), dict.fromkeys(total, 0)
        for shift in range(48 - DIGIT, -1, -DIGIT):
            at = placed.filter(F.shiftright("c", shift + DIGIT) == _by_node(prefix).cast("long"))
            rows = at.groupBy("node", F.shiftright("c", shift).bitwiseAND((1 << DIGIT) - 1).alias("digit")).agg(F.sum("size").alias("size")).collect()
            sums: dict[int, list[tuple[int, int]]] = {}
            for r in rows:
                sums.setdefault(r["node"], []).append((r["digit"], r["size"]))
            for k, digits in sums.items():
                digits.sort()
                for i, (digit, size) in enumerate(digits):
                    last = i == len(digits) - 1
                    if last or below[k] + size > goal[k]:
                        break
                    below[k] += size
                prefix[k] = prefix[k] << DIGIT | digit
        # the unit at the median goes to the side that it brings closer to the goal
        edge = {}
        for k in total:
            over = next((s for d, s in sums.get(k, []) if d == prefix[k] & (1 << DIGIT) - 1), 0)
            edge[k] = prefix[k] + (1 if below[k] + over - goal[k] < goal[k] - below[k] else 0)
        to = {k: k + parts[k] // 2 for k in total}
        right = coordinate >= _by_node(edge).cast("long")
        state = state.withColumn("node", F.when(F.col("node").isin(list(total)) & right, _by_node(to)).otherwise(F.col("node")))
        split = {k: parts[k] // 2 for k in total} | {to[k]: parts[k] - parts[k] // 2 for k in total}
        open_nodes = {k: n for k, n in open_nodes.items() if n == 1} | split
        state = cut(state)
    return state.withColumnRenamed("node", "shard")


def shard(docs: DataFrame, shards: int = 16, heavy: float = 0.05, id_col: str = "doc_id", text_col: str = "text",
          labels: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per row: id, size (UTF-8 bytes of the text, 0 for null, plus 1), text_crc32, shard, and its gapless slot there.

    Dimensions are the ``labels`` (by hash) and the text's length (by logarithm); nulls lie at 0. All rows of equal texts take the metadata of
    their smallest, so they stay in one shard unless their bytes exceed ``heavy`` of a shard. Slots follow id (nulls first).
    Repeated rows are rows of their own. A label column that is absent is left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    labels = tuple(c for c in labels if c in docs.columns)
    place = [F.coalesce(F.shiftrightunsigned(F.xxhash64(c), 48), F.lit(0)).cast("int").alias(f"d_{c}") for c in labels]
    place = [F.when(F.col(c).isNull(), 0).otherwise(p).alias(f"d_{c}") for c, p in zip(labels, place, strict=True)]
    size = F.octet_length(text).cast("long") + 1
    rows = cut(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(text).alias("text_md5"), *place, F.least(F.log2(size.cast("double")) * 2048, F.lit(65535)).cast("int").alias("d_length")))
    dims = [f"d_{c}" for c in labels] + ["d_length"]
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    same = cut(rows.groupBy("text_md5").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min(F.struct(*dims)).alias("m")).filter("n > 1"))
    both = rows.join(same, "text_md5", "left")
    alone = F.col("bytes") > heavy * total / shards
    units = cut(both.select(
        "row", "id", "size", "text_crc32", *[F.coalesce(F.col(f"m.{d}"), F.col(d)).alias(d) for d in dims],
        F.shiftrightunsigned(F.xxhash64("text_md5"), 48).alias("group_hash"),
        F.when(alone, F.shiftrightunsigned(F.xxhash64("row"), 48)).otherwise(0).alias("row_hash")))
    out = ordered.row_index(assign(units, shards, dims), ["shard"], ["id", "row"], "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
