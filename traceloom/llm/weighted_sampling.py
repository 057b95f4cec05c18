"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

For every sample, each weighted term draws gamma variables from its own hash; the term of the least value, with its
quantised weight, is the sample. Two documents agree in a sample with the probability of their generalised Jaccard
similarity (sum of smaller over sum of larger weights).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators import ordered
from traceloom.session import cut

BLOCK = 4  # samples that one row of the aggregation carries: 1, 2, 4 or 8, with the same samples
_NAMED = 8  # samples that share a hash of the term
_MASK = (1 << 28) - 1


def _uniform(bits: Column) -> Column:
    """A number between 0 and 1, both excluded, from the lower 32 bits."""
    return (bits.bitwiseAND((1 << 32) - 1).cast("double") + 0.5) / float(1 << 32)


def _gamma(h: Column) -> Column:
    """A Gamma(2, 1) variable from the two halves of a hash: the sum of two exponential ones."""
    return -F.log(_uniform(h) * _uniform(F.shiftrightunsigned(h, 32)))


def samples(terms: DataFrame, keys: list[str], count: int = 64, term: str = "term", **weights: str) -> DataFrame:
    """Per key group an array of ``count`` 28-bit values for every ``array=weight column`` (by default samples=weight).

    Rows are (keys, term bigint, weights), unique by keys and term; a term whose weight is null is not in that set. The variables
    of a term are drawn once for all its weights. The array of a set without terms holds nulls.
    """
    weights = weights or {"samples": "weight"}
    rows = terms.select(*keys, F.col(term).alias("_t"), *[F.log(F.col(w).cast("double")).alias(f"_w_{o}") for o, w in weights.items()],
                        F.explode(F.sequence(F.lit(0), F.lit(count // BLOCK - 1))).alias("_b"))
    per = _NAMED // BLOCK
    rows = rows.withColumn("_t", F.xxhash64("_t", F.floor(F.col("_b") / per).cast("int"))).withColumn("_o", F.col("_b") % per * (3 * BLOCK))
    mins, drawn = [], []
    for k in range(BLOCK):
        # own hashes for the two gamma variables, and for the offset and the name
        r, c, h = (F.xxhash64("_t", F.col("_o") + 3 * k + i) for i in range(3))
        r, c, beta = _gamma(r), F.log(_gamma(c)), _uniform(h)
        drawn += [r.alias(f"_r{k}"), c.alias(f"_c{k}"), beta.alias(f"_u{k}"), F.shiftrightunsigned(h, 36).alias(f"_h{k}")]
        for o in weights:
            r, c, beta = (F.col(f"_{n}{k}") for n in "rcu")
            t = F.floor(F.col(f"_w_{o}") / r + beta)
            low = c - r * (t - beta) - r
            sign = (F.col(f"_h{k}") + t * 7919).bitwiseAND(_MASK)
            # the order of the values in the upper 35 bits, the sample's name below
            mins.append(F.min(F.shiftleft(((low + 64) * (1 << 28)).cast("bigint"), 28).bitwiseOR(sign)).alias(f"_m{k}_{o}"))
    # the draws are columns of their own, so that both minima share them
    blocks = rows.select(*keys, "_b", *[f"_w_{o}" for o in weights], *drawn).groupBy(*keys, "_b").agg(*mins)

    def named(o: str) -> Column:
        return F.array(*[F.col(f"_m{k}_{o}").bitwiseAND(_MASK).cast("int") for k in range(BLOCK)]).alias(o)

    whole = F.array_sort(F.collect_list(F.struct("_b", *[named(o) for o in weights])))
    out = blocks.groupBy(*keys).agg(whole.alias("_all"))
    return out.select(*keys, *[F.flatten(F.col("_all")[o]).alias(o) for o in weights])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two documents without terms are alike, one alone is like nothing."""
    n = F.size(a)
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return F.when((n == 0) & (F.size(b) == 0), 1.0).when((n == 0) | (F.size(b) == 0), 0.0).otherwise(same / n)


def _printed(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 7, "0")), "")


def terms(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, term, weight): hashed words, A-Z in lower case, weighted by the characters they fill in the text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = texts.select(*keys, F.explode(F.split(F.translate(text_col, upper, upper.lower()), r"[\x20\x09-\x0D]+")).alias("word"))
    return word.filter("word <> ''").groupBy(*keys, F.xxhash64("word").alias("term")).agg(F.sum(F.char_length("word")).alias("weight"))


def next_documents(base: DataFrame) -> DataFrame:
    """(id, next, take): the id after each one (after the last: the first), and a quarter of its own length."""
    ids = base.groupBy("id").agg(F.min("n").alias("n"))
    line = ordered.lagged(ordered.slice_by(ids, [], ["id"]), [], ["id"], before="id", before_n="n")
    top = line.agg(F.max(F.struct("id", "n")).alias("top")).withColumn("_all", F.lit(0))  # one row
    return cut(line.withColumn("_all", F.lit(0)).join(F.broadcast(top), "_all").select(
        F.coalesce("before", "top.id").alias("id"), F.col("id").alias("next"), F.floor(F.coalesce("before_n", "top.n") / 4).cast("int").alias("take")))


def with_edits(base: DataFrame, line: DataFrame) -> DataFrame:
    """(id, n, text, edited): each text beside the one whose last quarter the next document's beginning replaces.

    The texts are dealt by id once; both joins and all later grouping by id keep that partitioning.
    """
    whole = base.repartition("id").groupBy("id").agg(F.min(F.struct("n", "text")).alias("d")).select("id", "d.n", "d.text")
    heads = whole.select(F.col("id").alias("next"), "text").join(line, "next").select("id", "take", F.substring("text", F.lit(1), F.col("take")).alias("head"))
    return whole.join(heads, "id").select("id", "n", "text", F.concat(
        F.substring("text", F.lit(1), (F.col("n") - F.col("take")).cast("int")), "head").alias("edited"))


def fingerprints(docs: DataFrame, count: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness and that to the next document.

    The edited text ends in the beginning of the next document, by ascending id, instead of its last quarter. A null text is empty;
    without words the fingerprint is the empty string. Rows without an id are left out; of rows that repeat an id, the shortest
    (then smallest) text counts. An empty table gives an empty table. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("n"), text.alias("text"))
    line = next_documents(base)
    both = with_edits(base, line)
    sides = both.select("id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")),
                                                F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("x")).select("id", "x.side", "x.t")
    words = terms(sides, ["id", "side"], "t").groupBy("id", "term").agg(*[F.max(F.when(F.col("side") == i, F.col("weight"))).alias(f"w{i}") for i in (0, 1)])
    drawn = samples(words, ["id"], count, s0="w0", s1="w1")
    drawn = drawn.select("id", *[F.when(F.get(s, F.lit(0)).isNotNull(), F.col(s)).alias(s) for s in ("s0", "s1")])
    meta = both.select("id", "n", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    own = cut(meta.join(drawn, "id", "left"))  # one query: its branches share the shuffles of the texts
    none = F.array().cast("array<int>")
    out = own.join(line.select("id", "next"), "id").join(own.select(F.col("id").alias("next"), F.col("s0").alias("s2")), "next")
    a, b, c = (F.coalesce(s, none) for s in ("s0", "s1", "s2"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", _printed(a).alias("fingerprint"),
                      _printed(b).alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"))
