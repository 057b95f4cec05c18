"""Chat formatting, hard negatives and Merkle manifests against plain Python; row keys of near duplicates and fingerprints."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from traceloom.llm import chat, hard_negatives, merkle, packing, spherical, weighted_sampling
from traceloom.llm.queries import BYTE_VOCABULARY, VOCABULARY

RND = random.Random(2)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- chat formatting ---------------------------------------------------------------------------

CHAT = "conv_id bigint, turn bigint, role string, text string, part string, whole string, said string"


@pytest.fixture(scope="module")
def chats(spark):
    bits = ["<turn>", "</turn>", "<says>", "\\", "<|endoftext|>", "<", "\n", "  ", "é", "😀", "word ", "turn>", "/", "日本", "<<turn>"]
    rows = []
    for c in [*range(25), None]:
        for t in range(RND.randint(1, 7)):
            role = RND.choice(["user", "assistant", "assistant", None, "<turn>x", "a\nb"])
            text = None if RND.random() < .1 else "".join(RND.choice(bits) for _ in range(RND.randint(0, 12)))
            rows.append((c, t if RND.random() < .95 else None, role, text))
    rows += [(3, 100, "assistant", "long " * 6000)] + [(70, 1, "assistant", "same")] * 3 + [(71, 0, "user", "")]
    rows += [(-7, i, r, r"\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]
    return rows, spark.createDataFrame([(*r, "p", "w", "s") for r in rows], CHAT)


@pytest.mark.parametrize("limit", [1 << 20, 120])
def test_chat_reads_back(chats, limit):
    rows, df = chats
    out = chat.format_conversations(df, BYTE_VOCABULARY, part_chars=limit)
    tie = {(r.r, r.t): r.h for r in df.selectExpr("coalesce(role, '') r", "coalesce(text, '') t").selectExpr("r", "t", "xxhash64(r, t) h").collect()}
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append(((t is not None, t or 0), tie[r or "", x or ""], r or "", x or ""))
    got = chat.digest_conversations(out).collect()
    assert len(got) == len(want)
    for r in got:
        said = sorted(want[r.conv_id])
        loss = "".join(x for *_, role, x in said if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(said), sha("".join(f"{a}\n{b}\n" for *_, a, b in said)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    parts = out.groupBy("conv_id").count().filter("count > 1").count()
    assert parts == 0 if limit > 1000 else parts > 10


def test_chat_parts_encode_as_the_whole(chats):
    """Parts of a conversation have the ids of the whole string, and the mask falls on the trained texts only."""
    _, df = chats
    whole = {r.conv_id: r for r in chat.format_conversations(df, BYTE_VOCABULARY).collect()}
    parts = {}
    for r in sorted(chat.format_conversations(df, BYTE_VOCABULARY, part_chars=120).collect(), key=lambda r: r.part):
        parts.setdefault(r.conv_id, []).append(r)
    for c, r in whole.items():
        assert r.formatted == "".join(p.formatted for p in parts[c]) and r.ids == [i for p in parts[c] for i in p.ids]
        assert r.loss_mask == [m for p in parts[c] for m in p.loss_mask] and len(r.ids) == len(r.starts) == len(r.loss_mask)
        assert not any(m for i, m in zip(r.ids, r.loss_mask) if i >= 50256)


def test_chat_mask_and_empty(chats):
    assert chat.digest_conversations(chat.format_conversations(chats[1].limit(0), BYTE_VOCABULARY)).count() == 0
    start, end = np.array([0, 3, 3, 5]), np.array([3, 5, 5, 9])
    assert chat.loss_mask(start, end, [(3, 5), (5, 5)]).tolist() == [False, True, True, False]
    with pytest.raises(ValueError):
        chat.loss_mask(start, end, [(4, 9)])
    with pytest.raises(ValueError):  # a tokenizer that drops white space
        t = chat.Template(public_tokenizers.path("word_bpe_49k.json"))
        text, spans = t.render([("user", " a b ")])
        chat.loss_mask(*t.encode(text)[1:], spans)


# --- hard negatives ----------------------------------------------------------------------------

def mined(rows, n=5):
    use = [(i, np.floor(np.array(v, np.float64) * 256).astype(np.int64), label, r) for r, (i, v, label) in enumerate(rows)
           if label is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    dim = max(len(v) for _, v, _, _ in use)
    m = np.array([np.pad(v, (0, dim - len(v))) for _, v, _, _ in use])
    out = []
    for a, (i, _, label, _) in enumerate(use):
        if i is None or i % 100:
            continue
        s = (m @ m[a]).tolist()
        order = sorted(range(len(use)), key=lambda j: (-s[j], use[j][0] is None, use[j][0] or 0, use[j][3]))
        for p in [j for j in order if use[j][2] == label and j != a][:n]:
            fits = [j for j in order if use[j][2] != label and 80 * s[p] <= 100 * s[j] <= 100 * s[p]][:n]
            out += [(i, use[p][0], k + 1, use[j][0], s[p], s[j]) for k, j in enumerate(fits)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    cent, rows = rng.normal(size=(12, 8)), []
    for i in range(900):
        v = cent[i % 12] + rng.normal(size=8) * .1
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(0, 5))))
    rows += [(200, *rows[200][1:])] * 3 + [(None, rows[5][1], 1), (1600, None, 1), (1700, [1.0, None], 2), (1800, [math.nan] * 8, 1), (1900, [], 1),
                                            (2000, [0.0] * 8, 1), (2100, [.5], None), (2200, [.5, .5], 2), (2300, [300.0] * 8, 2)]
    rows += [(3001 + i, rows[7][1], 3) for i in range(400)]  # one vector holds a third of all rows
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, row int, leaf string")
    return rows, df


@pytest.mark.parametrize("tree", [{}, {"leaf_rows": 40, "fanout": 4, "block": 32}, {"leaf_rows": 100, "fanout": 5, "block": 64, "sample_rows": 300}])
def test_hard_negatives(vectors, tree):
    rows, df = vectors
    got = [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **tree).collect()]
    assert sorted(got, key=str) == mined(rows) and len(got) > 100


def test_ranges_leave_subtrees_out(vectors):
    """On vectors that lie in clusters the stored ranges decide: most leaves are never compared."""
    _, df = vectors
    index = hard_negatives.Index(hard_negatives.whole_vectors(df, 256, "vec_id", "embedding", "label", F.col("vec_id") % 100 == 0), leaf_rows=40, fanout=6)
    probes = index.homes.filter("length(v) = 32").select("row", "label", "v", F.array(F.lit(55000).cast("long")).alias("low"), F.array(F.lit(65536).cast("long")).alias("high"))
    assert index.reach(probes).count() < 0.35 * probes.count() * index.tree.leaves


def test_a_probe_is_written_once_for_a_bundle(spark):
    """Where nothing can be left out, probes are repeated for bundles, not for leaves; the driver gets the sample, not a sample of every split."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(rng.normal(size=(3000, 16)) / 4)], "vec_id bigint, embedding array<float>, label int").repartition(12)
    whole = hard_negatives.whole_vectors(df, 256, "vec_id", "embedding", "label", F.col("vec_id") % 10 == 0)
    index = hard_negatives.Index(whole, leaf_rows=20, fanout=6, block=500)
    low, high = F.array(F.lit(-(1 << 40)).cast("long")), F.array(F.lit(1 << 40).cast("long"))
    reached = index.reach(index.homes.select("row", "label", "v", low.alias("low"), high.alias("high")))
    assert index.tree.leaves > 10 * index.bundles and reached.count() == 300 * index.bundles
    assert reached.agg(F.sum(F.size("leaves"))).first()[0] == 300 * index.tree.leaves
    assert max(r["count"] for r in index.blocks.groupBy("bundle").count().collect()) <= 500 and index.blocks.count() == 3000
    assert 100 <= hard_negatives.low_hashes(whole, 3000, 100).count() <= 260


def test_first_scores_keep_order():
    rng = np.random.default_rng(5)
    score, ok, row = rng.integers(0, 6, (40, 300)).astype(float), rng.random((40, 300)) < .8, rng.permutation(300)
    ok[:3] = False
    i, j = hard_negatives.first_scores(score, ok, row, 4)
    want = [(a, b) for a in range(40) for b in sorted(np.flatnonzero(ok[a]), key=lambda b: (-score[a, b], row[b]))[:4]]
    assert list(zip(i.tolist(), j.tolist())) == [(a, int(b)) for a, b in want]


def test_hard_negatives_empty(vectors):
    assert hard_negatives.hard_negatives(vectors[1].limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.hard_negatives(vectors[1], F.lit(None).cast("boolean")).count() == 0


# --- Merkle manifests --------------------------------------------------------------------------

def folded(rows, k):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        return sha("".join(map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]))))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + k])) for i in range(0, len(levels[-1]), k)])
        return levels

    def order(r):
        return (r[0] is not None, r[0] or 0), leaf(r)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    subs = {g: tree([leaf(r) for r in sorted(rs, key=order)]) for g, rs in groups.items()}
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([subs[g][-1][0] for g in names])
    out = []
    for g in names:
        for i, r in enumerate(sorted(groups[g], key=order)):
            cur = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            siblings = []
            for levels, at in ((subs[g], i), (top, names.index(g))):
                for level in levels[:-1]:
                    s = at - at % k
                    run = level[s:s + k]
                    siblings += run[:at - s] + run[at - s + 1:]
                    cur, at = sha("".join([*run[:at - s], cur, *run[at - s + 1:]])), at // k
            root = top[-1][0]
            out.append((r[0], leaf(r), subs[g][-1][0], root, sha("".join(siblings)), cur, cur == root))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def leaves(spark):
    rows = [(i if RND.random() < .95 else None, None if RND.random() < .1 else "té" * RND.randint(0, 30), RND.choice([None, "en", "en", "en", "fr", "é", "", "z"]),
             RND.choice([None, "s1", "s2"]), RND.choice([None, 5, 2 ** 63 - 1])) for i in range(300)]
    rows += rows[:5] + [(1000, "x " * 200_000, "solo", "s", 1)]
    return rows, spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, pos int, grp string")


@pytest.mark.parametrize("fanout, depth", [(2, 8), (3, 9), (2, 4096)])
def test_merkle(leaves, monkeypatch, fanout, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rows, df = leaves
    got = sorted(map(tuple, merkle.manifest_documents(df, fanout).collect()), key=str)
    assert got == folded(rows, fanout)
    changed = [r for r in got if not r[-1]]
    assert 0 < len(changed) < len(got) / 3


def test_merkle_small(spark, leaves, tmp_path):
    _, df = leaves
    assert merkle.manifest_documents(df.limit(0)).count() == 0
    one = merkle.manifest_documents(df.limit(1)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")
    m = merkle.build(df.select("doc_id", "lang", merkle.field_digest([F.col("text")]).alias("leaf")), "leaf", "lang", "doc_id")
    m.write(str(tmp_path / "m"))
    back = merkle.Manifest.read(spark, str(tmp_path / "m"))
    again = merkle.fold(merkle.Manifest(back.leaves.withColumn("new", F.lit(None).cast("string")), back.nodes, back.fanout), "new")
    assert again.filter("not verified").count() == 0 and again.count() == df.count()


def test_midstates_equal_the_library():
    value = np.array([[int(hashlib.sha256(bytes([i])).hexdigest()[8 * j:8 * j + 8], 16) for i in range(20)] for j in range(8)], np.uint32)
    digests, states = merkle.grow(value, 5, 2)
    tree = merkle.Block(digests, states, 2)
    assert tree.fold(value, np.arange(20)).T.tolist() == np.repeat(digests[-1], 20, axis=1).T.tolist()
    other = value.copy()
    other[0, 3] ^= 1
    root = merkle.grow(other, 5, 2)[0][-1]
    assert tree.fold(other[:, 3:4], np.array([3])).tolist() == root.tolist() != digests[-1].tolist()


# --- rows of their own ---------------------------------------------------------------------------

def test_embedding_rows_with_repeated_ids(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [0.0, 1.0], 1), (7, [0.0, 2.0], 1), (None, [1.0, 0.01], 1), (None, [-1.0, 0.0], 1), (8, [0.0, 1.0], None), (9, None, 1)]
    df = spark.createDataFrame([(*r, "r", "c") for r in rows], "vec_id bigint, embedding array<float>, label int, row string, component string")
    got = sorted(map(str, map(tuple, spherical.near_duplicates(df).collect())))
    assert got == sorted(map(str, [(5, 0, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False), (None, 0, None, False), (None, 0, None, False), (8, 0, 8, True), (9, 0, 9, True)]))


def test_samples_share_their_draws(spark):
    """Two weights of one term give the samples that each weight gives alone."""
    rows = [(d, RND.randrange(10 ** 6), RND.randint(1, 9) if RND.random() < .8 else None, RND.randint(1, 9)) for d in range(4) for _ in range(60)]
    df = spark.createDataFrame(rows, "doc bigint, term bigint, a bigint, b bigint").dropDuplicates(["doc", "term"])
    both = {r.doc: r for r in weighted_sampling.samples(df, ["doc"], 64, x="a", y="b").collect()}
    for name, w in (("x", "a"), ("y", "b")):
        alone = weighted_sampling.samples(df.filter(f"{w} is not null").withColumnRenamed(w, "weight"), ["doc"], 64).collect()
        assert all(r.samples == both[r.doc][name] and len(r.samples) == 64 for r in alone) and len(alone) == 4


def test_packing_pieces_of_repeated_and_null_ids(spark):
    text = "one two three " * 900
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (3, "short one")]
    got = sorted(packing.cut_pieces(spark.createDataFrame(rows, "doc_id bigint, text string"), VOCABULARY).collect(), key=str)
    long = [r for r in got if r.doc_id in (1, None)]
    assert len(long) == 6 and len({r.ids_crc32 for r in long}) == 2 and sorted(r.start for r in long) == [0] * 3 + [2048] * 3
    assert [r.length for r in got if r.doc_id == 2] == [1] and sorted(r.length for r in got if r.doc_id == 3) == [1, 3]


def test_samples_do_not_depend_on_the_block(spark, monkeypatch):
    """The number of samples in a row of the aggregation changes no sample."""
    df = spark.createDataFrame([(d, t, t % 7 + 1) for d in range(4) for t in range(d, 40, 3)], "doc bigint, term bigint, weight bigint")
    got = []
    for block in (8, 4, 2):
        monkeypatch.setattr(weighted_sampling, "BLOCK", block)
        got.append(sorted(map(tuple, weighted_sampling.samples(df, ["doc"], 64).collect())))
    assert got[0] == got[1] == got[2] and all(len(s) == 64 for _, s in got[0])
