"""The training-data operators against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import pytest

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from traceloom.llm import bpe, chaining, html_text, kd_sharding, kneser_ney, minhash, packing, spherical, toxicity, weighted_sampling
from traceloom.llm.queries import VOCABULARY

RND = random.Random(5)
VOCAB = ["w%d" % i for i in range(3000)]
SCHEMA = "doc_id bigint, text string, lang string, id string, n string, component string"


def prose(n):
    return " ".join(RND.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    shared = prose(70)
    out = [base, base, " ".join(near), None, "", "  \n", "One Two", "one two", prose(4000), prose(30) + " " + shared + " " + prose(20),
           prose(10) + " " + shared, shared.upper() + " " + prose(15), "Ünï çødé 日本 don't <|endoftext|> ΑΣ"]
    return out + [prose(RND.randint(1, 90)) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return (t or "").encode().lower().split()


def shingles(t, n=5):
    w = words_of(t)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_bpe_equals_the_library(docs, texts, empty):
    lib = Tokenizer.from_file(VOCABULARY)
    got = {r.doc_id: r for r in bpe.digest_documents(docs, VOCABULARY).collect()}
    full = {r.doc_id: r for r in bpe.encode_documents(docs, VOCABULARY).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert full[i].ids == ids and full[i].decoded == lib.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.digest_documents(empty, VOCABULARY).count() == 0


def test_bpe_odd_strings():
    lib, own = Tokenizer.from_file(VOCABULARY), bpe.WordBpe(VOCABULARY, held=50)
    alphabet = "abcdefgABZ '.,!?\n\t\x1c\x85\xa0éÉßΣ日ｅ１²½́​😀<|endoftext|>0123"
    odd = ["".join(RND.choice(alphabet) for _ in range(RND.randint(0, 40))) for _ in range(400)] + ["aaaaaaa", "a" * 301, "İ"]
    for s, (ids, number) in zip(odd, own.encode(odd), strict=True):
        assert ids.tolist() == lib.encode(s, add_special_tokens=False).ids
        assert own.decode(number) == lib.decode(ids.tolist(), skip_special_tokens=False) == own.decode_ids(ids.tolist())


def test_near_duplicates_equal_brute_force(spark, docs, texts, empty):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), root[i], root[i] == i)
    assert minhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, texts[0]), (9, texts[0]), (None, "alone here"), (4, None), (4, None)], "doc_id bigint, text string")
    rows = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert rows == {(None, 116): (9, False), (9, 116): (9, True), (None, 1): (None, False), (4, 0): (4, True)}


def test_near_copies_of_one_original(spark):
    """Copies that link with their original but hardly with one another: every link counts, whatever the hub."""
    base = prose(200).split()
    copies = []
    for i in range(60):
        w = list(base)
        for k in RND.sample(range(200), 4):
            w[k] = f"new{i}x{k}"
        copies.append(" ".join(w))
    rows = [(i + 1, t) for i, t in enumerate(copies)] + [(99, " ".join(base))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {1}


@pytest.mark.parametrize("least", [1, 2])
def test_language_model_is_kneser_ney(spark, docs, texts, least, empty):
    train = [t for t in texts[:20]]
    model = kneser_ney.train(docs.filter("doc_id < 20"), least)
    pairs, own = collections.Counter(), collections.Counter()
    for t in train:
        line = ["<s>", *words_of(t), "</s>"]
        own.update(line[1:])
        pairs.update(zip(line[:-1], line[1:]))
    before = collections.Counter(b for _, b in pairs)
    d2, d1 = (kneser_ney.discounts(*[sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for c in (pairs, before))

    def cut(n, d):
        return d[min(n, 3) - 1] if n else 0.0
    left1 = sum(cut(n, d1) for n in before.values()) / len(pairs)
    history = collections.defaultdict(dict)
    for (a, b), n in pairs.items():
        history[a][b] = n

    def p(a, b):
        low = (before[b] - cut(before[b], d1)) / len(pairs) + left1 / (len(own) + 1)
        h = history.get(a)
        if not h:
            return low
        left = sum(n if n < least else cut(n, d2) for n in h.values())
        n = h.get(b, 0)
        return ((n - cut(n, d2) if n >= least else 0) + left * low) / sum(h.values())
    assert abs(sum(p("<s>", b) for b in own) + p("<s>", "unseen") - 1) < 1e-9
    n_all = sum(own.values())
    got = {r.doc_id: r for r in kneser_ney.score(docs, model, ["doc_id", "lang"]).collect()}
    for i, t in enumerate(texts):
        line = ["<s>", *words_of(t), "</s>"]
        assert (got[i].n_tokens, got[i].train_tokens, got[i].n_known) == (len(line) - 1, n_all, sum(own[w] > 0 for w in line[1:]))
        assert math.isclose(got[i].base_score, sum(math.log10((own[w] + 1) / (n_all + len(own) + 1)) for w in line[1:]), rel_tol=1e-9)
        assert math.isclose(got[i].score, sum(math.log10(p(a, b)) for a, b in zip(line[:-1], line[1:])), rel_tol=1e-9)
    assert kneser_ney.score(docs, kneser_ney.train(empty), ["doc_id"]).filter("score is null or score > 0").count() == 0


def test_language_model_stores_pairs_counted_once(spark):
    model = kneser_ney.train(spark.createDataFrame([("a b",), ("a b",), ("a c",)], "text string"))
    token, before, _ = kneser_ney.token_pairs([b"a c"])
    assert model.least == 1 and model.store.find("pair", kneser_ney.pair_keys(token, before), (np.uint32,))[0].tolist() == [3, 1, 1]


def test_restoring_disguised_words(spark):
    plain = spark.createDataFrame([(i, " ".join(RND.choice(["idiot", "the", "house", "clown", "good", "reads", "a", "scum"]) for _ in range(50)))
                                   for i in range(40)], "doc_id bigint, text string")
    model = toxicity.character_model(plain)
    for odd, want in (("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("cl0wn", "clown"), ("sccccum", "scum"), ("i d i o t", "idiot"), ("5cum", "scum")):
        assert toxicity.decode(odd, model).strip() == want
    own = toxicity.Restorer(model)
    assert own.restore("the 1d1ot reads a good house") == b"the idiot reads a good house"
    assert own.restore("you c l o w n good") == b"you clown good"


def test_restoring_long_and_mixed_disguises(spark):
    """Spaced sentences of any length, and spacing together with signs or accented letters."""
    plain = spark.createDataFrame([(i, " ".join(RND.choice(["idiot", "the", "house", "clown", "good", "reads", "größe", "scum"]) for _ in range(50)))
                                   for i in range(40)], "doc_id bigint, text string")
    own = toxicity.Restorer(toxicity.character_model(plain))
    for odd, want in (("1 d 1 0 t", "idiot"), ("i d 1 o t", "idiot"), ("g r ö ß e", "größe"), ("$ c u m", "scum")):
        assert own.restore(f"the house {odd} reads good").decode() == f"the house {want} reads good"
    line = ["idiot", "the", "clown", "house", "scum", "good"] * 40
    got = own.restore("reads " + " ".join("".join(line)) + " reads").decode()
    assert got.replace(" ", "") == "reads" + "".join(line) + "reads" and got.count(" ") < len("".join(line)) / 3
    assert own.restore("see 1 2 3 4 0 1 there") == b"see 1 2 3 4 0 1 there"


def test_toxicity_scores_held_out(spark, empty):
    bad = ["zorg", "blaff", "krunt"]
    rows, labels = [], []
    for i in range(400):
        w = prose(40).split()
        if i % 4 == 0:
            w[RND.randrange(40)] = RND.choice(bad)
        rows.append((i, " ".join(w), "en", "x", "y", "z"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(400, None, None, None, None, None), (401, "", "en", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lab, ["doc_id", "text"]).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got.values()) and got[400].predicted == got[401].predicted == 0
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i].held_out} >= set(held)
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert toxicity.toxicity(docs, lab.filter("toxic = 5"), ["doc_id"]).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(empty, lab, ["doc_id"]).count() == 0


def test_fingerprints_estimate_generalised_jaccard(spark, docs, texts, empty):
    got = {r.doc_id: r for r in weighted_sampling.fingerprints(docs).collect()}

    def weights(t):
        c = collections.Counter()
        for w in words_of(t):
            c[w] += len(w.decode())
        return c
    off = []
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[:len(t) - len(t) // 4] + n[:len(t) // 4]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = weights(t), weights(edited)
        if a and b:
            off.append(got[i].near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(off)) < 0.05 and np.std(off) < 0.12
    assert got[0].fingerprint == got[1].fingerprint and got[3].fingerprint == "" and got[4].near_next == 1.0
    assert weighted_sampling.fingerprints(empty).count() == 0


def test_samples_of_very_long_texts(spark):
    """50,000 terms a text, frequent ones shared, rare ones not: the collision rate stays the generalised Jaccard similarity."""
    n, common = 50_000, 2_000
    w = [50_000 // (i + 1) + 1 for i in range(n)]
    true = sum(w[:common]) / (sum(w[:common]) + 2 * sum(w[common:]))
    i = F.col("i")
    rows = spark.range(2).withColumnRenamed("id", "doc").crossJoin(spark.range(n).withColumnRenamed("id", "i")).select(
        "doc", F.when(i < common, i).otherwise(i * 2 + F.col("doc") + n).alias("term"), (F.floor(F.lit(50_000) / (i + 1)) + 1).alias("weight"))
    a, b = (r.samples for r in weighted_sampling.samples(rows, ["doc"], 512).collect())
    assert len(a) == len(b) == 512 and abs(np.mean(np.array(a) == np.array(b)) - true) < 0.08


def test_shards_are_even_and_groups_stay(spark, docs, texts, empty):
    many = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).union(
        spark.createDataFrame([(None, "no id", None, None, None, None)] * 2, SCHEMA))
    got = kd_sharding.shard(many, shards=4, heavy=0.3).collect()
    assert len(got) == 2 * len(texts) + 2
    shards, size = collections.defaultdict(list), collections.Counter()
    for r in got:
        shards[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        assert by_id[i].size == len((t or "").encode()) + 1 and by_id[i].text_crc32 == zlib.crc32((t or "").encode())
        assert by_id[i].size > 5000 or by_id[i].shard == by_id[i + 1000].shard
    assert kd_sharding.shard(empty, shards=4).count() == 0


def test_repeated_passages(spark, docs, texts, empty):
    got = {(r.doc_id, r.source): r for r in chaining.repeats(docs).collect()}
    assert set(got) == {(1, 0), (2, 0), (10, 9), (11, 9)}
    assert (got[10, 9].start, got[10, 9].end, got[10, 9].source_start) == (10, 80, 30)
    assert (got[11, 9].start, got[11, 9].end) == (0, 70)
    left = {r.doc_id: r.text for r in chaining.without_repeats(docs).collect()}
    assert left[9] == texts[9] and left[10] == " ".join(texts[10].split()[:10]) and left[1] == "" and left[3] is None
    assert all(left[i] == texts[i] for i in range(12, len(texts)))
    assert chaining.repeats(empty).count() == 0


def test_repeats_whose_parts_stand_in_earlier_documents(spark):
    """No first document of a seed holds the repeat, or it stands twice: all its words lie in passages."""
    one, two, twice = prose(30), prose(30), prose(60)
    texts = [f"{prose(20)} {one} {prose(20)}", f"{prose(20)} {two} {prose(20)}", f"{prose(40)} {one} {two} {prose(40)}", f"{prose(25)} {one} {two} {prose(25)}",
             f"{twice} {prose(80)}", f"{prose(10)} {twice} {prose(30)} {twice} {prose(10)}", "same " * 3000, "other " + "same " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = chaining.repeats(docs).collect()
    cuts = collections.defaultdict(set)
    for r in got:
        assert r.source < r.doc_id and r.end - r.start >= 50 and r.alike >= 0.8
        cuts[r.doc_id].update(range(r.start, r.end))
    assert dict(cuts) == {3: set(range(25, 85)), 5: {*range(10, 70), *range(100, 160)}, 7: set(range(1, 2001))}
    assert {r.source for r in got if r.doc_id == 3} == {2}
    left = {r.doc_id: len(r.text.split()) for r in chaining.without_repeats(docs).collect()}
    assert (left[3], left[5], left[7]) == (50, 50, 1)


def test_parts_of_a_chain_that_is_not_alike_enough():
    """Long equal pieces between insertions, and a run whose ends hardly agree: every equal piece lies in a passage."""
    number = iter(range(10 ** 6))

    def new(n):
        return [next(number) for _ in range(n)]
    for sizes, gaps in (((50, 50, 50), (20, 20)), ((55, 55), (28,)), ((50, 3, 50), (30, 30))):
        h, g, spans = new(9), new(5), []
        for n, gap in zip(sizes, (*gaps, 9), strict=True):
            spans.append((len(h), len(g), n))
            piece = new(n)
            h, g = h + piece + new(gap), g + piece
        got = chaining.passages(*(np.array(x, np.uint64) for x in (h, g)), spans, 50, 0.8)
        assert all(r[1] - r[0] >= 50 and r[4] >= 0.8 for r in got)
        assert all(any(r[0] <= x and x + n <= r[1] for r in got) for x, _, n in spans if n >= 50)
    piece, tail = new(60), [new(5) + [None] * 12 for _ in range(9)]
    h, g = (np.array(new(9) + piece + [w if w is not None else next(number) for t in tail for w in t], np.uint64) for _ in "ab")
    assert chaining.passages(h, g, [(9, 9, 60 + 8 * 17 + 5)], 50, 0.8) == [(9, 74, 9, 74, 1.0)]


def test_chains_against_all_predecessors():
    for _ in range(30):
        m = RND.randint(1, 12)
        x, y = (np.array([RND.randint(0, 60) for _ in range(m)]) for _ in "ab")
        n = np.array([RND.randint(3, 9) for _ in range(m)])
        order = sorted(range(m), key=lambda i: (x[i], y[i]))
        best = {}
        for i in order:
            best[i] = n[i] + max([0.0] + [best[j] - chaining.GAP * (x[i] - x[j] - n[j] + y[i] - y[j] - n[j])
                                          for j in best if x[j] + n[j] <= x[i] and y[j] + n[j] <= y[i]])
        chain = chaining.chains(x, y, n)[0]
        cost = sum(n[i] for i in chain) - sum(chaining.GAP * (x[b] - x[a] - n[a] + y[b] - y[a] - n[a]) for a, b in zip(chain, chain[1:]))
        assert math.isclose(cost, max(best.values()))
        assert sorted(i for c in chaining.chains(x, y, n) for i in c) == list(range(m))


def page(i, body, host="a.example"):
    return (i, f"https://{host}/p{i}", body, "clash")


def test_main_text_of_pages(spark):
    rows = []
    for i in range(8):
        rows.append(page(i, f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a>Home</a></nav><div class='x9'>Subscribe now</div>"
                            f"<article><h1>Title {i}</h1><p>Fish &amp; chips  {i}<p>Two<br>lines<section class='z'>Read also</section></article>"
                            f"<div id='comments'><p>nice {i}</p></div><footer>f</footer></body></html>"))
        rows.append(page(20 + i, f"<body><div class='q'>Same box</div><div><p>Body {i}</p><ul><li>one {i}<li>two {i}</ul></div><aside>no</aside></body>", "b.example"))
    rows += [(50, None, None, None), (51, "bad url", "", None), (52, "u", "just text &lt;", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for i in range(8):
        assert got[i].text == f"Title {i}\nFish & chips {i}\nTwo lines"
        assert got[20 + i].text == f"Body {i}\none {i}\ntwo {i}"
        assert got[i].n_chars == len(got[i].text)
    assert (got[50].text, got[51].text, got[52].text) == ("", "", "just text <")
    assert html_text.extract(pages.filter("page_id < 0")).count() == 0


def test_packing_is_gapless_and_tight(spark, docs, texts, empty):
    lib = Tokenizer.from_file(VOCABULARY)
    got = packing.pack_documents(docs, VOCABULARY, capacity=256, group_items=20).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 256)) and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) for r in own)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 256) + 1
    assert packing.pack_documents(empty, VOCABULARY).count() == 0


def test_packing_ends_where_no_bin_can_be_filled(spark, monkeypatch):
    """Pieces of which no two fit into a sequence, in far more than one group."""
    levels, level = [], packing.pack_groups
    monkeypatch.setattr(packing, "pack_groups", lambda *a: levels.append(a[1]) or (level(*a) if len(levels) < 12 else pytest.fail(f"groups {levels}")))
    rows = [(i, RND.randint(1100, 1900)) for i in range(5000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, length bigint"), group_items=500).collect()
    assert sorted((r.doc_id, r.length) for r in got) == rows
    assert len({r.sequence_id for r in got}) == 5000 and all(r.offset == 0 for r in got)
    assert levels[-1] == 1


def test_crossover_keeps_every_item():
    lengths = [RND.randint(1, 99) for _ in range(80)]
    first, second = (packing.evolve(lengths, 100, [], s, 3, 0) for s in (1, 2))
    child = packing.crossover(first[0], second[-1], lengths, 100, RND)
    assert sorted(i for b in child for i in b) == list(range(80)) and all(sum(lengths[i] for i in b) <= 100 for b in child)


def test_embedding_links_equal_brute_force(spark):
    rnd = np.random.default_rng(3)
    centre = rnd.normal(size=(6, 8))
    x = np.concatenate([centre[i % 6] + rnd.normal(size=8) * 0.25 for i in range(160)]).reshape(-1, 8)
    rows = [(i, [float(v) for v in x[i]], i % 2, "clash") for i in range(160)] + [(200, [float(v) for v in x[0] * 3], 0, ""), (201, [float(v) for v in x[0] * 3], 0, "")]
    rows += [(300, None, 0, ""), (301, [0.0] * 8, 0, ""), (302, [float("nan")] * 8, 0, ""), (303, [None] + [1.0] * 7, 0, ""), (304, [float(v) for v in x[0]], None, ""),
             (None, [float(v) for v in x[0]], 0, ""), (305, [], 0, "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, component string")
    got = {r.vec_id: r for r in spherical.near_duplicates(df, cell_rows=20, block=8).collect()}
    real = [r for r in rows if r[0] is not None and r[0] < 300]
    u = np.array([r[1] for r in real])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.93) & (np.array([r[2] for r in real])[:, None] == np.array([r[2] for r in real]))
    np.fill_diagonal(hit, False)
    root = np.array([r[0] for r in real])
    for _ in real:
        root = np.minimum(root, np.where(hit, root[None], 10 ** 9).min(axis=1))
    for i, r in enumerate(real):
        assert (got[r[0]].n_links, got[r[0]].component_id) == (hit[i].sum(), root[i])
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (300, 301, 302, 303, 304, 305)) and got[None].kept is False
    assert spherical.near_duplicates(df.filter("label = 77")).count() == 0


def test_pipeline_runs_its_stages(spark):
    import corpus_pipeline
    from traceloom.llm.common import table
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        assert after.join(docs, "doc_id", "left_anti").count() == 0
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert public_tokenizers.path("word_bpe_49k.json") == VOCABULARY


def test_near_copies_stage_with_null_and_repeated_ids(spark):
    import corpus_pipeline
    one, two, three = prose(80), prose(80), prose(80)
    rows = [(None, one), (5, two), (5, two), (9, three), (None, three), (7, three), (3, None), (None, None)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, got), key=key) == sorted([(None, one), (5, two), (7, three), (3, None), (None, None)], key=key)


@pytest.mark.parametrize(("block_rows", "block_shingles"), [(1024, 1 << 18), (4, 1 << 18), (1024, 300)])
def test_blocks_join_what_brute_force_joins(spark, block_rows, block_shingles):
    """Members of crowded bands, blocks large and small: the groups are those of all pairs, empty members give nothing."""
    base = prose(60).split()
    texts = [" ".join(w if RND.random() > 0.03 else f"x{i}y{k}" for k, w in enumerate(base)) for i in range(40)] + ["", "one two"]
    members = [(b, i, i - i % 2) for i in range(len(texts)) for b in ((1, 2) if i % 3 else (2, 3))]
    sets = [shingles(t) for t in texts]

    def grouped(links):
        root = list(range(len(texts)))
        for a, b in list(links) + [(i, i - i % 2) for i in root]:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
        return root
    want = grouped((i, j) for i in range(len(texts)) for j in range(i)
                   if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    got = minhash.crossed(spark.createDataFrame(members, "band bigint, rep bigint, c bigint"), spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"),
                          spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "rep bigint, n_shingles bigint"), 5, 75, block_rows, block_shingles)
    assert grouped((r.a, r.b) for r in got.collect()) == want
