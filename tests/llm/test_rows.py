"""Rows with null and repeated ids, further sources of passages, and clashing column names, against brute force."""

import collections
import random

import numpy as np
import pytest

from traceloom.llm import chaining, minhash
from traceloom.llm.common import grams, words

RND = random.Random(11)
VOCAB = ["w%d" % i for i in range(4000)]


def prose(n):
    return " ".join(RND.choice(VOCAB) for _ in range(n))


def test_passages_of_rows_with_null_and_repeated_ids(spark):
    """Every row is its own document: a row with a repeated id keeps its words, a row without an id loses a repeated passage."""
    passage, own, other, tail, last = prose(70), prose(10), prose(200), prose(10), prose(20)
    rows = [(1, f"{own} {passage}", "a"), (5, f"{tail} {passage}", "b"), (5, other, "c"), (None, f"{last} {passage}", "d"), (7, other, "e"),
            (None, None, "f"), (8, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _spans string").withColumnRenamed("_spans", "row")
    left = {r["row"]: (r.doc_id, r.text) for r in chaining.without_repeats(docs).collect()}
    assert chaining.without_repeats(docs).columns == ["doc_id", "text", "row"]
    assert left == {"a": rows[0][:2], "b": (5, tail), "c": (5, other), "d": (None, last), "e": (7, ""), "f": (None, None), "g": (8, "")}
    got = sorted((str(r.doc_id), r.start, r.end, r.source) for r in chaining.repeats(docs).collect())
    assert got == [("5", 10, 80, 1), ("7", 0, 200, 5), ("None", 20, 90, 1)]


def test_equal_rows_keep_one_text(spark):
    text = prose(60)
    left = [r.text for r in chaining.without_repeats(spark.createDataFrame([(3, text)] * 4 + [(None, text)], "doc_id bigint, text string")).collect()]
    assert sorted(left) == ["", "", "", "", text]


@pytest.mark.parametrize("depth", [1, 2])
def test_passages_whose_phrases_stand_in_earlier_documents(spark, depth):
    """80 words, four of them changed, whose phrases of 20 words stand alone in ``depth`` earlier documents each: found with the right source."""
    texts, sources = [], {}
    firsts, lasts = [], []
    for _ in range(20):
        phrases = [prose(20) for _ in range(4)]
        texts += [f"{prose(15)} {p} {prose(15)}" for p in phrases for _ in range(depth)]
        whole = " ".join(phrases)
        near = whole.split()
        for at in (9, 31, 52, 70):
            near[at] = "changed%d" % RND.randrange(10 ** 9)
        firsts.append(f"{prose(20)} {whole} {prose(20)}")
        lasts.append(f"{prose(25)} {' '.join(near)} {prose(25)}")
    for i in range(20):
        sources[len(texts) + 20 + i] = len(texts) + i
    docs = spark.createDataFrame(list(enumerate(texts + firsts + lasts)), "doc_id bigint, text string")
    covered = collections.defaultdict(set)
    for r in chaining.repeats(docs).collect():
        assert r.end - r.start >= 50 and r.alike >= 0.8
        if sources.get(r.doc_id) == r.source:
            covered[r.doc_id].update(range(r.start, r.end))
        else:
            pytest.fail(f"{r.doc_id} has nothing in common with {r.source} but a phrase")
    assert sum(len(covered[d] & set(range(25, 105))) >= 70 for d in sources) >= 19


def test_a_passage_behind_many_documents_with_its_phrases(spark):
    """80 words, four changed at the phrases' ends, whose phrases of 20 words stand alone in five earlier documents each: no round before finds anything."""
    texts, firsts, lasts = [], [], []
    for _ in range(6):
        phrases = [prose(20) for _ in range(4)]
        texts += [f"{prose(15)} {p} {prose(15)}" for p in phrases for _ in range(5)]
        near = " ".join(phrases).split()
        for at in (19, 39, 59, 70):
            near[at] = "changed%d" % RND.randrange(10 ** 9)
        firsts.append(f"{prose(20)} {' '.join(phrases)} {prose(20)}")
        lasts.append(f"{prose(25)} {' '.join(near)} {prose(25)}")
    docs = spark.createDataFrame(list(enumerate(texts + firsts + lasts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.source) for r in chaining.repeats(docs).collect() if r.end - r.start >= 70}
    assert got == {(len(texts) + 6 + i, len(texts) + i) for i in range(6)}


def test_windows_that_cannot_reach_a_passage():
    """``may_reach`` leaves out no pair of windows whose texts have a passage, and most of those with only a phrase."""
    rng, passed = np.random.default_rng(5), 0
    for case in range(400):
        a = rng.integers(1, 1 << 62, 300).astype(np.uint64)
        b = rng.integers(1, 1 << 62, 300).astype(np.uint64)
        n = int(rng.integers(16, 49))
        b[100:100 + n] = a[100:100 + n]
        if case % 2:  # the passage goes on behind single changed, lost or added words
            tail = a[100 + n:180].copy()
            tail[0] = 7
            tail[rng.integers(1, len(tail), case % 7)] = 9
            tail = np.insert(tail, 0, 11) if case % 3 == 0 else tail[case % 3 - 1:]
            b[100 + n:100 + n + len(tail)] = tail
        found = bool(chaining.passages(a, b, [(100, 100, n)], 50, 0.8))
        w = chaining.window_at(b, 100)[None]
        hit = bool(chaining.may_reach(chaining.window_at(a, 100), n - 5, w, np.array([n - 5]), 50)[0])
        assert hit or not found
        passed += hit and case % 2 == 0
    assert passed == 0


def test_near_copies_of_rows_with_null_and_repeated_ids(spark):
    one, two, three = prose(90), prose(90), prose(90)
    near = one.replace(one.split()[40], "changed", 1)
    rows = [(9, one), (None, near), (3, two), (5, two.replace(two.split()[50], "other", 1)), (5, three), (None, None), (2, ""), (None, prose(40))]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in
                              minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == collections.Counter([(9, 86, 9, True), (None, 86, 9, False), (3, 86, 3, True), (5, 86, 3, False), (5, 86, 5, True),
                                       (None, 0, None, False), (2, 0, 2, True), (None, 36, None, False)])


def test_stages_on_clashing_columns_null_ids_and_empty_tables(spark):
    """Extra columns come back as they are from every stage, with every name that the operators use themselves."""
    import corpus_pipeline
    extra = ["score", "predicted", "held_out", "_id", "_spans", "_row", "item", "row", "id", "m", "c0", "tie", "own", "component", "_text"]
    texts = [(1, prose(60)), (None, prose(50)), (2, prose(30)), (2, prose(20)), (3, None), (4, "")]
    schema = "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame([(*t, *[f"{c} {i}" for c in extra]) for i, t in enumerate(texts)], schema)
    none = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == docs.columns and sorted(map(str, after.collect())) == sorted(map(str, docs.collect())), name
        assert stage(spark, none, "/root/testdata/sf0.001").collect() == [], name
    packed = corpus_pipeline.pack(spark, docs, "")
    assert packed.count() == len(texts) and corpus_pipeline.pack(spark, none, "").count() == 0


def test_texts_are_dealt_once(spark, monkeypatch):
    """After the first shuffle, every join that reads texts reads them from buckets; the tables go with their scope."""
    rnd = np.random.default_rng(5)
    said = [" ".join(f"w{x}" for x in rnd.integers(0, 10**6, 120)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t if i % 3 else said[0][:400] + " " + t) for i, t in enumerate(said * 2)], "doc_id bigint, text string")
    plans = []
    for module in (chaining, minhash):
        monkeypatch.setattr(module, "by_text", lambda df, fn, kind, f=module.by_text: plans.append(df._jdf.queryExecution().toString()) or f(df, fn, kind))
    before, old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), {t.name for t in spark.catalog.listTables()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert chaining.repeats(docs).count() >= 12 and minhash.near_duplicates(docs).count() == 24
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [p for p in plans if "Join" in p.split("== Physical Plan ==")[1] and "FileScan" in p]
    scans = [line for p in joins for line in p.splitlines() if "FileScan" in line and "text:string" in line]
    assert len(joins) >= 3 and scans and all("Bucketed: true" in line for line in scans)
    assert {t.name for t in spark.catalog.listTables()} == old


def test_seeds_of_many_texts():
    rnd = np.random.default_rng(6)
    for _ in range(50):
        texts = [" ".join(f"w{x}" for x in rnd.integers(0, rnd.choice([3, 500]), rnd.integers(0, rnd.choice([6, 20, 200])))).encode() for _ in range(6)]
        h, at, _, _ = words(texts)
        seed, pos, many = chaining.seeds_of(h, at)
        own = [grams(h[i:j], chaining.K) if j - i >= chaining.K else h[:0] for i, j in zip(at[:-1], at[1:], strict=True)]
        places = [chaining.minimizers(g, chaining.WINDOW) for g in own]
        assert many.tolist() == [len(p) for p in places] and pos.tolist() == np.concatenate(places).tolist()
        assert seed.tolist() == np.concatenate([g[p] for g, p in zip(own, places, strict=True)]).tolist()
