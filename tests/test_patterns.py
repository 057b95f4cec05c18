"""The literal index of extraction rules against trying every rule, and depth-aware comma splitting."""

import random
import re

import pytest
from pyspark.sql import functions as F

from traceloom.functions import edge_text as T
from traceloom.operators import extract as X
from traceloom.operators.pattern_index import FIELDS, RuleIndex, required_literal
from traceloom.plans.catalog.extract import many_rules

RND = random.Random(3)


@pytest.mark.parametrize("pattern, literal", [
    (r"Object Name: (tool7\.exe)", "Object Name: tool7.exe"), (r"(?i)abc", ""), (r"abc|abd", "ab"), (r"x?(?:abc)+d", "abc"), (r"a*", ""),
    (r"^ab(?=cd)cde$", "abcde"), (r"[xy]long(?i:short)er", "long"), (r"(a)(b)\1c", "ab"), (r"(?:ab){2,}", "ab"), (r"foo(?:bar)?bazz", "bazz")])
def test_required_literal(pattern, literal):
    assert required_literal(pattern) == literal


def every_rule(rules, line):
    """Edges without the index: every rule is a candidate."""
    index = RuleIndex(rules)
    index.number, index.always = {}, list(range(len(rules)))
    return index.edges(line)


def test_index_equals_all_rules():
    atoms = ["ab", "cd", r"(\w+)", r"x?", "(?:q|r)", r"(a)|(b)", r"\d+", "[xyz]", "k{2}", "(?i:Z)", r"(\w+)-(\d+)"]
    rules = []
    for _ in range(400):
        rule = {f: "".join(RND.choices(atoms, k=RND.randint(1, 3))) for f in FIELDS if RND.random() < .8}
        if RND.random() < .2:
            rule["source"] = tuple(RND.sample(atoms + ["NOT APPLICABLE"], 2))
        if RND.random() < .2:
            rule["timestamp"] = "NO TIMESTAMP"
        rules.append(rule)
    index = RuleIndex(rules)
    found = 0
    for _ in range(300):
        line = "".join(RND.choices(["ab", "cd", "x", "q", "a", "b", "12", "kk", "z", "Z", "-", " ", "é"], k=RND.randint(0, 12)))
        edges = index.edges(line)
        assert edges == every_rule(rules, line)
        found += len(edges)
    assert found > 1000


def test_both_ways_agree(spark):
    """Column expressions and the index find the same edges, from matching to the clean-up."""
    rules = [r for r in many_rules(8)] + [{"source": r"(\w+):(\d+) to", "dest": r"to (\w+) (\w+)", "action": "NO LABEL", "timestamp": None}]
    lines = ["4663 Subject ID: U1 Object ID: H3 Object Name: tool3.exe Accesses: Read Time: 10:00:00:PM", "x host:22 to peer next", "h host:a to",
             "2018-01-01 10:00:00 U3 AAAA: host7.net resolve Lookup 7", "D uri=http://h5/ alt=http://h5 from page2.html https GET click", "", None, "'q:1 to \"a b"]
    logs = spark.createDataFrame(list(enumerate(lines)), "log_idx bigint, line string")
    one = logs.filter("line is not null").select("log_idx", F.inline(X.match_patterns(F.col("line"), rules))).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, X.match_with_python(logs, rules).collect())) and len(one) >= 7
    for builtin in (True, False):
        a, b = (sorted(map(str, X.extract_edges(logs, rules, builtin_ids=builtin, indexed=i).collect())) for i in (False, True))
        assert a == b and (a or builtin)


def test_many_rules_need_few_tries():
    """A line is tried against the rules whose literals it holds, not against all."""
    index = RuleIndex(many_rules(4000))
    assert len(index.rules) == 4000 and not index.always
    assert len(index.candidates("4663 Subject ID: U1 Object ID: H33 Object Name: tool33.exe Accesses: Read Time: 10")) == 2
    assert index.candidates("nothing of interest") == []


def split_plain(text):
    parts, depth, piece = [], 0, ""
    for ch in text:
        if ch == "," and depth == 0:
            parts.append(piece)
            piece = ""
            continue
        depth += {"(": 1, ")": -1}.get(ch, 0)
        piece += ch
    return [p.strip() for p in parts + [piece] if p.strip()]


def test_comma_parts_of_any_depth(spark):
    texts = ["".join(RND.choices("ab,() \n", k=RND.randint(0, 25))) for _ in range(300)] + ["a,b(c,(d,(e,f),g),h),i", ",,", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select("a", T.comma_parts(F.col("a")).alias("p")).collect()
    for r in rows:
        want = [p for p in (re.sub(r"^\s+|\s+$", "", x) for x in split_plain(r.a)) if p]
        assert r.p == want
