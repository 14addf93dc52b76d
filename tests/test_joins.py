"""Substring joins, close names and mention cascades against plain versions."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import closeness, graph, substrings
from millrace.plans import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [substrings.FEW, 0])
def test_contains_join_is_contains(spark, monkeypatch, few):
    monkeypatch.setattr(substrings, "FEW", few)
    r = random.Random(3)
    texts = ["".join(r.choice("abcç \n") for _ in range(r.randrange(0, 60))) for _ in range(80)] + ["", None, "x" * 3000 + "needle" + "y" * 3000, "😀😀a"]
    needles = ["a", "ab", "abc", "çab", "needle", "ca b", " \n", "", None, "ab", "absent", "zz", "😀a", *{t[3:9] for t in texts if t and len(t) > 9}]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string").withColumn("needle", F.lit(1))
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    got = substrings.contains_join(t, n)
    assert sorted(map(tuple, got.collect())) == sorted((k, x) for k, s in enumerate(texts) if s for x in set(needles) if x and x in s)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert substrings.contains_join(t, n.where("false")).count() == 0 and substrings.contains_join(t.where("false"), n).count() == 0


def test_first_token_decides(spark):
    t = spark.createDataFrame([(1, "has warfarin and sodium"), (2, "only sodium"), (3, None)], "text_id long, text string")
    e = spark.createDataFrame([("A", ["warfarin", "sodium"]), ("B", ["sodium", "warfarin"]), ("C", []), ("D", None)], "entity string, tokens array<string>")
    assert sorted(map(tuple, substrings.first_tokens(t, e).collect())) == [(1, "A", "warfarin"), (1, "B", "sodium"), (2, "A", "sodium"), (2, "B", "sodium")]


def plain_mention(mention, exclude, known):
    low = mention.lower().strip()
    names = sorted(known)
    if len(low) < 4:
        return None
    whole = [n for n in names if n.lower() == low]
    if whole:
        return whole[0] if whole[0] != exclude else None
    for n in names:
        if n.lower().startswith(low) and n != exclude:
            return n
    if len(low) >= 6:
        for n in names:
            if n != exclude and (low in n.lower() or n.lower().startswith(low[:6])):
                return n
    for n in names:
        if n != exclude and (low in (known[n] or "").lower() or low in n.lower()):
            return n
    return None


def test_mentions_go_down_the_tiers(spark):
    known = {"COUMADIN 5": "warfarin", "Coumarol": None, "BELOC ZOK": "metoprolol", "ZOKBEL": "metoprolol", "ASPIRIN": "asetilsalisilik"}
    asked = [(m, x) for m in ("coumadin 5", "coum", "COUMAD", "coumadX", "maroL", "marol", "zok ", "oc z", "metop", "aspirin", "warfarin", "abc", "", "nothing at all", "bel") for x in (None, "COUMADIN 5", "ASPIRIN")]
    got = {(r.mention, r.exclude): r["name"] for r in substrings.mention_nodes(spark.createDataFrame(asked, "mention string, exclude string"), spark.createDataFrame(list(known.items()), "name string, ingredient string")).collect()}
    assert got == {k: v for k, v in ((a, plain_mention(*a, known)) for a in asked) if v is not None}


def test_blocks_are_those_of_difflib(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcde ") for _ in range(r.randrange(0, 14)))
    pairs = [(word(), word()) for _ in range(400)] + [("", ""), ("", "a"), ("same", "same")]
    d = spark.createDataFrame(pairs, "a string, b string")
    for row in d.select("a", "b", closeness.ratio(F.col("a"), F.col("b")).alias("r")).collect():
        assert row.r == difflib.SequenceMatcher(None, row.a, row.b).ratio(), row


@pytest.mark.parametrize("few, least, most", [(closeness.FEW, 0.8, 5), (0, 0.82, 3), (closeness.FEW, 0.6, 1)])
def test_close_names_are_those_of_difflib(spark, monkeypatch, few, least, most):
    monkeypatch.setattr(closeness, "FEW", few)
    r = random.Random(7)
    names = [x[0] for x in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_name").distinct().collect()] + ["a", "ab", "abc", "aab", "yy", "", "İlaç", "a" * 30, "ab" * 15]
    asked = []
    for x in names * 3:
        at = r.randrange(0, len(x) + 1)
        asked += [x[:at] + r.choice("xyz a") + x[at:], x[:at] + x[at + 2 :], x[at:] + x[:at]]
    asked += ["", "q", None, "ba"]
    q = spark.createDataFrame([(k, x) for k, x in enumerate(asked)], "q long, text string")
    got = closeness.close_names(q, spark.createDataFrame([(x,) for x in [*names, None, "a"]], "name string"), least, most)
    found = {}
    for row in got.collect():
        found.setdefault(row.q, []).append((row.ratio, row["name"]))
    for k, x in enumerate(asked):
        want = difflib.get_close_matches(x, [n for n in names if n], most, least) if x else []
        assert [n for _, n in sorted(found.get(k, []), reverse=True)] == want, x
    assert not any(w in plan(got) for w in ("Python", "Pandas", "NestedLoop", "Cartesian"))


@pytest.mark.parametrize("name", ["peer_edges", "propagate_group_edges"])
def test_edges_of_groups_are_sent_twice_and_read_from_one_exchange(spark, name):
    """By their source, and by their group in arrays; members and ends of a group read the same exchange."""
    got = QUERIES[name](spark, "/root/testdata/sf0.01")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 4  # two of them for each of members and ends, which are the same


def test_null_ends_and_members_are_none(spark):
    members = spark.createDataFrame([(1, "a"), (2, "a"), (None, "a")], "id long, group string")
    edges = spark.createDataFrame([(1, 10), (1, None), (None, 11)], "src long, dst long")
    assert [tuple(r)[:3] for r in graph.peers(edges, members).collect()] == [(2, 10, 1)]
    assert [tuple(r) for r in graph.lacking(edges, members.withColumnRenamed("id", "src")).collect()] == [(2, 10)]
    assert [tuple(r)[:2] for r in graph.propagated(edges, members).collect()] == [(2, 10)]
