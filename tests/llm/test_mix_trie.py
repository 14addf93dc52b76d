"""Prefix trie, importance resampling and mixing against plain versions."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import importance, mixing, prefix_trie

TALK = "conv_id long, turn int, role string, text string, key string, depth int"


def plain_trie(rows, rebuilt):
    talks = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn, role or "", text or ""))
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()[:16]
    own = {c: [x[1:] for x in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, digest(*x[1:])))] for c, v in talks.items()}
    paths = {}
    for c, t in own.items():
        base, h = c - int(math.fmod(c, 100)), zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(base, [])[:h] + t[h:] if rebuilt and base != c else t)
    members = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    out = []
    for n, who in members.items():
        below = [m for m in members if m[: len(n)] == n]
        ends = ",".join(str(c) for c in sorted(c for c in who if paths[c] == n))
        out.append((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), kids[n], sum(not kids[m] for m in below), sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("range_bytes, fan", [(prefix_trie.RANGE_BYTES, prefix_trie.FAN), (900, 2), (300, 3)])
def test_trie_is_the_plain_one_in_ranges_of_any_size(spark, monkeypatch, range_bytes, fan):
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    rng = np.random.default_rng(5)
    rows = []
    for c in [*range(0, 60), 100, 103, 107, 250, 251, -3, -101, -100]:
        n = int(rng.integers(0, 7)) if c % 9 else 1
        rows += [(c, None if k == 2 else k, None if k % 3 == 0 else "user", ["same", "", None, "çok", "x" * 40][int(rng.integers(0, 1 + min(c % 7, 4)))]) for k in range(n)]
    rows += [(None, 0, "user", "of none"), rows[5], rows[5], (7, 1, "user", "tie"), (7, 1, "user", "another tie")]
    d = spark.createDataFrame([(*r, "k", 0) for r in rows], TALK).repartition(3)
    got = prefix_trie.trie(prefix_trie.strings(prefix_trie.turns(d), "conv_id - conv_id % 100", prefix_trie.heads_of), range_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows, True)
    assert sorted(map(tuple, prefix_trie.trie(prefix_trie.strings(prefix_trie.turns(d)), range_bytes).collect()), key=str) == plain_trie(rows, False)


def test_trie_spreads_equal_conversations_and_takes_nothing(spark):
    rows = [(c, k, "user", f"turn {k}") for c in range(300) for k in range(4)]
    d = spark.createDataFrame([(*r, "k", 0) for r in rows], TALK)
    strings = prefix_trie.strings(prefix_trie.turns(d))
    got = prefix_trie.trie(strings, 4000)
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows, False)
    assert prefix_trie.prefix_trie(d.where("false")).count() == 0
    assert prefix_trie.prefix_trie(d.where("conv_id = 1")).count() == 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=5), st.integers(0, 9)), max_size=8), max_size=6))
def test_loser_tree_merges_runs_with_their_prefixes(runs):
    turn = lambda k: bytes([k]) * prefix_trie.TURN
    rows = [[(b"".join(map(turn, path)), c, b"") for path, c in run] for run in runs]
    got = list(prefix_trie.merged([prefix_trie.Run(r) for r in rows]))
    assert [r[:2] for _, r in got] == sorted(x[:2] for r in rows for x in r)
    assert all(n == prefix_trie.lcp(a[0], b[0]) for (_, a), (n, b) in zip(got, got[1:]))


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_features_are_hashed_as_their_bytes():
    import pyarrow as pa

    from millrace.llm.common import ALNUM, chunks

    texts = ["A b", None, "", "ÇOK güzel " * 40, "w" * 200 + " x " + "é" * 60, "x" * 48 + " " + "y" * 49 + " 7", "one"]
    for k, w in chunks(pa.array(texts), ALNUM, 64):
        of, bucket = importance.features(w)
        for r in range(w.rows):
            assert sorted(bucket[of == r].tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in plain_features(texts[k + r]))


def test_resampling_is_that_of_plain_counts_and_of_sql(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(vocabulary[: 10 + k % 50], int(rng.integers(0, 60)))) for k in range(120)] + [None, "", "short one", "Ç" * 5000 + " end " * 30]
    rows = [(k, t, "id", k) for k, t in enumerate(texts)] + [(5, texts[5], "id", 0), (5, texts[5], "id", 0), (None, texts[9], "id", 0), (None, texts[9], "id", 0)]
    wanted = [(1, " ".join(vocabulary[:12] * 4)), (2, None), (3, "")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string, id string, score long"), spark.createDataFrame(wanted, "item_id long, text string")
    got = sorted(map(tuple, importance.resample(d.repartition(5), b).collect()), key=str)
    raw, aim = collections.Counter(), collections.Counter()
    for _, t, *_ in rows:
        raw.update(zlib.crc32(f.encode()) % 10000 for f in plain_features(t))
    for _, t in wanted:
        aim.update(zlib.crc32(f.encode()) % 10000 for f in plain_features(t))
    s, t_ = sum(raw.values()), sum(aim.values())
    plain = []
    for doc, text, *_ in rows:
        f = [zlib.crc32(x.encode()) % 10000 for x in plain_features(text)]
        weight = sum(math.floor(1000 * math.log((aim[x] + 1) * (s + 10000) / ((raw[x] + 1) * (t_ + 10000)))) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        plain.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in plain if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = [(tuple(r), k + 1 if k < 25 * len(able) // 100 else None) for k, r in enumerate(able)] + [(tuple(r), None) for r in plain if r[1] < 39]
    assert got == sorted([(*r, k) for r, k in rank], key=str) and sum(r[4] is not None for r in got) > 10
    c = duckdb.connect()
    c.register("documents", d.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    c.register("benchmark", b.toPandas())
    assert sorted(c.sql(importance.OP12_SQL).fetchall(), key=str) == got
    assert importance.resample(d.where("false"), b).count() == 0 and importance.resample(d.where("doc_id = 1"), b.where("false")).count() == 1


def mix_rows():
    rng = np.random.default_rng(4)
    rows = [(k, ["b", "a", None, "é", "", "alone", "dry"][min(k % 23, 6)], "w " * int(rng.integers(0, 50))) for k in range(400)]
    rows = [(k, s, None if s == "dry" and k % 2 else "" if s == "dry" else t) for k, s, t in rows]
    return rows + [(1, "a", "x y z")] * 5 + [(None, "a", "one\ttwo\x0bthree")] * 3 + [(900, "huge", "word " * 20000), (901, "huge", "few words")]


def test_mix_meets_its_targets(spark):
    rows = mix_rows()
    d = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, source string, text string, size string, rate int").repartition(4)
    got = mixing.mixed(d).collect()
    again = mixing.mixed(d.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = collections.defaultdict(int)
    for _, s, t in rows:
        per[s] += words(t)
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(per.values())
    while True:  # the excess is shared out again until none is above
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * per[s]}
        if not over:
            break
        target |= {s: 2.0 * per[s] for s in over}
        left, open_ = left - sum(2 * per[s] for s in over), open_ - over
    target |= {s: level * weight[s] for s in open_}
    of = {}
    for k, s, t in rows:
        of.setdefault((k, words(t)), set()).add(s)
    taken, sizes = collections.Counter(), collections.defaultdict(list)
    for r in got:
        (s,) = of[r.doc_id, r.size]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2 and r.source_size == per[s] and math.isclose(r.target, target[s], rel_tol=1e-9)
        taken[s] += r.taken
        sizes[s].append((r.size, r.rate))
    for s in order:
        assert abs(taken[s] - target[s]) <= (1 if s != "huge" else 20000), s
        assert math.isclose(sum(n * x for n, x in sizes[s]), target[s], rel_tol=1e-6, abs_tol=0.01)
        # rates are exponentials in the size, cut off at 2: the logarithms of those below lie on a line through 0
        slopes = [math.log(x) / n for n, x in sizes[s] if n and x < 2]
        assert not slopes or max(slopes) - min(slopes) < 1e-6
    assert sum(taken.values()) > 0 and mixing.mixed(d.where("false")).count() == 0
    assert mixing.mixed(d.where("source = 'dry'")).agg(F.sum("taken")).first()[0] == 0


def test_mix_as_rows(spark):
    d = spark.createDataFrame([(k, f"s{k % 3}", "w " * (k % 9 + 1), k) for k in range(90)], "doc_id long, source string, text string, copies int")
    out = mixing.repeated(d)
    plan = {r.doc_id: r.copies for r in mixing.mixed(d).collect() if r.copies}
    assert out.columns == d.columns and dict(collections.Counter(r.doc_id for r in out.collect())) == plan
