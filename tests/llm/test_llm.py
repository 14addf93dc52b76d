"""Operators against brute force on small fixtures: nulls, empty and long texts, repeated rows, clashing names."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, decontaminate, exact_dedup, line_dedup, lm_score, near_dedup, quality, sentence_pieces, sharding, url_filter, warc

BASE = " ".join(f"word{k % 37}x{k}" for k in range(120))
TEXTS = [None, "", "   ", "a b", "a\tb", "a  b", BASE, BASE, BASE.replace("x7 ", "y7 "), "a b", "é " * 5000, "x" * 20000, BASE + " end"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", k % 2, "m", "r") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[6]], "doc_id long, text string, lang string, n int, row string, key string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_lookup_finds_all_and_only():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    at = common.Lookup(keys)
    assert (at(keys) == np.arange(5000)).all() and (at(keys + np.uint64(1)) == -1).all() and (common.Lookup(keys[:0])(keys) == -1).all()


def test_words_are_those_of_the_pattern():
    text = "Äb-c12 D_e\n\0é"
    (_, w), *_ = common.chunks(pa.array([text]), common.ALNUM)
    assert [w.text(k) for k in range(len(w.start))] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({k: k + 32 for k in range(65, 91)}))
    assert [int(x) for x in w.hash] == [common.hash_word(w.text(k)) for k in range(len(w.start))]


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 1 and sum(r.kept for r in got) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in TEXTS})
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for k, t in enumerate(TEXTS):
        first.setdefault(norm(t), k)
    assert all(r.keep_id == first[norm(TEXTS[r.doc_id])] and r.text_sha256 == hashlib.sha256(norm(TEXTS[r.doc_id]).encode()).hexdigest() for r in got)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() == len(first)


def test_near_dedup(docs, empty):
    got = {(r.doc_id): r for r in near_dedup.near_duplicates(docs).collect()}
    assert got[8].class_id == got[6].class_id == got[7].class_id == got[12].class_id == 6
    assert got[3].class_id == got[9].class_id == got[4].class_id == 3 and got[0].class_id == 0 and got[11].class_id == 11
    assert sum(r.kept for r in near_dedup.near_duplicates(docs).collect()) == 7
    assert near_dedup.near_duplicates(empty).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    s = np.arange(300, dtype=np.uint64)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    row = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
    sig = near_dedup.signatures(row, np.r_[s[a > 0], s[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_decontamination(spark, docs, empty):
    words = BASE.split()
    bench = spark.createDataFrame([(1, " ".join(words[10:22])), (2, "b a"), (3, None), (4, " ".join(words[40:50]))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert (got[6].n_hit, got[6].n_items) == (22, 2) and got[6].items_sha256 == hashlib.sha256(b"1,4").hexdigest()
    assert not got[0].contaminated and not got[3].contaminated and got[10].n_words == 5000
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.count() == docs.count() and clean.schema == docs.schema and decontaminate.contamination(clean, bench).where("contaminated").isEmpty()
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(docs, bench.where("false")).where("contaminated").isEmpty()


def test_sharding(docs, empty):
    got = sharding.assign_shards(docs, 3).collect()
    assert all(r.size == len((TEXTS[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((TEXTS[r.doc_id] or "").encode()) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sharding.assign_shards(empty).count() == 0


def test_lm_base_score_and_mass(docs, empty):
    got = lm_score.score_documents(docs).collect()
    toks = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "\0"]
    c = collections.Counter(w for r in [*range(len(TEXTS)), 6] if zlib.crc32(str(r).encode()) % 10 for w in toks(TEXTS[r]))
    n, v = sum(c.values()), len(c)
    for r in got:
        assert r.train_tokens == n and r.n_known == sum(c[w] > 0 for w in toks(TEXTS[r.doc_id]))
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(TEXTS[r.doc_id])), rel_tol=1e-9)
    assert lm_score.score_documents(empty).count() == 0
    model, _ = lm_score.train(docs.select("doc_id", "text"))
    known = model.words != lm_score.START
    assert math.isclose((10 ** model.logp[known]).sum() + 10**model.unknown, 1, rel_tol=1e-6)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(k, 1, 0) for k in (6, 7, 8, 12)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge_quality(docs, labels).collect()}
    assert len(got) == len(TEXTS) and not got[0].keep and not got[1].keep and got[6].perplexity < got[11].perplexity
    assert quality.judge_quality(empty, labels).count() == 0
    assert quality.judge_quality(docs, labels.where("false")).where("keep").count() > 0


def test_line_dedup(spark, empty):
    line = "this is a rather long line with many common words in it number one of all lines that we have here today my dear friend"
    texts = ["\n".join([line, "short", "other words come here and then they go away"]), line.upper() + "\nshort", None, "", line + "!"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.line): r.kept for r in line_dedup.duplicate_lines(d).collect()}
    assert got == {(0, 0): True, (0, 1): True, (0, 2): True, (1, 0): False, (1, 1): True, (3, 0): True, (4, 0): False}
    assert {r.doc_id: r.text for r in line_dedup.without_duplicate_lines(d).collect()}[1] == "short"
    assert line_dedup.duplicate_lines(empty).count() == 0


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.COM/en/7x?q#f", "x://b.com/en/1", "x://net/de/8", "x://é.example.net/de/8/9", "a://h://x/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([], "id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, labels).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[4] == ("b.com", "/en/1", "com/en/", "block")
    assert got[5] == ("net", "/de/8", "net/de/", "block") and got[6][2:] == ("example.net/de/8", "allow") and got[7][:2] == ("h:", "//x/p")


def test_url_templates_reject_bad_ones(spark):
    rows = [(k, f"http://h.io/{'spam' if k % 2 else 'news'}/{k}", k % 2) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = url_filter.judge_urls(pages, pages.where("page_id < 40").select(F.col("page_id").alias("id"), "bad")).collect()
    assert {(r.page_id % 2, r.verdict) for r in got} == {(0, "allow"), (1, "block")}


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>x &amp; y<script>no</script><p>z"), (2, None, None)], "page_id long, url string, html string")
    out = warc.derivatives(warc.responses_of(pages), "page_id")
    rows = {(r.page_id, r.record_type): r for r in out.collect()}
    assert rows[1, "conversion"].block == "x & y\nz" and rows[2, "conversion"].block == ""
    assert rows[1, "metadata"].refers_to == rows[1, "conversion"].refers_to != rows[2, "metadata"].refers_to
    (tmp_path / "f.warc.gz").write_bytes(b"".join(bytes(r.record) for r in warc.warc_bytes(out.drop("page_id")).collect()))
    back = {(r.record_id): r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert len(back) == 4 and all(back[r.record_id].payload == r.block and back[r.record_id].refers_to == r.refers_to for r in rows.values())


def test_sentence_pieces_are_the_library_s(docs, empty):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    e = sentence_pieces.encode(docs)
    assert all(list(r.ids) == m.encode(TEXTS[r.doc_id] or "") for r in e.collect())
    assert all(r.text == (TEXTS[r.doc_id] or "") for r in sentence_pieces.decode(e).collect())
    assert sentence_pieces.encode(empty).count() == 0


def test_viterbi(spark):
    edges = spark.createDataFrame([("abc", 3, 0, 1, -1.0), ("abc", 3, 1, 2, -1.0), ("abc", 3, 2, 3, -1.0), ("abc", 3, 0, 2, -1.5), ("abc", 3, 1, 3, -1.2)], "word string, n int, s int, e int, score double")
    assert sentence_pieces.viterbi(edges).first().cuts == [0, 1, 3]


def test_near_dedup_finds_every_link_of_a_large_band(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    rng = np.random.default_rng(5)
    texts = []
    for k in range(90):  # many pairs lie on either side of 0.8
        words = [f"w{x}" for x in range(150)]
        for at in rng.integers(0, 150, int(rng.integers(1, 9))):
            words[at] = f"n{k % 20}x{at}"
        texts.append(" ".join(words))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    grams = [collections.Counter(tuple(t.split()[j : j + 5]) for j in range(146)) for t in texts]
    best = {k: k for k in got}
    for _ in texts:
        for a in got:
            for b in got:
                if (grams[a] & grams[b]).total() >= 0.8 * (grams[a] | grams[b]).total():
                    best[a] = best[b] = min(best[a], best[b])
        if all(best[a] == best[b] for a in got for b in got if (grams[a] & grams[b]).total() >= 0.8 * (grams[a] | grams[b]).total()):
            break
    assert got == best and len(set(best.values())) > 1


def test_prefix_join_loses_no_pair(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x if rng.random() > 0.03 else rng.integers(1000, 1040)}" for x in range(int(rng.integers(100, 130)))) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = near_dedup._multisets(pa.array(texts))
    near = {(a, b) for a in range(60) for b in range(a + 1, 60) if near_dedup.overlap(sets[a], sets[b]) >= 0.8}
    n = near_dedup.print_texts(iter([pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["id", "text"])]))
    rows = [x for batch in n for x in zip(*[batch.column(c).to_pylist() for c in range(3)])]
    nodes = spark.createDataFrame([(*x, k, k) for k, x in enumerate(rows)], "n long, f1 long, f2 long, node long, id long")
    many = nodes.select("node", F.col("node").alias("comp"), F.lit(True).alias("odd"))
    assert {(r.a, r.b) for r in near_dedup._prefix_joined(d, nodes, many).collect()} == near and near


def test_lm_score_keeps_rare_n_grams_at_any_size(spark):
    rng = np.random.default_rng(9)
    few = [" ".join(f"w{x}" for x in rng.integers(0, 12, int(rng.integers(0, 40)))) for _ in range(60)]
    texts = [*few, *["a " * 700_000] * 3, None, "never seen w1 w2", "once upon w3 w4"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    toks = [["<s>", *(t or "").split(), "</s>"] for t in texts]
    learnt = [t for k, t in enumerate(toks) if zlib.crc32(str(k).encode()) % 10]
    c1 = collections.Counter(w for t in learnt for w in t[1:])
    grams = {n: collections.Counter(g for t in learnt for g in zip(*[t[j:] for j in range(n)])) for n in (2, 3)}
    total, kinds = {n: collections.Counter() for n in grams}, {n: collections.Counter() for n in grams}
    for n, found in grams.items():
        for g, k in found.items():
            total[n][g[:-1]] += k
            kinds[n][g[:-1]] += 1
    size, ones, twos = c1.total(), sum(k == 1 for k in c1.values()), sum(k == 2 for k in c1.values())
    cut = min(0.95, max(0.05, ones / (ones + 2 * twos) if ones and twos else 0.5))

    def p(g):
        if len(g) == 1:
            return (c1[g[0]] - cut) / size if c1[g[0]] else cut * len(c1) / size
        n, h = len(g), g[:-1]
        return (max(grams[n][g] - lm_score.DISCOUNT, 0) + kinds[n][h] * lm_score.DISCOUNT * p(g[1:])) / total[n][h] if total[n][h] else p(g[1:])

    assert any(k == 1 for k in grams[3].values()) and size > 2e6
    for order in (2, 3):
        got = {r.doc_id: r.score for r in lm_score.score_documents(d, order=order).collect()}
        assert len(got) == len(texts)
        for k, t in enumerate(toks):
            n = collections.Counter(tuple(t[max(0, j - order + 1) : j + 1]) for j in range(1, len(t)))
            assert math.isclose(got[k], sum(m * math.log10(p(g)) for g, m in n.items()), rel_tol=1e-9)


def test_line_dedup_finds_lines_with_one_change(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(rng.choice(letters, int(rng.integers(3, 8))))
    lines = [" ".join(word() for _ in range(int(rng.integers(6, 30)))) for _ in range(200)]
    near = []
    for k, line in enumerate(lines):
        at, words = int(rng.integers(0, len(line))), line.split()
        if k % 4 == 0:
            near.append(f"{line[:at]}q{line[at + 1 :]}")  # also where a space was
        elif k % 4 == 1:
            near.append(line[:at] + line[at + 1 :])
        elif k % 4 == 2:
            near.append(f"{line[:at]}z{line[at:]}")
        else:
            words[int(rng.integers(0, len(words)))] = "new"
            near.append(" ".join(words))
    d = spark.createDataFrame([(k, t) for k, t in enumerate([*lines, *near])], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.duplicate_lines(d).collect()}
    n = len(lines)
    assert all(got[k].kept for k in range(n)) and [k for k in range(n) if got[n + k].kept or got[n + k].group_id != got[k].group_id] == []


def test_quality_limits_come_from_all_unseen_trusted_documents(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRUSTED", 100)
    rng = np.random.default_rng(6)
    rows = [(k, "xx" if k % 8 == 0 else "yy", " ".join(f"w{x}" for x in rng.integers(0, 50 if k % 8 else 90, 30))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = {r.doc_id: r for r in quality.judge_quality(docs, labels).collect()}
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id", F.lit(1))).limit(100).collect()]
    held = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 0).collect()}
    unseen = set(got) - (set(order) - held)
    for lang in ("xx", "yy"):
        mine = [got[k].perplexity for k in unseen if got[k].lang == lang]
        assert len(mine) >= quality.LEAST and len(got) == 400
        assert all(math.isclose(r.most, 1.5 * np.quantile(mine, 0.99), rel_tol=1e-9) for r in got.values() if r.lang == lang)


def test_line_dedup_takes_short_lines_and_lines_without_spaces(spark):
    rights, chinese = "All rights reserved.", "这是一个没有空格的很长的中文句子它在许多文件里都出现过"
    texts = [rights, "ALL RIGHTS  reserved", f"{rights}\nRead more", "read more!", chinese, chinese, chinese.replace("长", "短"), "Read moor", "", "---"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.line): r.kept for r in line_dedup.duplicate_lines(d).collect()}
    gone = {(1, 0), (2, 0), (3, 0), (5, 0), (6, 0)}
    assert len(got) == 11 and {k for k, kept in got.items() if not kept} == gone


def test_a_segment_of_one_nul_is_no_missing_segment(spark):
    urls = ["http://h.com/a", "http://h.com/a/\0", "http://h.com/en/7", "http://h.com/en/7/\0", "http://example.com/en/7", "http://example.com/en/7/\0"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge_urls(pages, spark.createDataFrame([], "id long, bad int")).orderBy("page_id").collect()
    assert [(r.page_id, r.rule, r.verdict) for r in got] == [(0, None, "allow"), (1, None, "allow"), (2, "com/en/", "block"), (3, "com/en/", "block"), (4, "example.com/en/7", "allow"), (5, "example.com/en/7", "allow")]
