"""Rows, blocks and broken input: short batches, repeated and null ids, several blocks, damaged files, whole pipelines."""

import collections
import gzip
import hashlib
import math
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm import cells, common, decontaminate, exact_dedup, line_dedup, lm_score, near_dedup, quality, sentence_pieces, sharding, warc

sys.path.insert(0, str(Path(__file__).parent.parent.parent))


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("text", [None, "", "z", "z y", "z y x", "z y x w", "z y x w v"])
def test_near_dedup_takes_a_short_text_alone(spark, text):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    assert rows_of(near_dedup.near_duplicates(d), "doc_id", "class_id", "class_size", "kept") == [(1, 1, 1, True)]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text], pa.string()), pa.array([0])], names=["id", "text", "row"])
    assert sum(b.num_rows for b in near_dedup.features(iter([batch]))) == 1


def test_rows_with_one_id_are_told_apart(spark):
    long_ = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long_, "a"), (1, long_, "b"), (1, long_ + " end", "c"), (None, "other text of its own here", "d"), (None, "other text of its own here", "e"), (2, "once", "f")]
    d = spark.createDataFrame(rows, "doc_id long, text string, row_number string")
    exact = exact_dedup.drop_exact_duplicates(d)
    assert exact.columns == d.columns and collections.Counter(r.text for r in exact.collect()) == {t: 1 for t in {r[1] for r in rows}}
    near = near_dedup.drop_near_duplicates(d)
    assert near.columns == d.columns and len({r.text[:30] for r in near.collect()}) == near.count() == 3


def test_hot_groups_give_the_rows_of_cold_ones(spark, monkeypatch):
    d = spark.createDataFrame([(k, "same" if k % 3 else f"t{k}") for k in range(60)], "doc_id long, text string")
    cold = rows_of(exact_dedup.exact_duplicates(d), "doc_id", "keep_id", "group_size", "kept")
    monkeypatch.setattr(exact_dedup, "HOT_COPIES", 2)
    assert rows_of(exact_dedup.exact_duplicates(d), "doc_id", "keep_id", "group_size", "kept") == cold
    assert rows_of(exact_dedup.exact_duplicates(d, broadcast_mb=0), "doc_id", "keep_id", "group_size", "kept") == cold


def test_decontamination_in_blocks_is_that_of_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(int(rng.integers(4, 30))))) for k in range(12)]
    docs = []
    for k in range(30):
        words = [f"d{k}x{j}" for j in range(int(rng.integers(5, 60)))]
        for _ in range(int(rng.integers(0, 4))):
            at, item = int(rng.integers(0, len(words))), items[int(rng.integers(0, 12))][1].split()
            words[at:at] = item[: int(rng.integers(1, len(item) + 1))]
        docs.append((None if k % 7 == 0 else k % 5, " ".join(words), k, 0))
    docs += [(1, None, 100, 0), (1, "", 101, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, row long, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    one = rows_of(decontaminate.contamination(d, bench), *columns)
    cut = {r.row: (r.text, r.n_chars) for r in decontaminate.decontaminated(d, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    assert rows_of(decontaminate.contamination(d, bench), *columns) == one and len(one) == 32 and any(r[2] for r in one)
    many = decontaminate.decontaminated(d, bench)
    assert {r.row: (r.text, r.n_chars) for r in many.collect()} == cut and many.columns == d.columns and 2 <= len(cut) < 32
    # plain version of the first look
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {tuple(w[j : j + min(10, len(w))]) for _, t in items for w in [words(t)] for j in range(max(len(w) - 9, 1))}
    hits = []
    for _, t, *_ in docs:
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
        hits.append((len(w), len(hit)))
    assert sorted(hits) == sorted((r[1], r[2]) for r in one)


def record(payload: bytes, **head) -> bytes:
    lines = {"WARC-Type": "resource", "Content-Length": str(len(payload))} | head
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n").encode() + payload + b"\r\n\r\n"


def test_warc_goes_on_after_damage(spark, tmp_path):
    a, b, c = record(b"one"), record(b"two", **{"Content-Length": "x"}), record(b"three")
    kinds = lambda data: [(r["record_type"], r.get("payload")) for r in warc.parse(data)]
    good = [("resource", "one"), ("damaged", None), ("resource", "three")]
    assert kinds(a + b + c) == good and kinds(a + b"garbage\nmore\n" + c) == good and kinds(b"") == []
    assert kinds(a + c[:-8]) == [("resource", "one"), ("damaged", None)]
    zipped = [gzip.compress(x) for x in (a, c)]
    assert kinds(b"".join(zipped)) == [good[0], good[2]] and kinds(zipped[0] + zipped[1][:-20])[0] == good[0]
    broken = zipped[0] + zipped[1][:15] + b"\0" * 9 + zipped[1]
    assert kinds(broken)[0] == good[0] and kinds(broken)[-1] == good[2]
    (tmp_path / "x.warc").write_bytes(a + b + c)
    (tmp_path / "y.warc.gz").write_bytes(zipped[0][:-9])
    assert warc.read_warc(spark, str(tmp_path)).where("record_type = 'resource'").count() >= 2


def test_warc_derivatives_of_nothing_and_of_null_ids(spark):
    pages = spark.createDataFrame([(None, None, None), (None, "u", "<p>x")], "page_id long, url string, html string")
    out = warc.derivatives(warc.responses_of(pages), "page_id")
    assert out.count() == 4 and out.where("record_id is null or refers_to is null").isEmpty()
    assert warc.derivatives(warc.responses_of(pages.where("false")), "page_id").count() == 0


def test_line_dedup_recall(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 9)))) for _ in range(100)]
    lines, near = [], []
    for k in range(300):
        words = [str(w) for w in rng.choice(vocabulary, int(rng.integers(10, 41)))]
        lines.append(" ".join(words))
        for at in rng.integers(0, len(words), 1 + k % 3):  # one to three words or letters, in places of their own
            words[at] = str(rng.choice(vocabulary)) if k % 2 else words[at][:1] + "q" + words[at][2:]
        near.append(" ".join(words))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    close = [k for k in range(300) if 0 < distance(lines[k], near[k]) <= 0.2 * max(len(lines[k]), len(near[k])) + 1e-9]
    d = spark.createDataFrame(list(enumerate([*lines, *near])), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.duplicate_lines(d).collect()}
    found = [k for k in close if got[k].group_id == got[300 + k].group_id]
    assert len(close) > 250 and len(found) >= 0.9 * len(close)
    assert sum(got[k].kept for k in range(300)) == 300  # unrelated lines stay


def test_line_dedup_of_crowded_blocks(spark):
    """Blocks of far over SMALL lines, of which pairs are alike and all begin (or begin and end) alike."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    head, end, lines, near = [word() for _ in range(16)], [word() for _ in range(3)], [], []
    for k in range(160):
        own = [word() for _ in range(10)]
        last = end if k % 2 else []
        lines.append(" ".join([*head, *own, *last]))
        near.append(" ".join([*head, *(w[:2] + "q" + w[3:] for w in own), *last]))
    lines += ["ab" * 40 + "c" * k for k in range(5)]  # few different pieces
    d = spark.createDataFrame(list(enumerate([*lines, *near])), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.duplicate_lines(d).collect()}
    assert all(got[k].group_id == got[165 + k].group_id for k in range(160))
    assert len({got[k].group_id for k in range(160)}) == 160 and len({got[k].group_id for k in range(160, 165)}) == 1
    assert all(got[k].kept and not got[165 + k].kept for k in range(160))


def test_line_dedup_writes_keys_of_several_nodes_only(spark, monkeypatch):
    """Most keys are of one node; tables of them, and blocks of the same nodes, took the disk. Crowded blocks give the same
    groups whether all their nodes are compared or those with a rare piece in common."""
    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    head, own = " ".join(word() for _ in range(16)), [[word() for _ in range(10)] for _ in range(20)]
    lines = [f"{head} {' '.join(w)}" for w in own] + [f"{head} {' '.join(x[:2] + 'q' + x[3:] for x in w)}" for w in own]
    lines += [" ".join(word() for _ in range(12)) for _ in range(40)]
    d, tables, cut = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), [], line_dedup.cut

    def watched(df):
        out = cut(df)
        if {"k", "node"} <= set(out.columns) and "piece" not in out.columns:
            tables.append(out.groupBy("k").agg(F.sort_array(F.collect_set("node")).alias("nodes")).collect())
        return out

    monkeypatch.setattr(line_dedup, "cut", watched)
    got = []
    for small in (2048, 8):
        monkeypatch.setattr(line_dedup, "SMALL", small)
        got.append({r.doc_id: (r.kept, r.group_id) for r in line_dedup.duplicate_lines(d).collect()})
    assert tables and all(len(r.nodes) > 1 for rows in tables for r in rows)
    shared = [[tuple(r.nodes) for r in rows] for rows in tables]
    assert any(len(rows) and len(set(rows)) == len(rows) for rows in shared)
    for of in got:
        assert [k for k in range(80) if not of[k][0]] == list(range(20, 40)) and all(of[k][1] == of[20 + k][1] for k in range(20))


def test_line_dedup_rows_and_names(spark):
    line = "a line that is long enough to be held against others here"
    d = spark.createDataFrame([(1, line, "x"), (1, line, "y"), (None, f"{line}\nown", "z"), (5, None, "n")], "doc_id long, text string, row_number string")
    out = line_dedup.without_duplicate_lines(d)
    assert out.columns == d.columns
    assert sorted((r.row_number, r.text) for r in out.collect() if r.row_number != "n")[2] == ("z", "own") and {r.text for r in out.where("row_number = 'n'").collect()} == {None}
    assert sorted(r.text for r in out.where("row_number in ('x', 'y')").collect()) == ["", line]


def test_shards_are_even_and_groups_whole(spark, tmp_path):
    rng = np.random.default_rng(2)
    texts = ["x" * int(n) for n in rng.integers(0, 400, 500)] + ["hot copy " * 20] * 400 + [f"pair {k // 2} " * 12 for k in range(200)] + [None, "y" * 3000]
    texts += [f"group {k % 4} " * 40 for k in range(24)]  # fills several ranges, but is smaller than the largest record
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.assign_shards(d, 10).collect()
    size, of = collections.Counter(), collections.defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        of[texts[r.doc_id]].add(r.shard)
    share, largest = sum(size.values()) / 10, 3008
    assert len(got) == len(texts) and all(abs(size[s] - share) <= largest for s in range(10))
    assert all(len(of[f"pair {k} " * 12]) == 1 for k in range(100)) and len(of["hot copy " * 20]) > 1
    assert all(len(of[f"group {k} " * 40]) == 1 for k in range(4)) and 6 * (len("group 0 " * 40) + 8) > 3 * sum(size.values()) / 500
    few = sharding.assign_shards(d.limit(3), 24).collect()
    assert len(few) == 3 and all(r.slot == 0 for r in few)
    sharding.write_shards(spark.createDataFrame([(1, "a", 5), (1, "b", 6), (None, None, 7)], "doc_id long, text string, row_number int"), str(tmp_path / "s"), 2)
    assert sorted(r.row_number for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [5, 6, 7]


def test_overfull_ranges_are_subdivided(spark):
    keyed = spark.range(4000).select(F.when(F.col("id") < 3000, F.col("id")).otherwise(10**6).alias("key"), F.when(F.col("id") % 100 == 0, 500).otherwise(10).cast("long").alias("size"), F.col("id").alias("row"))
    total, ranges = keyed.agg(F.sum("size")).first()[0], 20
    cuts = sharding.splitters(keyed, total, ranges)
    sizes = sharding.in_ranges(keyed, cuts).groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b <= sharding.OVERFULL * total / ranges or r.n == 1 for r in sizes)
    whole = sharding.in_ranges(keyed, sharding.splitters(keyed, total, ranges, total))  # no key is over the limit
    assert whole.groupBy("key").agg(F.countDistinct("range").alias("n")).where("n > 1").isEmpty()


def test_perplexity_is_that_of_plain_counts(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.6, 30) if x < 40) for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    model = quality.train(d)
    toks = [["<s>", *t.split(), "</s>"] for t in texts]
    counts = {n: collections.Counter(g for t in toks for g in zip(*[t[j:] for j in range(n)]) if n > 1 or g != ("<s>",)) for n in (1, 2, 3)}
    for n in (1, 2):  # how many words stand before an n-gram; raw counts where only the start does
        before = collections.Counter(g[1:] for g in counts[n + 1])
        counts[n] = {g: before.get(g, k) for g, k in counts[n].items()}
    cuts = {}
    for n, c in counts.items():
        t = [max(sum(k == j for k in c.values()), 1) for j in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1])
        cuts[n] = [0, *[min(max(j - (j + 1) * y * t[j] / t[j - 1], 0.05), j - 0.05) for j in (1, 2, 3)]]
    totals = {n: collections.Counter() for n in counts}
    left = {n: collections.Counter() for n in counts}
    for n, c in counts.items():
        for g, k in c.items():
            totals[n][g[:-1]] += k
            left[n][g[:-1]] += min(cuts[n][min(k, 3)], k)

    def p(g):
        n, h = len(g), g[:-1]
        lower = p(g[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        if not totals[n][h]:
            return lower
        k = counts[n].get(g, 0)
        return max(k - cuts[n][min(k, 3)], 0) / totals[n][h] + left[n][h] / totals[n][h] * lower

    for text in [texts[0], "w1 w2 never w3", ""]:
        (_, w), *_ = common.chunks(pa.array([text]), common.NONSPACE)
        _, got = model.score(w)
        t = ["<s>", *text.split(), "</s>"]
        want = sum(math.log10(p(tuple(t[max(0, j - 2) : j + 1]))) for j in range(1, len(t)))
        assert math.isclose(got[0], want, rel_tol=1e-5)


def test_cells_of_rows_in_order_are_small():
    rng = np.random.default_rng(5)
    for kind in (np.int64, np.uint64):
        rows = np.sort(rng.integers(0, 1 << 20, 1 << 18)).astype(kind) + kind(5 << 36)
        other = rng.integers(-(1 << 62), 1 << 62, 1 << 18)
        for column in (rows, other.view(kind), rows[:1], rows[:0]):
            got = cells.unpack(cells.pack([column, other[: len(column)]]))
            assert (got[0] == column).all() and got[0].dtype == kind and (got[1] == other[: len(column)]).all()
        assert len(cells.pack([rows])) < 0.5 * len(rows)  # a byte or more each before


def test_sums_of_several_shards_are_one_for_each_document(monkeypatch):
    monkeypatch.setattr(lm_score, "MERGED", 3000)
    sums, got, rng = lm_score.Sums(lm_score.Out(pa.int64()), 3), [], np.random.default_rng(6)
    want = np.zeros((1000, 3))
    for _ in range(8):  # shards, each with events of all documents
        row, values = rng.permutation(np.repeat(np.arange(1000), 2)), rng.integers(0, 9, (3, 2000))
        np.add.at(want, row, values.T)
        got += sums.add(row, *values)
    got += sums.flush()
    rows = [np.stack(cells.unpack(b.column(2)[0].as_py()), 1) for b in got]
    assert all((r[:, 0] % 3 == b.column(0)[0].as_py()).all() for r, b in zip(rows, got))
    rows = np.concatenate(rows)
    assert len(rows) == 1000 and (rows[np.argsort(rows[:, 0]), 1:] == want).all()


def test_lookup_finds_keys_in_little_memory():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 4097, 300_000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))  # even ones
        if n > 1:
            keys[0] = 0
        table, order = common.Lookup(keys), rng.permutation(len(keys))
        assert (table(keys[order]) == order).all() and (table(keys + np.uint64(1)) == -1).all()
        assert sum(x.nbytes for x in vars(table).values() if isinstance(x, np.ndarray)) <= 64 + 24 * len(keys)


def test_quality_takes_clashing_names_and_ties(spark):
    rows = [(k, "t " * (k % 3 + 1), "en", 1, 2) for k in range(9)] + [(None, None, None, 1, 2), (3, "x" * 50_000, "en", 1, 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, t_id int, t_held int")
    labels = d.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic")).distinct()
    judged = quality.judge_quality(d, labels)
    assert judged.count() == len(rows) and judged.where("text is null") is not None if "text" in judged.columns else True
    good = quality.good_documents(d, labels)
    assert good.columns == d.columns and good.where("text is null").isEmpty() and good.count() == judged.where("keep").count()


def test_pieces_of_hard_words(spark):
    m = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    texts = ["x" * 20_000, "    a   b", "\n\n\t", "a" * 49, "ab" * 100, "中文字符 😀😀", "=" * 47 + " " + "-" * 60, "the " * 50, None, "", "the " * 50, "▁▁a"]
    d = spark.createDataFrame([(k % 5, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, stretch string")
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in sentence_pieces.encode(d).collect())
    assert got == collections.Counter((k % 5, tuple(m.encode(t or ""))) for k, t in enumerate(texts))
    digests = sentence_pieces.encode(d, digest=True)
    assert digests.where("n_bytes > 0").count() > 0 and digests.where("not round_trip").count() == 1  # the one with the mark itself


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_pipeline_keeps_the_rows_of_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(4)
    good = [" ".join(f"w{x}" for x in rng.integers(0, 40, 60)) for _ in range(60)]
    item = " ".join(f"item{j}" for j in range(12))
    texts = [*good, good[0], good[1].replace(" ", "  ", 3), good[2] + " more", f"{good[3]} {item}", item, None, "", "zz " * 80]
    ids = [*range(60), 60, 61, 62, 63, 64, 65, 66, 67]
    ids[61] = 1  # an exact copy with the id of what it copies
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in zip(ids, texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        left[name] = [(r.doc_id, r.text) for r in docs.collect()]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    judged = quality.judge_quality(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert len(left["quality"]) == judged.where("keep").count() and all(t for _, t in left["quality"])
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    assert collections.Counter(plain(t) for _, t in left["exact_dedup"]) == {plain(t): 1 for _, t in left["quality"]}
    kept = {t for _, t in left["near_dedup"]}
    assert all((good[k] in kept) + (k == 2 and good[2] + " more" in kept) == 1 for k in range(60) if (k, good[k]) in left["exact_dedup"])
    assert not any(item in t for _, t in left["decontamination"]) and (64, item) not in left["decontamination"]
    end = corpus_pipeline.run(spark, str(tmp_path))
    assert end.count() == len(left["decontamination"]) and end.where("not round_trip").isEmpty()


def test_fold_takes_late_pieces_and_looks_at_others_once(spark):
    public = sentence_pieces.Pieces()
    assert public.late and all(set(p) == {sentence_pieces.SPACE} for p in public.late)
    odd = sentence_pieces.Pieces.__new__(sentence_pieces.Pieces)
    odd.rank, odd.longest = {"abc": 0, "bc": 1, "de": 2, "cde": 3, "aa": 4}, 3  # abc fits only when bc was taken, which is worse
    assert odd.late == {"abc"}
    for pieces, words in ((public, ["▁" * k + w for k in (0, 1, 2, 3, 5, 9, 17) for w in ("", "aaaa", "internationally", "zzqé")]), (odd, ["abc", "abcde", "bcde", "aaaaa", "aabcaa", "xyz", "dede"])):
        words = [w for w in words if w]
        got = {r.word: r.mask for r in sentence_pieces.segmented(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()}
        assert {w: [k for k in range(len(w) + 1) if m >> k & 1] for w, m in got.items()} == {w: pieces.cuts(w) for w in words}


def test_said_words_keep_bytes_and_marks(spark):
    p = sentence_pieces.Pieces()
    assert ";" not in sentence_pieces._said(p, "▁the", p.ids_of(["▁the"])).decode()
    ids = p.ids_of(["\U0001f9ff"])
    assert sentence_pieces._said(p, "\U0001f9ff", ids).decode() == ",".join(map(str, ids)) + f";{len(ids)};1"
    assert sentence_pieces._parts(sentence_pieces._strings(pa.array(["a", None, "", "né"])), pa.string()) == ["a", None, "", "né"]


def test_digests_are_the_library_s_with_spaces_anywhere(spark):
    m = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    texts = [None, "", " ", "a b c a b d", "a  b", " a b", "a b ", "b \U0001f9ff\U0001f9ff b \U0001f9ff", "x▁y z", "1. one\ntwo, (three) -- 4.5\tsix a b", "\U0001f9ff  \U0001f9ff"] * 3
    got = {r.doc_id: r for r in sentence_pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), digest=True).collect()}
    for k, t in enumerate(texts):
        ids = m.encode(t or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want = (len(ids), sum(map(m.is_byte, ids)), digest, "▁" not in (t or ""))
        assert (got[k].n_pieces, got[k].n_bytes, got[k].ids_sha256, got[k].round_trip) == want, t
