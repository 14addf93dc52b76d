"""Rules that need no table: streams, seams, the engine, and edges of the column functions."""

import pytest
from pyspark.sql import functions as F

from millrace.engine import Engine, evaluated, verdict, with_sources
from millrace.functions import context, extraction, lab_text, patients, questions, sections
from millrace.operators import checks, closeness, graph, models, search
from millrace.plans import QUERIES
from millrace.sources import scratch
from millrace.streaming import sessions


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("name, value, wanted", [("ALT", 40, "normal"), ("ALT", 41, "yüksek"), ("ALT", 120, "kritik_yüksek"), ("K", 3.5, "kritik_düşük"), ("K", 5.5, "kritik_yüksek"), ("Na", 140, "normal"), ("X", 1, "bilinmiyor")])
def test_lab_limits(spark, name, value, wanted):
    assert one(spark, patients.lab_status(F.lit(name), F.lit(float(value)))) == wanted


@pytest.mark.parametrize("gfr, wanted", [(None, "bilinmiyor"), (90.0, "Evre 1"), (60.0, "Evre 2"), (45.0, "Evre 3a"), (30.0, "Evre 3b"), (15.0, "Evre 4"), (14.9, "Evre 5")])
def test_stages(spark, gfr, wanted):
    assert one(spark, patients.kidney_stage(F.lit(gfr).cast("double"))).startswith(wanted)


def test_matches_tell_their_places(spark):
    got = one(spark, extraction.matches(F.lit("ab12cd345"), "[0-9]+"))
    assert [(m.start, m.stop, m.text) for m in got] == [(2, 4, "12"), (6, 9, "345")] and one(spark, extraction.matches(F.lit("ab"), "[0-9]")) == []


def test_safe_phrases_and_nulls(spark):
    none = F.lit(None).cast("string")
    assert checks.SAFE_NOTICE in one(spark, checks.safe_phrases(F.lit("GÜVENLİDİR, endişe yoktur")))
    assert one(spark, checks.safe_phrases(none)) is None and one(spark, sections.table_markdown(F.array(F.array(F.lit("a"))))) is None


def test_close_names(spark):
    q = spark.createDataFrame([("a", "varfarin"), ("b", "xy"), ("c", "")], "q string, text string")
    n = spark.createDataFrame([("warfarin",), ("varfarine",), ("xy",), ("metformin",)], "name string")
    got = {(r.q, r["name"]) for r in closeness.close_names(q, n, 0.8, 5).collect()}
    assert got == {("a", "warfarin"), ("a", "varfarine"), ("b", "xy")}


def test_edges_merge_and_graph_repairs(spark):
    old = spark.createDataFrame([(1, 2, "unknown"), (1, 3, "mild")], "src int, dst int, severity string")
    new = spark.createDataFrame([(1, 2, "severe"), (1, 3, "severe"), (2, 3, "unknown")], "src int, dst int, severity string")
    rows = lambda d: {tuple(r) for r in d.collect()}
    assert rows(graph.merged_edges(old, new)) == {(1, 2, "severe"), (1, 3, "mild"), (2, 3, "unknown")}
    assert rows(graph.merged_edges(old, new, True)) == {(1, 2, "severe"), (1, 3, "severe"), (2, 3, "unknown")}


def test_rerank_falls_back_to_the_order(spark):
    found = spark.createDataFrame([(1, "a b", 10, "x", 1), (1, "a b", 11, "aa bb", 2)], "q int, query string, item int, text string, rank int")

    def broken(pairs):
        raise RuntimeError

    assert [r.item for r in models.reranked(found, broken).orderBy("rank").collect()] == [10, 11]
    assert [r.item for r in models.reranked(found, lambda p: [len(t) for _, t in p]).orderBy("rank").collect()] == [11, 10]


def test_retries_wait_and_give_up():
    slept, calls = [], []

    def call(prompt):
        calls.append(prompt)
        raise ValueError

    with pytest.raises(ValueError):
        models.with_retries(call, 0.0, 3, 2.0, slept.append)("x")
    assert len(calls) == 3 and [s for s in slept if s >= 1] == [1.0, 2.0]


def test_relaxed_search(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "z")], "q int, q_vec array<double>, asked string")
    corpus = spark.createDataFrame([(10, [1.0, 0.0], "a"), (11, [0.0, 1.0], "zz"), (12, [0.0, 1.0], "b")], "item int, vec array<double>, name string")
    assert {(r.q, r.item) for r in search.relaxed_search(queries, corpus, 2).collect()} == {(1, 10), (2, 11)}


def test_engine(spark, tmp_path):
    rows = [("A_4_2", "ASPIRIN", "4.2", "Günlük doz 100 mg olarak verilir. Devamı.", [1.0, 0.0]), ("A_4_3", "ASPIRIN", "4.3", "Ülser varlığında kontrendikedir.", [0.9, 0.1]), ("B_4_2", "BELOC", "4.2", "Doz 50 mg.", [0.0, 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, name string, section string, text string, vec array<double>")
    engine = Engine(spark, chunks)
    asked = spark.createDataFrame([(1, "aspirin günlük doz", [1.0, 0.0])], "q int, text string, vec array<double>")
    got = engine.search(asked).collect()
    assert got[0].item == "A_4_2" and engine.search(asked, names=["BELOC"]).count() <= 1
    answer = engine.answer(asked).first()
    assert "[ASPIRIN | Madde 4.2]" in answer.answer and "## KAYNAKLAR\n- ASPIRIN | Madde 4.2" in answer.answer
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "X_10_mg.json").write_text('{"name": "X", "chunks": [{"chunk_id": "c1", "section": "4.2", "text": "long enough to be kept here"}, {"chunk_id": "c2", "text": ""}]}')
    done = {r.status: r.n for r in engine.ingest(str(tmp_path / "in"), str(tmp_path / "t")).collect()}
    assert done == {"added": 1, "quarantined": 1} and {r.status: r.n for r in engine.ingest(str(tmp_path / "in"), str(tmp_path / "t")).collect()} == {"added": 0, "quarantined": 0}
    assert engine.quarantined(str(tmp_path / "t")).first()["name"] == "X" and engine.health().first().names == 2


def test_evaluation_bands(spark):
    d = spark.createDataFrame([(1, "q", "aa bb", ["aa bb cc"], "aa"), (2, "q", "zz", [], "aa")], "id int, question string, answer string, contexts array<string>, truth string")
    scored = {r.id: r for r in evaluated(d).collect()}
    assert scored[1].faithfulness == 1 and scored[1].recall == 1 and not scored[1].low and scored[2].low
    assert verdict(evaluated(d.where("id = 1"))).first().band == "good"
    assert one(spark, with_sources(F.lit("x\n\n## KAYNAKLAR\nold"), F.expr("array(struct('4.2' as section, 'A' as name, 't' as text))"))) == "x\n\n## KAYNAKLAR\n- A | Madde 4.2"


def test_session_stream(spark, tmp_path):
    schema = "session long, place long, value double, flag boolean"
    for k, rows in enumerate(([(1, 1, 5.0, False), (1, 2, None, True)], [(1, 3, 7.0, False), (2, 1, None, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    seen = []
    q = sessions.session_states(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: seen.extend(tuple(r) for r in b.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert (1, 7.0, True, 3) in seen or (1, 5.0, True, 3) in seen and any(s[0] == 2 and s[3] == 1 for s in seen)


def test_ingest_stream_adds_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    put = sessions.ingest(path, "id")
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    put(batch, 0)
    put(batch, 0)
    assert spark.read.parquet(path).count() == 2


def test_question_defaults(spark):
    assert one(spark, questions.question_kinds(F.lit("?"))) == ["genel"]
    assert one(spark, lab_text.text_values(F.lit(""))) == {}


def test_a_context_looks_for_each_pattern_once(spark):
    said = str(context.context(F.col("text")))
    assert [said.count(x) for x in ("öner(?:mek)?", "yaz[ıi]labilir", "|hipertansif|", "hemodiyaliz")] == [2, 1, 1, 1]  # the first one has two groups


@pytest.mark.parametrize("name", ["patient_context", "text_facts"])
def test_texts_of_one_small_file_are_dealt_over_all_cores(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["peer_edges", "propagate_group_edges", "group_propagation"])
def test_rows_of_groups_are_not_sent_after_they_met(spark, name):
    """Members times ends of their groups grow by the square: no exchange or sort may come after their join."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    top = plan.splitlines()
    first = next(k for k, x in enumerate(top) if "Join" in x)
    assert "LeftAnti" not in plan and not any("Aggregate" in x or "Sort " in x for x in top[:first])


def test_members_of_several_groups_and_rows_that_repeat(spark):
    members = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "a"), (3, "b"), (4, "b"), (5, "b"), (5, None)], "id long, group string")
    edges = spark.createDataFrame([(1, 10), (1, 10), (2, 11), (4, 10), (4, 12), (4, 5)], "src long, dst long")
    got = sorted((r.src, r.dst, r.peer) for r in graph.peers(edges, members).collect())
    assert got == [(1, 11, 2), (2, 10, 1), (3, 5, 4), (3, 10, 1), (3, 11, 2), (3, 12, 4), (5, 10, 4), (5, 12, 4)]
    spread = sorted((r.src, r.dst) for r in graph.propagated(edges, members).collect())
    assert spread == [(3, 4), (3, 5), (3, 10), (3, 11), (3, 12)]
    each = sorted((r.src, r.dst) for r in graph.lacking(edges, members.withColumnRenamed("id", "src")).collect())
    assert each == [(1, 11), (2, 10), (2, 10), (3, 5), (3, 10), (3, 10), (3, 11), (3, 12), (5, 5), (5, 10), (5, 12)]


def test_searches_of_plans_send_their_best_only(spark):
    plan = QUERIES["plan_fan_out"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 20, Partial" in plan


def test_paragraphs_and_headings_are_looked_for_once(spark):
    got = QUERIES["section_parts"](spark, "/root/testdata/sf0.001")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 7  # five headings, the special groups and the paragraphs
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["graph_edges", "one_hop_top", "shared_members", "edges_keep_known", "edges_latest_known"])
def test_groups_of_a_larger_table_are_more_than_the_shuffle_partitions(spark, monkeypatch, name):
    """A task's memory is that of a group, whose rows are bounded; every exchange of rows counts, not only the first."""
    few = sorted(QUERIES[name](spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(scratch, "GROUP", 4000)
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "ENSURE_REQUIREMENTS" not in plan
    assert sorted(got.collect()) == few
