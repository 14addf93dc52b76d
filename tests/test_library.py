import difflib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.plans import QUERIES, SQL
from millrace.sources import tables

SF = "/root/testdata/sf0.001"


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("given, wanted", [("Aspirin® ", "ASPIRIN"), ("  iğne   şurup ", "IGNE SURUP"), ("", ""), (None, ""), ("İLAÇ™", "ILAC")])
def test_normalized_name(spark, given, wanted):
    got = one(spark, X.normalized_name(F.lit(given).cast("string")))
    assert got == wanted
    assert one(spark, X.normalized_name(F.lit(got))) == wanted


def test_packed_keeps_all_in_order(spark):
    parts = ["a" * 1000, "b" * 1000, "c" * 500, "d" * 3000, "e"]
    got = one(spark, X.packed(F.array(*map(F.lit, parts)), 2200))
    assert "\n".join(got) == "\n".join(parts)
    assert [len(x) for x in got] == [2001, 500, 3000, 1]


def test_spaced(spark):
    assert one(spark, X.spaced(F.array(*map(F.lit, [1, 20, 60, 100, 115])), 50)) == [1, 60, 115]


def test_windows_reach_the_end(spark):
    got = one(spark, X.windows(F.lit("x" * 9000), 4000, 500))
    assert [(w.start, len(w.text)) for w in got] == [(0, 4000), (3500, 4000), (7000, 2000)]


def test_append_new(spark, tmp_path):
    rows = lambda *k: spark.createDataFrame([(i, "t") for i in k], "id long, t string")
    path = str(tmp_path / "t")
    assert tables.append_new(rows(1, 2, 2), path, "id") == 2
    assert tables.append_new(rows(2, 3), path, "id") == 1
    assert tables.append_new(rows(9), path, "id", reset=True) == 1


def test_read_documents_with_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "A",\n "chunks": [{"chunk_id": "c", "text": "t"}]}')
    (tmp_path / "b.json").write_text("{}")
    assert {r["name"] for r in tables.read_documents(spark, str(tmp_path)).collect()} == {"A", ""}
    assert tables.read_chunks(spark, str(tmp_path)).count() == 1


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", ["hybrid_search", "quality_gate", "tiered_resolve", "session_merge", "enzyme_conflict", "page_asof", "upsert_merge"])
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(tuple(flat(r[n]) for n in names) for r in df.collect()) == sorted(tuple(map(flat, r)) for r in cur.fetchall())


def test_fuzzy_match_compares_with_all_names(spark, tmp_path):
    names = ["abcd", "abhcd", "red bolt", "red bolts", "rehd bolt", "x", "zz top", "new widget", None]
    spark.createDataFrame([(k, n) for k, n in enumerate(names)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["q"]: r["name"] for r in QUERIES["fuzzy_match"](spark, str(tmp_path)).collect()}
    known = [n for n in names if n]
    wanted = {q: next(iter(difflib.get_close_matches(q, known, 1, 0.8)), None) for q in (f"{n[:2]}h{n[2:]}" for n in known)}
    assert got == wanted and got["abhcd"] == "abhcd" and got["xh"] is None
