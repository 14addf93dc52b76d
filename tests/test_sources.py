"""Document files with errors, batch and stream; bucketed tables; merged chains; items of damaged replies."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.functions import items
from millrace.operators import merging
from millrace.sources import tables


def test_broken_files_are_rows_with_their_error(spark, tmp_path):
    good = {"name": "A", "ingredient": "x", "pages": 2, "chunks": [{"chunk_id": "c1", "section": "4.2", "text": "metin"}]}
    files = {"a.json": json.dumps(good), "b.json": '{"name": "B", "chunks": [{', "c.json": " \n", "d.json": "[1, 2", "e.json": '{"pages": 3}', "f.txt": "no"}
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    got = {r.file.rpartition("/")[2]: r for r in tables.document_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.json", "b.json", "c.json", "d.json", "e.json"} and got["a.json"].error is None and got["a.json"].chunks[0].section == "4.2"
    assert got["b.json"].error.startswith("no JSON document: {") and got["c.json"].error == "empty file" and got["d.json"].error and got["e.json"].error == "no name" and got["e.json"].pages == 3


def test_a_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"name": "A"}')
    seen = []

    def run():
        q = tables.document_files(spark, str(tmp_path / "in"), stream=True).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: seen.extend((r["name"], r["error"]) for r in b.collect())).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    run()
    (tmp_path / "in" / "b.json").write_text("{broken")
    run()
    assert seen == [("A", None), ("", "no JSON document: {broken")]


def test_buckets_join_without_an_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = [f"t{uuid.uuid4().hex[:8]}" for _ in range(2)]
        for n in names:
            tables.write_bucketed(spark.range(1000).select("id", (F.col("id") * 2).alias(f"v_{n}")), n, "id", 4, str(tmp_path / n))
        joined = spark.table(names[0]).join(spark.table(names[1]), "id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 1000
        with pytest.raises(ValueError, match="not unique"):
            tables.write_bucketed(spark.createDataFrame([(1,), (1,)], "id long"), "never", "id", 2, str(tmp_path / "never"))
        with pytest.raises(ValueError, match="not unique"):
            tables.write_bucketed(spark.createDataFrame([(None,)], "id long"), "never", "id", 2, str(tmp_path / "never"))
        for n in names:
            spark.sql(f"drop table {n}")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chains_end_and_circles_stay(spark):
    chain = [(f"v{k}", f"v{k + 1}") for k in range(11)]
    m = spark.createDataFrame([*chain, ("a", "b"), ("b", "a"), ("to", "a"), ("x", "x"), ("two", "v3"), ("two", "zz")], "variant string, canonical string")
    assert {r.variant: r.canonical for r in merging.closed(m).collect()} == {f"v{k}": "v11" for k in range(11)} | {"two": "v11"}
    e = spark.createDataFrame([("v0", "q", 1), ("v5", "q", 1), ("v1", "v9", 1), ("a", "b", 1), (None, "v2", 1)], "src string, dst string, w int")
    assert sorted(map(tuple, merging.merged(e, m).collect()), key=str) == sorted([("v11", "q", 1), ("a", "b", 1)], key=str)
    assert merging.closed(m.where("false")).count() == 0


ONE, TWO = '{"drug": " A ", "severity": "Ciddi"}', '{"name": "B", "mechanism": "a \\" ] } b", "section": "4.4"}'


@pytest.mark.parametrize(
    "text, names",
    [(None, []), ("", []), ("no array", []), ("[]", []), (f"[{ONE}, {TWO}]", ["A", "B"]), (f"x ```json\n[{ONE},]\n``` y ]", ["A"]), (f"[{ONE}, {TWO}", ["A", "B"]), (f"[{ONE}, {TWO[:30]}", ["A"]), (f"[{ONE[:9]}", []), (f'[{ONE}, {{"severity": "hafif"}}]', ["A"]), ("[1, 2", []), (f"[[{ONE}]", [])],
)
def test_items_of_damaged_replies(spark, text, names):
    got = spark.createDataFrame([(text,)], "t string").select(items.items(F.col("t")).alias("i")).first().i
    assert [x["name"] for x in got] == names
    assert not got or (got[0].severity == "severe" and got[0].section == "4.5")
