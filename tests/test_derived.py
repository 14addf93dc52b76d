"""Queries on texts made of table rows meet every literal text that their rules are tested on, and give the rows of their SQL."""

from pathlib import Path

import duckdb

from millrace.plans import QUERIES, SQL

SF = "/root/testdata/sf0.01"


def both(spark, name):
    """Rows of the query, after they were held against those of its SQL."""
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    rows = QUERIES[name](spark, SF).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(con.execute(SQL[name]).fetchall(), key=repr)
    return rows


def test_plans_are_made_for_all_kinds_and_profiles(spark):
    rows = both(spark, "question_plans")
    assert {k for r in rows for k in r.kinds.split(",")} == {"etkilesim", "kontrendikasyon", "doz", "gebelik_laktasyon", "yan_etki", "uyari", "doz_asimi", "genel"}
    for said in ("Child-Pugh C", "gebelik hamile", "laktasyon emzirme", "ilaç etkileşimi ASPIRIN", "hemoraji", "atriyal", "hepatotoksisite", "kreatinin yüksek", "glisemik", "potasyum düşük"):
        assert any(said in r.query for r in rows), said


def test_patients_have_all_kinds_of_context(spark):
    rows = both(spark, "patient_context")
    seen = {(r.target, r.current, r.diagnoses, r.allergies, r.child_pugh) for r in rows}
    assert seen == {("klaritromisin", "Varfarin", "", "", None), ("ramipril eklemek", "", "Hipertansiyon", "penisilin", None), (None, "metformin,aspirin,insülin", "", "", "B"), (None, "", "", "", None)}


def test_customers_have_all_kinds_of_facts(spark):
    rows = both(spark, "text_facts")
    assert {r.mentions for r in rows} == {"", "Varfarin", "Digoksin inhibitör"}
    assert {r.ingredients for r in rows} == {"asetilsalisilik", "suksinat; metoprolol", "klopidogrel", None, "parasetamol; klorfeniramin"}
    assert {r.roles for r in rows} == {"", "CYP3A4 substrate", "CYP2D6 inhibitor", "CYP3A4 inhibitor"} and any(r.doses.endswith("; < 45.0 60.0 dose_reduction") for r in rows)
