"""Label texts: headings in all forms, the fold that keeps them apart, chunks, names, warning blocks; engine scores."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.engine import Engine
from millrace.functions import labels
from millrace.plans import QUERIES, SQL


def plain_sections(text):
    """Headings by pattern, then place; each at least 50 characters from those taken; of a number the first."""
    taken = []
    for k, pattern in enumerate(labels.HEADINGS):
        for m in re.finditer(pattern, text, re.M):
            at = m.start()
            if any(abs(at - x[0]) < 50 for x in taken):
                continue
            no, raw = m[1].replace(",", "."), m[2].strip() if k != labels.UNTITLED else ""
            line = text[max(0, at - 60) : at + 5].rpartition("\n")[2]
            if re.search(rf"(bkz|bakınız|see|Bölüm|Madde|Section)\s*\.?\s*{re.escape(no)}([^0-9]|$)", line, re.I):
                continue
            if (not raw and no not in labels.TITLES) or (raw and (len(raw) < 5 or raw.isdigit() or ")" in raw)):
                continue
            taken.append((at, no, labels.TITLES.get(no, raw), raw))
    out, seen = [], set()
    for x in sorted(taken):
        if x[1] not in seen:
            seen.add(x[1])
            out.append(x)
    return out


FORMS = ["4.{n} Başlık burada", "4.{n}. \n Çok uzun başlık", "   4.{n}.", "| 4.{n} Tablo içinde başlık |", "4,{n} Yanlış okunan", "5. Farmakolojik yapı", "6.\nFarmasötik yapı", "| 7. Ruhsat sahibi |", "bkz. 4.{n} Başlık", "4.{n} Kapalı (parantez)", "4.{n} küçük harf", "4.{n}.2 Alt bölüm adı", "4.{n}.3.", "10. Abcd"]


def test_sections_are_those_of_the_plain_fold(spark):
    r = random.Random(11)
    texts = [None, "", "4.3 Kontrendikasyonlar", "4.3 Kontrendikasyonlar\n4.3. \nTekrar eden başlık\n" + "x" * 60 + "\n4.4 Özel kullanım uyarıları"]
    for _ in range(150):
        lines = []
        for _ in range(r.randrange(1, 14)):
            lines.append(r.choice(FORMS).replace("{n}", str(r.randrange(1, 10))))
            lines.append("metin " * r.randrange(0, 14))
        texts.append(r.choice(["\n", "\n\n"]).join(lines))
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {row.id: [tuple(s) for s in row.s] for row in d.select("id", labels.sections(F.col("text")).alias("s")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == plain_sections(t or ""), t
    assert sum(len(x) for x in got.values()) > 200


def test_a_label_becomes_chunks(spark):
    text = "KISA ÜRÜN BİLGİSİ\n▼ Bu ilaç ek izlemeye tabidir, dikkat.\n1. BEŞERİ TIBBİ ÜRÜNÜN ADI\n\nÖrnek® 5 mg tablet\n2. KALİTATİF VE KANTİTATİF BİLEŞİM\nEtkin madde: metoprolol....... süksinat\nYardımcı maddeler: laktoz\n4.3 Kontrendikasyonlar\nAşırı duyarlılıkta verilmez.\n2/17\nBelge Doğrulama Kodu: ABC123\n4.4. \nÖzel kullanım uyarıları\nBöbrek   yetmezliğinde\n\n\n\ndikkatli olunmalıdır.\n5. Farmakolojik özellikler\nkısa"
    d = spark.createDataFrame([(text, "ornek_5.pdf", [0, 60, 250]), (None, "bos_dosya.pdf", [0]), ("çok kısa", "x.pdf", [])], "text string, file string, pages array<int>")
    rows = labels.parsed(d, pages="pages").orderBy("file").collect()
    assert [r.name for r in rows] == ["BOS DOSYA", "ORNEK 5 MG TABLET", "X"] and rows[1].ingredient == "metoprolol süksinat" and not rows[0].chunks and not rows[2].chunks
    chunks = {c.section: c for c in rows[1].chunks}
    assert list(chunks) == ["ozel_uyari", "4.3", "4.4", "5"] and chunks["ozel_uyari"].risk == "critical" and chunks["ozel_uyari"].chunk_id.startswith("ORNEK_5_MG_TABLET_ozel_uyari_")
    assert chunks["4.3"].text.endswith("Aşırı duyarlılıkta verilmez.") and "ABC123" not in chunks["4.3"].text and "2/17" not in chunks["4.3"].text
    assert chunks["4.4"].text.count("\n\n") == 1 and chunks["4.4"].priority == "critical" and chunks["5"].priority == "normal" and chunks["4.4"].page == 3


def chunks_of(spark):
    rows = [("A_4_2_x", "ASPIRIN", "4.2", "dose words here", [1.0, 0.0], ["renal"]), ("A_4_2_part1_x", "ASPIRIN", "4.2", "other text", [0.95, 0.0], []), ("B_4_2_x", "BELOC", "4.2", "dose words again", [0.98, 0.0], []), ("B_4_3_x", "BELOC", "4.3", "nothing", [0.6, 0.0], []), ("C_4_8_x", "CIPRO", "4.8", "rare keyword", [0.2, 0.0], [])]
    return spark.createDataFrame(rows, "chunk_id string, name string, section string, text string, vec array<double>, flags array<string>")


def test_engine_floor_boost_and_flags(spark):
    engine = Engine(spark, chunks_of(spark))
    asked = spark.createDataFrame([(1, "rare keyword", [1.0, 0.0])], "q int, text string, vec array<double>")
    order = lambda **how: [r.item for r in engine.search(asked, **how).orderBy("rank").collect()]
    # a chunk found by its words only is under the floor; the lexical reranker then orders the pool
    assert "C_4_8_x" not in order() and len(order()) == 4
    # without one of the flags only critical sections stay
    assert set(order(flags=["renal"])) == {"A_4_2_x", "B_4_3_x"}
    by_score = Engine(spark, chunks_of(spark), score=lambda pairs: [0.0] * len(pairs))
    ranked = [r.item for r in by_score.search(asked, names=["ASPIRIN", "BELOC"]).orderBy("rank").collect()]
    assert ranked[:2] == ["A_4_2_x", "B_4_2_x"]


def test_plans_in_one_scan(spark):
    engine = Engine(spark, chunks_of(spark), score=lambda pairs: [0.0] * len(pairs))
    plans = [(1, 0, "dose", [1.0, 0.0], "ASPIRIN", ["4.2", "4.3"], ["renal"], ["doz"]), (1, 1, "dose", [1.0, 0.0], "BELOC", ["4.2", "4.3", "4.8"], ["renal"], ["doz"]), (2, 0, "x", [1.0, 0.0], None, ["4.8", "4.1", "4.2"], [], ["genel"])]
    d = spark.createDataFrame(plans, "q int, plan int, text string, vec array<double>, name string, sections array<string>, flags array<string>, kinds array<string>")
    got = {}
    for r in engine.retrieve(d).orderBy("rank").collect():
        got.setdefault(r.q, []).append(r.item)
    assert got == {1: ["A_4_2_x", "B_4_3_x"], 2: ["A_4_2_x", "B_4_2_x", "A_4_2_part1_x"]}
    assert engine.retrieve(d.where("false")).count() == 0


@pytest.mark.parametrize("name", ["label_sections", "label_chunks"])
def test_headings_of_any_first_letter_are_those_of_the_sql(spark, tmp_path, name):
    body = "tige Wirkungen und mehr Worte"
    rows = [(8 * j + k, "<h1>Titel</h1>" + "".join(f"<p>{x}{body}</p>" for x in first)) for j, first in enumerate(["ßßßßß", "ŉŉŉŉŉ", "ᾳᾳᾳᾳᾳ", "üßaẞé"]) for k in range(8)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, str(tmp_path)).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
