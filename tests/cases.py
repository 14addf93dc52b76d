"""Rules on literal rows; the rows that they call for are in expected_rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import context as C
from millrace.functions import extraction as E
from millrace.functions import lab_text as L
from millrace.functions import patients as P
from millrace.functions import questions as Q
from millrace.functions import sections as S
from millrace.operators import checks as K
from millrace.operators import resolve as R

CHUNK = "array<struct<section:string,name:string,text:string>>"


CASES = {}


def case(name: str):
    """A function of something with a session as its spark; its rows have to be those of expected_rows."""

    def put(f):
        CASES[name] = f
        return f

    return put


def _id(c="id"):
    return F.col(c).cast("long").alias("id")


END = "\n\n## KAYNAKLAR\n- TEST"
ANSWERS = [
    (1, f"## SONUÇ\n\nBaşlangıç dozu 7.5 mg verilmelidir.{END}", "bu ilacın dozu ne?", [("4.2", "TEST ILAC", "Başlangıç dozu 2.5 mg veya 5 mg olarak ayarlanabilir.")]),
    (2, f"## SONUÇ\n\nBaşlangıç dozu 2.5 mg verilmelidir.{END}", "bu ilacın dozu ne?", [("4.2", "TEST ILAC", "Başlangıç dozu 2.5 mg olarak belirlenir.")]),
    (3, f"## SONUÇ\n\nBaşlangıç dozu 2.5 mg önerilir. [TEST ILAC | Madde 4.2 — Geriyatrik]{END}", "yaşlı hastada doz?", [("4.2", "TEST ILAC", "Doz, yaşlı hastanın böbrek fonksiyonuna uygun olmalıdır.")]),
    (4, f"## SONUÇ\n\nBaşlangıç dozu 5 mg önerilir. [TEST ILAC | Madde 4.2 — Pozoloji]{END}", "dozaj nedir?", [("4.2", "TEST ILAC", "Hipertansiyon tedavisinde başlangıç dozu genellikle 5 mg'dir.")]),
    (5, f"## SONUÇ\n\nBu hastanın GFR değeri 55 mL/dak olduğundan doz azaltımı gereklidir. [TEST ILAC | Madde 4.4 — Böbrek]{END}", "GFR=55 olan hastada doz?", [("4.4", "TEST ILAC", "Böbrek fonksiyon bozukluğu olan hastalarda doz ayarı gereklidir.")]),
    (6, f"## SONUÇ\n\nGFR < 15 mL/dak altında kullanım kontrendikedir.{END}", "bu ilacın kontrendikasyonu nedir?", [("4.3", "TEST ILAC", "Şiddetli böbrek yetmezliğinde (kreatinin klerensi < 30 mL/dak) dikkatli kullanılmalıdır.")]),
    (7, "Bu ilaç hamile kadınlarda güvenlidir.", "gebe kadında kullanılabilir mi?", [("4.6", "TEST ILAC", "Gebe kadınlarda dikkatli kullanılmalı.")]),
    (8, f"## SONUÇ\n\nBu ilaç renal hastalarda kontrendikedir.{END}", "renal hastada kullanılabilir mi?", [("4.4", "TEST ILAC", "Böbrek fonksiyon bozukluğunda dikkatli kullanılmalıdır.")]),
    (9, f"## SONUÇ\n\nBu ilaç hamilelerde kontrendikedir. [TEST ILAC | Madde 4.3]{END}", "gebe hastada kullanılabilir mi?", [("4.3", "TEST ILAC", "Gebelik döneminde kullanımı kontrendikedir. Fetal toksisite riski mevcuttur.")]),
    (10, f"## SONUÇ\n\nBu ilaç CYP3A4 inhibitörüdür; varfarin düzeyi azalır. [CYP450]{END}", "etkileşim var mı?", [("4.5", "TEST ILAC", "Bu ilaç CYP3A4 enziminin güçlü inhibitörüdür. Eş zamanlı kullanım plazma düzeyini etkiler.")]),
    (11, f"## SONUÇ\n\nBu ilaç CYP3A4 inhibitörüdür; varfarin düzeyi artar. [CYP450]{END}", "etkileşim var mı?", [("4.5", "TEST ILAC", "Bu ilaç CYP3A4 enziminin güçlü inhibitörüdür.")]),
    (12, f"## SONUÇ\n\nBu ilaç CYP3A4 indükleyicisidir; digoksin düzeyi artar. [CYP450]{END}", "etkileşim var mı?", [("4.5", "TEST ILAC", "Rifampisin güçlü bir CYP3A4 indükleyicisidir.")]),
    (13, f"## SONUÇ\n\nBu ilaç böbrek yetmezliğinde kontrendikedir.{END}", "GFR=20 olan hastada kullanılabilir mi?", [("4.4", "TEST ILAC", "Böbrek fonksiyon bozukluğunda dikkatli kullanılmalı, doz azaltılmalıdır.")]),
    (14, f"## SONUÇ\n\nBaşlangıç dozu 10 mg önerilir. [TEST ILAC | Madde 4.2]{END}", "dozaj nedir?", [("4.4", "TEST ILAC", "Böbrek fonksiyonu takip edilmeli.")]),
    (15, "## SONUÇ\nBu kombinasyon genel olarak önerilmez ve kullanılmamalı [TEST ILAC | Madde 4.4]\n\n## UYARI\nTEST ilacı böbrek hastalarında 900 mg ile zararsızdır demek doğru olmaz.", "diyabet hastasında?", [("4.4", "TEST ILAC", "Kan şekeri izlenmelidir."), ("4.3", "TEST ILAC", "Aşırı duyarlılıkta verilmemelidir.")]),
    (16, None, None, None),
    (17, "Kısa cevap.", None, None),
]


@case("answer_checks")
def answer_checks(t):
    """All seven checks, one after the other."""
    d = K.checked(t.spark.createDataFrame(ANSWERS, f"id int, answer string, question string, chunks {CHUNK}"))
    return d.select(_id(), "answer", *[F.col(f"format.{c}") for c in ("has_conclusion", "cited", "quoted", "judged", "poor")], F.col("format.unverified").cast("long").alias("unverified"))


@case("verdict_levels")
def verdict_levels(t):
    """The level that an answer's conclusion claims, and the one that its sections support."""
    d = t.spark.createDataFrame(ANSWERS, f"id int, answer string, question string, chunks {CHUNK}").where("chunks is not null")
    first, level, supported = K.verdict_levels(F.col("answer"), F.col("question"), F.col("chunks"))
    return d.select(_id(), first.alias("first"), level.cast("long").alias("level"), supported.cast("long").alias("supported"))


PROFILES = [
    (1, (70, "erkek", 80.0, 25.0, "B", ["ASPIRIN"], [], ["Diyabet"], None, None, {"ALT": 130.0, "K": 5.6, "X": 1.0}, "not", None, None)),
    (2, (30, "kadın", None, None, None, [], ["penisilin"], [], True, False, {"Kreatinin": 1.5, "Na": 130.0, "INR": 2.4}, None, None, None)),
    (3, (17, None, None, 60.0, "A", None, None, None, False, True, {"Trombosit": 50.0, "Hemoglobin": 8.1, "GGT": 61.0, "ALP": 360.0}, "", None, None)),
    (4, (None, None, None, 14.9, "C", None, None, None, None, None, None, None, False, True)),
    (5, (65, "erkek", None, 90.0, None, None, None, None, None, None, {"HbA1c": 9.0, "Bilirubin": 1.9, "AST": 40.0}, None, None, None)),
]
RENAL_CHUNKS = [("4.2", "A", "Kreatinin klerensi düşükse doz azaltılır."), ("4.4", "A", "Siroz ve yaşlı hastalar.")]


def _profiles(t):
    return t.spark.createDataFrame(PROFILES, f"id int, p {P.PROFILE}")


@case("patient_profiles")
def patient_profiles(t):
    """Stage, flags, abnormal values and summary of profiles."""
    p = F.col("p")
    labs = F.array_join(F.transform(P.abnormal_labs(p["labs"]), lambda r: F.concat_ws(":", r["name"], r["status"])), ",")
    return _profiles(t).select(_id(), P.kidney_stage(p["gfr"]).alias("stage"), F.array_join(F.array_sort(P.active_flags(p)), ",").alias("flags"), F.array_join(F.array_sort(F.split(labs, ",")), ",").alias("labs"), F.size(F.split(P.summary(p), "\n")).cast("long").alias("lines"))


@case("profile_summaries")
def profile_summaries(t):
    """The summary of a profile beside chunks: no stress on what they have nothing about."""
    chunks = F.expr(f"cast(array({', '.join(repr_struct(c) for c in RENAL_CHUNKS)}) as {CHUNK})")
    p = F.struct(*[(F.lit(None).cast("map<string,double>") if f == "labs" else F.col("p")[f]).alias(f) for f in _profiles(t).schema["p"].dataType.names])
    return _profiles(t).withColumn("p", p).select(_id(), P.summary_for(F.col("p"), chunks).alias("summary"))


def repr_struct(c: tuple) -> str:
    return "struct(" + ", ".join("'" + x.replace("'", "''") + "'" for x in c) + ")"


QUESTIONS = [
    (1, "Parol ile aspirin birlikte kullanılabilir mi?"),
    (2, "KBY hastasında doz ayarı gerekir mi?"),
    (3, "Gebelikte kullanım hakkında bilgi"),
    (4, "Bu ilaç hangi firmanın?"),
    (5, "Miyastenia gravis hastasında risk var mı?"),
    (6, "Doz aşımı durumunda ne yapılır, zehirlenme belirtileri?"),
    (7, "kanama riski yan etki olarak görülür mü"),
    (8, "AF ve KAH öyküsü olan hastada etkileşim?"),
]


@case("question_plans")
def question_plans(t):
    """Kinds, sections, flags and the enriched query of questions beside a profile each."""
    p = _profiles(t).select(F.col("id").alias("k"), F.col("p").alias("profile"))
    q = t.spark.createDataFrame(QUESTIONS, "id int, question string").withColumn("k", F.col("id") % 5 + 1).join(p, "k").withColumn("targets", F.when(F.col("id") % 2 == 0, F.array(F.lit("A"), F.lit("B"))))
    d = Q.search_plans(q)
    return d.select(_id(), "name", F.array_join("kinds", ",").alias("kinds"), F.array_join("sections", ",").alias("sections"), "query", F.col("n_results").cast("long").alias("n_results"))


REPORTS = [
    (1, "T.C. Sağlık Bakanlığı\nAlanin aminotransferaz (ALT)    45,5  U/L\nHGB   13.2 g/dL\nPotasyum (K)  12\n25.06.2025  11\nPLT    250\nÜre   31\nHGB   14"),
    (2, None),
    (3, ""),
    (4, "Kreatinin  0.05\nNa  140 mmol\nSayfa 1   2\ntek boşluk 5"),
]


@case("report_values")
def report_values(t):
    """Values of table rows, and those that profiles know."""
    return L.report_values(t.spark.createDataFrame(REPORTS, "id int, text string"), "id", "text").select(_id(), "name", "value", "profile")


LAB_TEXTS = [
    (1, "ALT: 45\nAST 30 U/L\nKreatinin\n1,2 mg/dL\nSodyum : 140"),
    (2, "Tarih 2025\nHemoglobin A1c 7.5\nHb 13,4\nPLT 250\neGFR > 90"),
    (3, "K 4.1\nPotasyum 99\nINR\n\n2.5"),
    (4, "hiçbir şey yok"),
]


@case("lab_texts")
def lab_texts(t):
    """Values beside or below their names in plain text."""
    d = t.spark.createDataFrame(LAB_TEXTS, "id int, text string").select(_id(), F.explode(L.text_values(F.col("text"))).alias("name", "value"))
    return d.select("id", "name", "value")


CONTEXTS = [
    (1, "72 yaşında erkek hasta, 80 kg, GFR 45, ALT: 60. Varfarin kullanıyor. Hastaya klaritromisin yazabilir miyim?"),
    (2, "Gebe kadın hasta, penisilin alerjisi var. Hipertansiyon için ramipril eklemek istiyorum."),
    (3, "12 yaş çocuk hasta Child-Pugh b siroz. Mevcut ilaçları: metformin, aspirin ve insülin."),
    (4, "yaşı bilinmiyor"),
]


@case("patient_context")
def patient_context(t):
    """What a free text says of a patient."""
    d = t.spark.createDataFrame(CONTEXTS, "id int, text string").select("id", C.context(F.col("text")).alias("c")).select("id", "c.*")
    join = lambda c: F.array_join(c, ",").alias(c)
    return d.select(
        _id(), F.col("age").cast("long").alias("age"), "sex", "weight", "gfr", "renal", "hepatic", "child_pugh", "pregnant", "nursing", "pediatric", "geriatric",
        F.array_join(F.array_sort(F.map_keys("labs")), ",").alias("labs"), join("diagnoses"), join("allergies"), "target", join("current"), "question",
    )


DRUGS = [("COUMADIN 5 MG TABLET",), ("KLACID 500 MG",), ("ASPIRIN 100 MG",), ("BELOC ZOK 50 MG",)]
ASKED = [(1, "Hasta Coumadin kullanıyor, aspirin yazabilir miyim?"), (2, "klacid ile ne olur, coumadin alan hasta"), (3, "başka bir şey"), (4, "coumadin hakkında bilgi")]


@case("names_in_texts")
def names_in_texts(t):
    """Names of a list in texts, and which of them the text asks about."""
    got = C.names_in_text(t.spark.createDataFrame(ASKED, "id int, text string"), t.spark.createDataFrame(DRUGS, "name string"), "id", "text")
    return got.select(_id(), "name", F.col("at").cast("long").alias("place"), "target")


FACTS = [
    (1, "ASPIRIN 100 MG", "Varfarin ile birlikte kullanılmamalıdır. GFR < 30 mL/dak ise kontrendikedir. Aktif peptik ülseri olan hastalarda. CYP3A4 ile metabolize olur.", "asetilsalisilik asit 100 mg"),
    (2, "BELOC", "Kreatinin klerensi 30-60 arasında doz azaltılmalıdır; GFR 45 ila <60. CYP2D6 inhibitörü. Gebelik kategorisi: C", "metoprolole eşdeğer metoprolol suksinat"),
    (3, "X", "Gebelikte kullanılmamalıdır. Klinik önemi sınırlı.", "klopidogrele eşdeğer klopidogrel hidrojen sülfat"),
    (4, "Y", "", None),
    (5, "Z", "Rifampisin indükleyici etki gösterir, CYP 3A4 indükler. Digoksin inhibitör birlikte. Böbrek  yetmezliği ve astım; BÖBREK YETMEZLİĞİ.", "Parasetamol 500 mg Klorfeniramin maleat"),
]


@case("text_facts")
def text_facts(t):
    """Severity, conditions, mentions, dose limits, enzyme roles, category and ingredient words."""
    x, name = F.col("text"), F.col("name")
    doses = F.transform(E.dose_adjustments(x), lambda d: F.concat_ws(" ", d["op"], d["value"].cast("string"), d["upper"].cast("string"), d["kind"]))
    roles = F.transform(E.enzyme_roles(x), lambda r: F.concat_ws(" ", r["enzyme"], r["role"]))
    d = t.spark.createDataFrame(FACTS, "id int, name string, text string, ingredient string")
    join = lambda c: F.array_join(c, "; ")
    return d.select(
        _id(), E.severity(x, F.lit("varfarin")).alias("severity"), join(E.conditions(x)).alias("conditions"), join(E.mentions(x, name)).alias("mentions"), join(doses).alias("doses"), join(roles).alias("roles"),
        E.pregnancy_category(x).alias("category"), join(E.ingredient_words(F.col("ingredient"))).alias("ingredients"),
    )


GROUP_TEXT = (
    "Genel doz günde bir tablettir.\nÖzel popülasyonlara ilişkin ek bilgiler:\nBöbrek yetmezliği: GFR 30 altında doz yarıya indirilmelidir, dikkatli olunmalıdır.\n"
    "Pediyatrik popülasyon: çocuklarda kullanım için yeterli veri yoktur, önerilmez.\nGeriyatrik popülasyon: kısa."
)
PARTS = [
    (1, GROUP_TEXT),
    (2, "Böbrek/Karaciğer yetmezliği: her ikisinde de dikkatle kullanılmalıdır, doz ayarlanır. Karaciğer yetmezliği ayrıca önemlidir."),
    (3, "Hiçbir alt başlık yok."),
    (4, "\n\n".join(["Giriş paragrafı."] + [f"{k} " + "uyarı metni " * 90 for k in range(4)])),
    (5, None),
]


@case("section_parts")
def section_parts(t):
    """Parts by patient group, and packed parts of long sections."""
    d = t.spark.createDataFrame(PARTS, "id int, text string")
    args = (F.col("text"), F.lit("Başlık"), F.lit("ILAÇ A"), F.lit("a.pdf"))
    both = F.concat(F.coalesce(S.group_parts(*args), F.array().cast(S.PART)), F.coalesce(S.packed_parts(*args), F.array().cast(S.PART)))
    return d.select("id", F.posexplode(both).alias("at", "p")).select(_id(), F.col("at").cast("long").alias("place"), "p.key", "p.label", F.array_join("p.flags", ",").alias("flags"), F.length("p.text").cast("long").alias("size"), F.md5("p.text").alias("digest"), "p.chunk_id")


PAGES = [
    (1, [(0.0, 10.0, 50.0, 20.0, "sol üst"), (60.0, 11.0, 90.0, 20.0, "sağ üst"), (0.0, 100.0, 50.0, 110.0, "alt"), (0.0, 50.0, 20.0, 60.0, "hücre")], [(0.0, 45.0, 100.0, 70.0, "| a | b |")]),
    (2, [(0.0, 0.0, 1.0, 1.0, " ")], []),
]
BOX = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"
TABLES = [(1, [["İlaç", "Doz"], ["A\nB", "5 mg"], [None, "x"]]), (2, [["a", None], ["b", "c"]])]


@case("page_layouts")
def page_layouts(t):
    """Blocks in reading order around tables; tables as Markdown."""
    pages = t.spark.createDataFrame(PAGES, f"id int, blocks {BOX}, tables {BOX}").select(_id(), S.page_with_tables(F.col("blocks"), F.col("tables")).alias("text"))
    tables = t.spark.createDataFrame(TABLES, "id int, rows array<array<string>>").select((F.col("id") + 10).cast("long").alias("id"), S.table_markdown(F.col("rows")).alias("text"))
    return pages.unionByName(tables)


KNOWN = [("BELOC ZOK 50 MG", "metoprolol süksinat", "a"), ("COUMADIN 5 MG", "varfarin sodyum", "b"), ("Bilinmeyen İlaç", "x", "c"), ("KLACID 500", "klaritromisin", "d"), ("BELOC ZOK 50 MG", "başka", "e"), ("COUMADIN 0,5-MG", "varfarin", "f")]
NAMES_ASKED = [("beloc zok 50 mg",), ("Coumadin",), ("varfarin",), ("warfarin",), ("KLASID 500",), ("laci",), ("yok böyle",), ("  ",), ("coumadin 0.5 - mg",), ("MG BELOC",)]


def _registry(t):
    return R.registry(t.spark.createDataFrame(KNOWN, "name string, ingredient string, file string"))


@case("resolved_names")
def resolved_names(t):
    """Six tiers from a query to entities."""
    known = _registry(t)
    got = R.resolved(t.spark.createDataFrame(NAMES_ASKED, "q string"), known).join(known.select("entity", "name"), "entity")
    return got.select("q", "name", F.col("tier").cast("long").alias("tier"))


@case("canonical_names")
def canonical_names(t):
    """Five tiers from a query to the names of the corpus."""
    got = R.canonical_names(t.spark.createDataFrame(NAMES_ASKED, "q string"), _registry(t))
    return got.select("q", "name", F.col("tier").cast("long").alias("tier"))


@case("similar_profiles")
def similar_profiles(t):
    """Three tiers from a query to a table of profiles."""
    known = t.spark.createDataFrame([("varfarin",), ("klaritromisin",), ("metoprolol tartarat",)], "name string")
    asked = t.spark.createDataFrame([("Varfarin",), ("varfarin sodyum",), ("metoprolol",), ("metoprolol süksinat",), ("aspirin",)], "q string")
    return R.similar_names(asked, known).select("q", F.col("entity").alias("name"), F.col("tier").cast("long").alias("tier"))
