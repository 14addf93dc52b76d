"""Rules of labels, reports, profiles, questions and answers on texts that are made of the given tables: numbers and names
of the rows decide what a rule finds, and the SQL says it of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import context as C
from millrace.functions import extraction as E
from millrace.functions import items as I
from millrace.functions import lab_text as L
from millrace.functions import patients as P
from millrace.functions import questions as Q
from millrace.functions import sections as S
from millrace.operators import checks as K
from millrace.operators import graph as G
from millrace.operators import resolve as R
from millrace.operators import risks as X
from millrace.plans.registry import query
from millrace.sources.scratch import spread

NL = "chr(10)"


def _id(c="id"):
    return F.col(c).cast("long").alias("id")


# --- reports ------------------------------------------------------------------------------------------------------------
#: Both Spark and DuckDB read these expressions.
LINE = "CASE event_id % 6 WHEN 0 THEN 'Alanin aminotransferaz (ALT)' WHEN 1 THEN 'HGB' WHEN 2 THEN 'Potasyum (K)' WHEN 3 THEN 'PLT' WHEN 4 THEN 'Üre' ELSE 'Sayfa' END || '   ' || CAST(event_id * 7 % 3000 AS STRING) || CASE WHEN event_id % 2 = 0 THEN ',5' ELSE '.25' END || '  U/L'"


@query("report_values", """WITH v AS (SELECT user_id AS id, event_id, ['ALT', 'HGB', 'K', 'PLT', 'Üre'][event_id % 6 + 1] AS name, ['ALT', 'Hemoglobin', 'K', 'Trombosit', 'Üre'][event_id % 6 + 1] AS known, event_id * 7 % 3000 + CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS value FROM events WHERE event_id % 6 < 5)
SELECT id, name, max_by(value, event_id) AS value, false AS profile FROM v GROUP BY 1, 2 UNION ALL
SELECT id, known, max_by(value, event_id), true FROM v WHERE value BETWEEN CASE known WHEN 'Üre' THEN 0 ELSE 1 END AND CASE known WHEN 'Hemoglobin' THEN 25 WHEN 'K' THEN 10 WHEN 'Üre' THEN 1e9 ELSE 2000 END GROUP BY 1, 2""")
def report_values(t):
    """A report for each user, a row for each event: the last value of each name, and those that profiles know."""
    lines = t.events.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.expr(LINE).alias("line")))).alias("l"))
    reports = lines.select("id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    return L.report_values(reports, "id", "text").select(_id(), "name", "value", "profile")


_N = "CAST(event_id * 7 % 2500 AS STRING)"
LAB_TEXT = f"CASE event_id % 4 WHEN 0 THEN 'ALT: ' || {_N} || '.5' WHEN 1 THEN 'Sodyum' || {NL} || {_N} || '.5 mmol' WHEN 2 THEN 'Tarih 2025' || {NL} || 'INR 2025 ' || CAST(event_id * 7 % 2500 % 30 AS STRING) || '.5' ELSE 'PLT' || {NL} || {NL} || {_N} || '.5' || {NL} || 'Kreatinin ' || CAST(event_id * 7 % 2500 % 40 AS STRING) || '.5' END"


@query("lab_texts", """WITH v AS (SELECT event_id AS id, ['ALT', 'Na', 'INR', 'Trombosit'][event_id % 4 + 1] AS name, CASE WHEN event_id % 4 = 2 THEN event_id * 7 % 2500 % 30 ELSE event_id * 7 % 2500 END + 0.5::DOUBLE AS value FROM events UNION ALL SELECT event_id, 'Kreatinin', event_id * 7 % 2500 % 40 + 0.5::DOUBLE FROM events WHERE event_id % 4 = 3)
SELECT id, name, value FROM v WHERE value BETWEEN CASE name WHEN 'Na' THEN 100 WHEN 'INR' THEN 0.5 WHEN 'Kreatinin' THEN 0.1 ELSE 1 END AND CASE name WHEN 'Na' THEN 200 WHEN 'INR' THEN 20 WHEN 'Kreatinin' THEN 30 ELSE 2000 END""")
def lab_texts(t):
    """Values beside or below their names in plain texts, one for each event."""
    d = t.events.select(_id("event_id"), F.explode_outer(L.text_values(F.expr(LAB_TEXT))).alias("name", "value"))
    return d.where("name is not null")


# --- profiles -----------------------------------------------------------------------------------------------------------
_GFR = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 120 AS DOUBLE) + 0.5 END"
_PUGH = "CASE c_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END"
_SEX = "CASE WHEN c_custkey % 2 = 0 THEN 'erkek' ELSE 'kadın' END"
_LABS = "map('ALT', CAST(c_custkey % 200 AS DOUBLE), 'K', CAST(30 + c_custkey % 40 AS DOUBLE) / 10, 'Kreatinin', CAST(c_custkey % 30 AS DOUBLE) / 10)"
_STAGE = "CASE WHEN gfr IS NULL THEN 'bilinmiyor' " + " ".join(f"WHEN gfr >= {n} THEN '{s}'" for n, s in P.STAGES) + f" ELSE '{P.LAST_STAGE}' END"
_PROFILE = f"p AS (SELECT c_custkey AS id, c_mktsegment AS seg, c_custkey % 90 AS age, {_SEX} AS sex, {_GFR} AS gfr, {_PUGH} AS pugh, c_custkey % 11 = 0 AS pregnant, c_custkey % 200 AS alt, (30 + c_custkey % 40) / 10.0 AS k, c_custkey % 30 / 10.0 AS crea, CAST(c_custkey % 50 + 40 AS DOUBLE) AS weight FROM customer)"


def _profiles(t, labs=_LABS, weight="cast(null as double)", drugs="cast(null as array<string>)"):
    text = "cast(null as array<string>)"
    struct = f"named_struct('age', cast(c_custkey % 90 as int), 'sex', {_SEX}, 'weight', {weight}, 'gfr', {_GFR}, 'child_pugh', {_PUGH}, 'drugs', {drugs}, 'allergies', {text}, 'indications', {text}, 'pregnant', c_custkey % 11 = 0, 'nursing', false, 'labs', {labs}, 'notes', cast(null as string), 'pediatric', cast(null as boolean), 'geriatric', cast(null as boolean))"
    return t.customer.select(F.col("c_custkey").alias("id"), "c_mktsegment", F.expr(struct).cast(P.PROFILE).alias("p"))


@query("patient_profiles", f"""WITH {_PROFILE}, x AS (SELECT *, list_filter([CASE WHEN alt >= 120 THEN 'ALT:kritik_yüksek' WHEN alt > 40 THEN 'ALT:yüksek' END, CASE WHEN k >= 5.5 THEN 'K:kritik_yüksek' WHEN k <= 3.5 THEN 'K:kritik_düşük' END, CASE WHEN crea >= 1.5 THEN 'Kreatinin:kritik_yüksek' END], lambda x: x IS NOT NULL) AS labs,
 list_filter([CASE WHEN age >= 65 THEN 'geriatric' END, CASE WHEN coalesce(pugh IN ('B', 'C'), false) OR alt > 40 THEN 'hepatic' END, CASE WHEN age < 18 THEN 'pediatric' END, CASE WHEN coalesce(gfr < 60, false) OR crea >= 1.5 THEN 'renal' END], lambda x: x IS NOT NULL) AS flags FROM p)
SELECT id, {_STAGE} AS stage, array_to_string(flags, ',') AS flags, array_to_string(list_sort(labs), ',') AS labs, 3 + (pugh IS NOT NULL)::BIGINT + pregnant::BIGINT AS lines FROM x""")
def patient_profiles(t):
    """Stage, flags, abnormal values and summary of a profile for each customer."""
    p = F.col("p")
    labs = F.array_sort(F.transform(P.abnormal_labs(p["labs"]), lambda r: F.concat_ws(":", r["name"], r["status"])))
    return _profiles(t).select(_id(), P.kidney_stage(p["gfr"]).alias("stage"), F.array_join(F.array_sort(P.active_flags(p)), ",").alias("flags"), F.array_join(labs, ",").alias("labs"), F.size(F.split(P.summary(p), "\n")).cast("long").alias("lines"))


_KIDNEY_CHUNK, _LIVER_CHUNK = "Kreatinin klerensi düşükse doz azaltılır.", "Siroz ve yaşlı hastalar."


@query("profile_summaries", f"""WITH {_PROFILE}, x AS (SELECT *, seg IN ('BUILDING', 'MACHINERY') AS kidney FROM p)
SELECT id, concat_ws(chr(10), 'Yaş: ' || CASE WHEN age > 0 THEN age::VARCHAR ELSE 'belirtilmemiş' END || ', Cinsiyet: ' || sex,
 'Böbrek fonksiyonu: GFR=' || gfr || ' mL/dak/1.73m² (' || CASE WHEN gfr >= 60 THEN 'normal sınırlar)' WHEN kidney THEN {_STAGE} || ')' ELSE 'Bu ilaç için KÜB''de özel renal kısıt belirtilmemiştir)' END,
 'Karaciğer fonksiyonu: Child-Pugh ' || pugh || CASE WHEN pugh IN ('B', 'C') AND kidney THEN ' (Bu ilaç için KÜB''de özel hepatik kısıt belirtilmemiştir)' ELSE '' END, CASE WHEN pregnant THEN 'Durum: GEBELİK' END, 'Mevcut ilaçlar: ' || seg, 'Kilo: ' || weight || ' kg',
 CASE WHEN age >= 65 AND NOT kidney THEN 'Not: Geriyatrik hasta (' || age || ' yaş) — geriyatrik doz titrasyon değerlendirmesi gerekebilir' END) AS summary FROM x""")
def profile_summaries(t):
    """The summary of a customer's profile beside a chunk that speaks of the kidney, or of the liver and of old age."""
    d = _profiles(t, "cast(null as map<string,double>)", "cast(c_custkey % 50 + 40 as double)", "array(c_mktsegment)")
    text = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), _KIDNEY_CHUNK).otherwise(_LIVER_CHUNK)
    chunks = F.array(F.struct(F.lit("4.2").alias("section"), F.lit("A").alias("name"), text.alias("text")))
    return d.withColumn("chunks", chunks).select(_id(), P.summary_for(F.col("p"), F.col("chunks")).alias("summary"))


# --- questions ----------------------------------------------------------------------------------------------------------
_ASKED = [
    "Parol ile aspirin birlikte kullanılabilir mi?", "KBY hastasında doz ayarı gerekir mi?", "Miyastenia gravis hastasında risk var mı?", "Bu ilaç hangi firmanın?",
    "Gebelikte kullanım hakkında bilgi", "Doz aşımı durumunda ne yapılır, zehirlenme belirtileri?", "kanama riski yan etki olarak görülür mü", "AF ve KAH öyküsü olan hastada etkileşim?",
]
_ASK = "CASE conv_id % 8 " + " ".join(f"WHEN {k} THEN '{q}'" for k, q in enumerate(_ASKED)) + " END"


@query("question_plans", f"""WITH c AS (SELECT DISTINCT conv_id AS id, conv_id % 8 AS k, conv_id % 7 AS j, CASE WHEN conv_id % 7 <> 4 THEN conv_id % 90 END AS age, CASE WHEN conv_id % 7 <> 2 THEN (conv_id % 120 + 0.5)::DOUBLE END AS gfr, {_ASK} AS asked FROM conversations),
f AS (SELECT *, coalesce(gfr < 60, false) AS renal, j IN (1, 4) AS hepatic, j IN (2, 3) AS mother, CASE WHEN j = 4 THEN true ELSE age >= 65 END AS old, CASE WHEN j = 4 THEN false ELSE age < 18 END AS young,
 [['etkilesim', 'kontrendikasyon'], ['doz'], ['uyari'], [], ['gebelik_laktasyon'], ['doz', 'doz_asimi'], ['yan_etki', 'uyari'], ['etkilesim']][k + 1] AS said FROM c),
g AS (SELECT *, list_filter(['etkilesim', 'kontrendikasyon', 'doz', 'gebelik_laktasyon', 'yan_etki', 'uyari', 'doz_asimi'], lambda x: list_contains(said, x) OR (mother AND x = 'gebelik_laktasyon')) AS own FROM f),
h AS (SELECT *, CASE WHEN len(own) = 0 THEN ['genel'] ELSE own END AS kinds FROM g),
x AS (SELECT *, CASE WHEN k = 2 THEN ['4.4'] ELSE [] END || flatten(list_transform(kinds, lambda x: CASE x WHEN 'etkilesim' THEN ['4.5', '4.4'] WHEN 'kontrendikasyon' THEN ['4.3', '4.4'] WHEN 'doz' THEN ['4.2'] WHEN 'gebelik_laktasyon' THEN ['4.6', '4.3'] WHEN 'yan_etki' THEN ['4.8', '4.4'] WHEN 'uyari' THEN ['4.4', '4.3'] WHEN 'doz_asimi' THEN ['4.9'] ELSE [] END))
 || ['4.3', '4.4', '4.5'] || CASE WHEN renal OR hepatic THEN ['4.2', '4.4'] ELSE [] END || CASE WHEN mother THEN ['4.6'] ELSE [] END || CASE WHEN old THEN ['4.2'] ELSE [] END AS places,
 concat_ws(' ', asked, CASE k WHEN 1 THEN 'kronik böbrek yetmezliği renal yetmezlik' WHEN 7 THEN 'atriyal fibrilasyon aritmisi koroner arter hastalığı iskemik kalp' END, CASE WHEN renal THEN 'böbrek yetmezliği GFR ' || gfr END, CASE j WHEN 1 THEN 'karaciğer yetmezliği Child-Pugh B' WHEN 4 THEN 'karaciğer yetmezliği Child-Pugh C' END,
 CASE WHEN old THEN 'geriyatrik yaşlı hasta ' || coalesce(age, 0) || ' yaş' WHEN young THEN 'pediyatrik çocuk hasta ' || age || ' yaş' END, CASE j WHEN 2 THEN 'gebelik hamile' WHEN 3 THEN 'laktasyon emzirme' END, CASE WHEN j = 1 AND list_contains(kinds, 'etkilesim') THEN 'ilaç etkileşimi ASPIRIN' END,
 CASE WHEN k = 6 THEN 'yan etki istenmeyen etki advers reaksiyon güvenlilik profili kanama riski hemoraji' END, CASE WHEN k = 2 THEN 'özel kullanım uyarısı Miyastenia gravis dikkatli kullanım' END,
 CASE WHEN k IN (0, 1, 5) THEN CASE j WHEN 1 THEN 'karaciğer enzim yüksekliği hepatotoksisite' WHEN 2 THEN 'böbrek fonksiyon bozukluğu kreatinin yüksek' WHEN 5 THEN 'diyabet glisemik kontrol bozuk' WHEN 6 THEN 'hipokalemi potasyum düşük' END END) AS query FROM h)
SELECT id, unnest(CASE WHEN id % 2 = 0 THEN ['A', 'B'] ELSE [NULL] END) AS name, array_to_string(kinds, ',') AS kinds, array_to_string(list_filter(places, lambda s, i: list_position(places, s) = i), ',') AS sections, query, 5::BIGINT AS n_results FROM x""")
def question_plans(t):
    """Kinds, sections and the enriched query of a question in each conversation, beside a profile: all eight questions and
    what the profiles of the literal rows have, dealt by number."""
    d = t.conversations.select("conv_id").distinct()
    none, j = "cast(null as array<string>)", "conv_id % 7"
    labs = f"case {j} when 1 then map('ALT', 130d, 'K', 5.6d, 'X', 1d) when 2 then map('Kreatinin', 1.5d, 'Na', 130d, 'INR', 2.4d) when 3 then map('Trombosit', 50d, 'Hemoglobin', 8.1d, 'GGT', 61d, 'ALP', 360d) when 5 then map('HbA1c', 9d, 'Bilirubin', 1.9d, 'AST', 40d) when 6 then map('K', 3.5d) end"
    profile = (
        f"named_struct('age', cast(case when {j} != 4 then conv_id % 90 end as int), 'sex', cast(null as string), 'weight', cast(null as double), 'gfr', case when {j} != 2 then cast(conv_id % 120 as double) + 0.5 end, 'child_pugh', case {j} when 1 then 'B' when 3 then 'A' when 4 then 'C' end, "
        f"'drugs', case when {j} = 1 then array('ASPIRIN') end, 'allergies', {none}, 'indications', {none}, 'pregnant', {j} = 2, 'nursing', {j} = 3, 'labs', {labs}, 'notes', cast(null as string), 'pediatric', case when {j} = 4 then false end, 'geriatric', case when {j} = 4 then true end)"
    )
    q = d.select(_id("conv_id"), F.expr(_ASK).alias("question"), F.expr(profile).cast(P.PROFILE).alias("profile"), F.expr("case when conv_id % 2 = 0 then array('A', 'B') end").alias("targets"))
    return Q.search_plans(q).select("id", "name", F.array_join("kinds", ",").alias("kinds"), F.array_join("sections", ",").alias("sections"), "query", F.col("n_results").cast("long").alias("n_results"))


# --- answers ------------------------------------------------------------------------------------------------------------
_K, _DOSE = "(conv_id + turn) % 5", "CAST((conv_id * 3 + turn) % 12 AS STRING) || '.5'"
_HEAD, _END = f"'## SONUÇ' || {NL}", f"{NL} || {NL} || '## KAYNAKLAR' || {NL} || '- TEST'"
_LEVEL = "CASE WHEN turn % 4 < 2 THEN 'artar' ELSE 'azalır' END"
ANSWER = f"""CASE {_K} WHEN 0 THEN {_HEAD} || {NL} || 'Günlük doz ' || {_DOSE} || ' mg verilmelidir.' || {_END} WHEN 1 THEN {_HEAD} || {NL} || 'Başlangıç dozu ' || {_DOSE} || ' mg önerilir. [TEST ILAC | Madde 4.2]' || {_END}
 WHEN 2 THEN {_HEAD} || {NL} || 'Bu ilaç CYP3A4 enzimini etkiler; varfarin düzeyi ' || {_LEVEL} || '. [CYP450]' || {_END} WHEN 3 THEN 'Bu ilaç yaşlı hastalarda güvenlidir.' ELSE {_HEAD} || 'Bu ilaç kontrendikedir [TEST ILAC | Madde 4.3]' || {_END} END"""
_SECTION = f"CASE {_K} WHEN 0 THEN '4.2' WHEN 1 THEN '4.2' WHEN 2 THEN '4.5' WHEN 3 THEN '4.4' ELSE '4.3' END"
_TEXT = f"CASE {_K} WHEN 0 THEN 'Doz 2.5 mg veya 5.5 mg olarak ayarlanabilir.' WHEN 1 THEN 'Doz 2,5 mg veya 7.5 mg olarak ayarlanabilir.' WHEN 2 THEN CASE WHEN conv_id % 2 = 0 THEN 'Güçlü bir inhibitördür.' ELSE 'Güçlü bir indükleyicidir.' END WHEN 3 THEN 'Dikkatli kullanılmalı.' ELSE CASE WHEN conv_id % 2 = 0 THEN 'Aşırı duyarlılıkta kontrendikedir.' ELSE 'Dikkatle izlenmelidir.' END END"
_ANSWERS = f"a AS (SELECT conv_id * 1000 + turn AS id, {_K} AS k, {_DOSE} AS dose, {ANSWER} AS answer, {_TEXT} AS text, conv_id % 2 = 0 AS even, turn % 4 < 2 AS rises FROM conversations WHERE role = 'assistant')"


def _answers(t):
    chunk = F.array(F.struct(F.expr(_SECTION).alias("section"), F.lit("TEST ILAC").alias("name"), F.expr(_TEXT).alias("text")))
    return t.conversations.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.expr(ANSWER).alias("answer"), F.lit("bu ilaç nasıl kullanılır?").alias("question"), chunk.alias("chunks"))


@query("answer_checks", f"""WITH {_ANSWERS}, b AS (SELECT *, k IN (0, 1) AND NOT contains(text, dose) AND NOT contains(text, replace(dose, '.', ',')) AS wrong, CASE WHEN k = 2 AND even AND NOT rises THEN '{K.TAG_RISES}' WHEN k = 2 AND NOT even AND rises THEN '{K.TAG_FALLS}' END AS enzyme FROM a)
SELECT id, CASE k WHEN 3 THEN replace(answer, 'güvenlidir', '{K.SAFE_NOTICE}') WHEN 4 THEN CASE WHEN even THEN answer ELSE replace(answer, '4.3]', '4.3]{K.TAG_VERDICT}') END WHEN 2 THEN replace(answer, '[CYP450]', '[CYP450]' || coalesce(enzyme, '')) WHEN 1 THEN CASE WHEN wrong THEN replace(answer, '4.2]', '4.2] {K.UNVERIFIED}') ELSE answer END ELSE CASE WHEN wrong THEN replace(answer, 'verilmelidir.', 'verilmelidir. {K.UNVERIFIED}') ELSE answer END END AS answer,
 k <> 3 AS has_conclusion, k IN (1, 4) AS cited, false AS quoted, false AS judged, false AS poor, (wrong OR enzyme IS NOT NULL)::BIGINT AS unverified FROM b""")
def answer_checks(t):
    """All seven checks, one after the other, on an answer for each turn: doses and levels go by its numbers."""
    d = K.checked(_answers(t))
    return d.select(_id(), "answer", *[F.col(f"format.{c}") for c in ("has_conclusion", "cited", "quoted", "judged", "poor")], F.col("format.unverified").cast("long").alias("unverified"))


@query("verdict_levels", f"WITH {_ANSWERS} SELECT id, CASE WHEN k = 4 THEN 'Bu ilaç kontrendikedir [TEST ILAC | Madde 4.3]' ELSE '' END AS first, CASE WHEN k = 4 THEN 4 ELSE 2 END::BIGINT AS level, CASE WHEN k = 4 AND even THEN 4 ELSE 2 END::BIGINT AS supported FROM a")
def verdict_levels(t):
    """The level that an answer's conclusion claims, and the one that its sections support."""
    first, level, supported = K.verdict_levels(F.col("answer"), F.col("question"), F.col("chunks"))
    return _answers(t).select(_id(), first.alias("first"), level.cast("long").alias("level"), supported.cast("long").alias("supported"))


# --- free texts ---------------------------------------------------------------------------------------------------------
CONTEXT = (
    "CASE c_custkey % 17 WHEN 14 THEN 'Gebe kadın hasta, penisilin alerjisi var. Hipertansiyon için ramipril eklemek istiyorum.' WHEN 15 THEN CAST(c_custkey % 130 AS STRING) || ' yaş çocuk hasta Child-Pugh b siroz. Mevcut ilaçları: metformin, aspirin ve insülin.' WHEN 16 THEN 'yaşı bilinmiyor' "
    f"ELSE CAST(c_custkey % 130 AS STRING) || ' yaşında ' || {_SEX} || ' hasta, ' || CAST(c_custkey % 400 AS STRING) || ' kg, GFR ' || CAST(c_custkey % 150 AS STRING) || ', ALT: 60. Varfarin kullanıyor. Hastaya klaritromisin yazabilir miyim?' END"
)


@query("patient_context", f"""WITH x AS (SELECT c_custkey AS id, greatest(c_custkey % 17 - 13, 0) AS k, CASE WHEN c_custkey % 130 BETWEEN 1 AND 119 THEN c_custkey % 130 END AS n, {_SEX} AS s, CASE WHEN c_custkey % 400 > 10 AND c_custkey % 400 < 300 THEN (c_custkey % 400)::DOUBLE END AS w, (c_custkey % 150)::DOUBLE AS g, {CONTEXT} AS said FROM customer),
y AS (SELECT *, CASE WHEN k IN (0, 2) THEN n END AS age, CASE k WHEN 0 THEN s WHEN 1 THEN 'kadın' END AS sex, CASE WHEN k = 0 THEN w END AS weight, CASE WHEN k = 0 THEN g END AS gfr FROM x)
SELECT id, age, sex, weight, gfr, coalesce(gfr < 60, false) AS renal, k = 2 AS hepatic, CASE WHEN k = 2 THEN 'B' END AS child_pugh, false AS pregnant, false AS nursing, k = 2 OR coalesce(age < 18, false) AS pediatric, coalesce(age >= 65, false) AS geriatric, CASE WHEN k = 0 THEN 'ALT' ELSE '' END AS labs, CASE WHEN k = 1 THEN 'Hipertansiyon' ELSE '' END AS diagnoses,
 CASE WHEN k = 1 THEN 'penisilin' ELSE '' END AS allergies, ['klaritromisin', 'ramipril eklemek', NULL, NULL][k + 1] AS target, ['Varfarin', '', 'metformin,aspirin,insülin', ''][k + 1] AS current, CASE WHEN k = 0 THEN 'Hastaya klaritromisin yazabilir miyim?' ELSE said END AS question FROM y""")
def patient_context(t):
    """What a free text says of a patient, one of the four kinds of text for each customer."""
    d = spread(t.customer.select("c_custkey")).select(F.col("c_custkey").alias("id"), C.context(F.expr(CONTEXT)).alias("c")).select("id", "c.*")
    join = lambda c: F.array_join(c, ",").alias(c)
    return d.select(
        _id(), F.col("age").cast("long").alias("age"), "sex", "weight", "gfr", "renal", "hepatic", "child_pugh", "pregnant", "nursing", "pediatric", "geriatric",
        F.array_join(F.array_sort(F.map_keys("labs")), ",").alias("labs"), join("diagnoses"), join("allergies"), "target", join("current"), "question",
    )


_SAID = "'Hasta ' || split_part(p_name, ' ', 1) || ' ve ' || split_part(p_name, ' ', 2) || ' kullanıyor, ' || CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) || ' forte ne olur' ELSE 'başka soru yok' END"


@query("names_in_texts", f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, upper(unnest(string_split(name, ' ')[1:3])) AS w FROM n),
x AS (SELECT p_partkey AS id, upper(s) AS s, CASE WHEN contains(s, 'ne olur') THEN instr(s, 'ne olur') - 1 ELSE length(s) END AS asked FROM (SELECT p_partkey, {_SAID} AS s FROM part)),
h AS (SELECT id, name, asked, min(instr(s, w) - 1) AS at_ FROM x JOIN w ON length(w) >= 5 AND list_contains(string_split_regex(s, '[^A-ZÇĞİÖŞÜ0-9_]+'), w) GROUP BY 1, 2, 3),
b AS (SELECT id, max(CASE WHEN at_ < asked THEN {{'a': at_, 'n': name}} END) AS before_, min(CASE WHEN at_ >= asked THEN {{'a': at_, 'n': name}} END) AS after_ FROM h GROUP BY 1)
SELECT id, name, at_::BIGINT AS place, name = coalesce(before_.n, after_.n) AS target FROM h JOIN b USING (id)""")
def names_in_texts(t):
    """Part names in a text for each part, and which of them the text asks about."""
    texts = t.part.select(F.col("p_partkey").alias("id"), F.expr(_SAID).alias("text"))
    got = C.names_in_text(texts, t.part.select(F.col("p_name").alias("name")).distinct(), "id", "text")
    return got.select(_id(), "name", F.col("at").cast("long").alias("place"), "target")


_LIMIT = "CAST(c_custkey % 90 + 1 AS STRING)"
_CATEGORY = "substring('ABCDX', CAST(c_custkey % 5 + 1 AS INT), 1)"
_KIND = "c_custkey % 7 % 5"
FACTS = (
    f"CASE {_KIND} WHEN 0 THEN 'Varfarin ile birlikte kullanılmamalıdır. GFR < ' || {_LIMIT} || ' mL/dak ise kontrendikedir. Aktif peptik ülseri olan hastalarda. CYP3A4 ile metabolize olur.' WHEN 1 THEN 'Kreatinin klerensi ' || {_LIMIT} || '-' || CAST(c_custkey % 90 + 31 AS STRING) || ' arasında doz azaltılmalıdır; GFR 45 ila <60. CYP2D6 inhibitörü. Gebelik kategorisi: ' || {_CATEGORY} "
    "WHEN 2 THEN 'Gebelikte kullanılmamalıdır. Klinik önemi sınırlı.' WHEN 4 THEN 'Rifampisin indükleyici etki gösterir, CYP 3A4 indükler. Digoksin inhibitör birlikte. Böbrek  yetmezliği ve astım; BÖBREK YETMEZLİĞİ.' ELSE '' END"
)
_OF = ["asetilsalisilik asit 100 mg", "metoprolole eşdeğer metoprolol suksinat", "klopidogrele eşdeğer klopidogrel hidrojen sülfat", None, "Parasetamol 500 mg Klorfeniramin maleat"]
_INGREDIENT = f"CASE {_KIND} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_OF) if x) + " END"
_SUBJECT = f"CASE {_KIND} WHEN 0 THEN 'ASPIRIN 100 MG' WHEN 1 THEN 'BELOC' WHEN 2 THEN 'X' WHEN 3 THEN 'Y' ELSE 'Z' END"


@query("text_facts", f"""WITH x AS (SELECT c_custkey AS id, {_KIND} AS k, c_custkey % 90 + 1 AS n, {_CATEGORY} AS cat FROM customer)
SELECT id, ['contraindicated', 'moderate', 'contraindicated', 'unknown', 'unknown'][k + 1] AS severity, ['peptik ülseri', 'gebelik', 'gebelik', '', 'böbrek yetmezliği; astım; böbrek yetmezli' || chr(775) || 'ği' || chr(775)][k + 1] AS conditions, ['Varfarin', '', '', '', 'Digoksin inhibitör'][k + 1] AS mentions,
 CASE k WHEN 0 THEN '< ' || n || '.0 contraindicated' WHEN 1 THEN '< ' || n || '.0 ' || (n + 30) || '.0 dose_reduction' || CASE WHEN n = 45 THEN '' ELSE '; < 45.0 60.0 dose_reduction' END ELSE '' END AS doses,
 ['CYP3A4 substrate', 'CYP2D6 inhibitor', '', '', 'CYP3A4 inhibitor'][k + 1] AS roles, CASE k WHEN 1 THEN cat WHEN 2 THEN 'X' END AS category, ['asetilsalisilik', 'suksinat; metoprolol', 'klopidogrel', NULL, 'parasetamol; klorfeniramin'][k + 1] AS ingredients FROM x""")
def text_facts(t):
    """Severity, conditions, mentions, dose limits, enzyme roles, category and ingredient words of a text for each customer,
    one of five kinds."""
    x, join = F.col("x"), lambda c: F.array_join(c, "; ")
    doses = F.transform(E.dose_adjustments(x), lambda d: F.concat_ws(" ", d["op"], d["value"].cast("string"), d["upper"].cast("string"), d["kind"]))
    roles = F.transform(E.enzyme_roles(x), lambda r: F.concat_ws(" ", r["enzyme"], r["role"]))
    return spread(t.customer.select("c_custkey")).select(_id("c_custkey"), F.expr(FACTS).alias("x"), F.expr(_INGREDIENT).alias("ingredient"), F.expr(_SUBJECT).alias("name")).select(
        "id", E.severity(x, F.lit("varfarin")).alias("severity"), join(E.conditions(x)).alias("conditions"), join(E.mentions(x, F.col("name"))).alias("mentions"), join(doses).alias("doses"), join(roles).alias("roles"),
        E.pregnancy_category(x).alias("category"), join(E.ingredient_words(F.col("ingredient"))).alias("ingredients"),
    )


# --- ingredients --------------------------------------------------------------------------------------------------------
_MADE_OF = "split_part(p_name, ' ', 1) || 'oprolol ' || split_part(p_name, ' ', 2) || 'ipramin 5 mg'"


@query("ingredient_groups", """WITH x AS (SELECT p_name || ' ' || (p_size % 3) AS name, split_part(p_name, ' ', 1) || 'oprolol' AS a, split_part(p_name, ' ', 2) || 'ipramin' AS b FROM part),
g AS (SELECT DISTINCT name, CASE WHEN length(a) > length(b) THEN a WHEN length(b) > length(a) THEN b ELSE least(a, b) END AS token FROM x WHERE greatest(length(a), length(b)) >= 8)
SELECT token, name FROM g QUALIFY count(*) OVER (PARTITION BY token) > 1""")
def ingredient_groups(t):
    """Names by the longest word of their ingredient."""
    nodes = t.part.select(F.concat("p_name", F.lit(" "), (F.col("p_size") % 3).cast("string")).alias("name"), F.expr(_MADE_OF).alias("ingredient"))
    return G.ingredient_groups(nodes)


# --- risks --------------------------------------------------------------------------------------------------------------
_EFFECTS = ["QT uzaması ve aritmi bildirildi.", "Hepatit ve sarılık görülebilir.", "Akut böbrek yetmezliği.", "Ciddi kanama ve anemi.", "Konvülsiyon, tremor.", "Bronkospazm ve dispne.", "Mide kanaması olabilir.", "Anafilaksi ve ürtiker.", "Hipokalemi ve hipoglisemi.", "Önemli bir şey yok.", "Bazı hastalarda hafif ödem.", "Önce bulantı, sonra kusma."]
_EFFECT = "CASE l_partkey % 12 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_EFFECTS)) + " END"
_PART_OF = "CASE l_linenumber % 6 WHEN 0 THEN '4.8' WHEN 1 THEN '4.4' WHEN 2 THEN '4.1' WHEN 3 THEN '4.3' WHEN 4 THEN '4.5' ELSE '4.8' END"


@query("patient_risks", f"""WITH k AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{n}', '{p}')" for c, n, p in X.CATEGORIES)}) t(category, label, pattern)),
c AS (SELECT l_orderkey, 'ilac ' || (l_partkey % 500) AS name, {_PART_OF} AS section, {_EFFECT} AS text FROM lineitem),
x AS (SELECT text, category, label FROM (SELECT DISTINCT text FROM c), k WHERE regexp_matches(text, '(?i)(' || pattern || ')')),
h AS (SELECT l_orderkey, category, label, list_sort(list_distinct(list(name))) AS drugs FROM c JOIN x USING (text) WHERE section IN ('4.8', '4.4', '4.5', '4.3') GROUP BY 1, 2, 3)
SELECT l_orderkey, category, array_to_string(drugs, ',') AS drugs, CASE WHEN len(drugs) >= 3 THEN 'kritik' ELSE 'dikkat' END AS severity, len(drugs) || ' ilaç birlikte ' || lower(label) || ' riski taşıyor: ' || array_to_string(drugs, ', ') AS text FROM h WHERE len(drugs) >= 2""")
def patient_risks(t):
    """Side effects that several drugs of an order have in common, in nine categories."""
    chunks = t.lineitem.select("l_orderkey", F.concat(F.lit("ilac "), (F.col("l_partkey") % 500).cast("string")).alias("name"), F.expr(_PART_OF).alias("section"), F.expr(_EFFECT).alias("text"))
    return X.cumulative_risks(chunks, "l_orderkey").select("l_orderkey", "category", F.array_join("drugs", ",").alias("drugs"), "severity", "text")


# --- answers of a model ---------------------------------------------------------------------------------------------------
_ITEM_1 = """'{"drug2": "  ilac ' || CAST(event_id AS STRING) || ' ", "severity": "' || CASE event_id % 3 WHEN 0 THEN 'Ciddi etkileşim' WHEN 1 THEN 'mild' ELSE 'dikkatli olun' END || '", "section": "4.3"}'"""
_ITEM_2 = """'{"name": "b' || CAST(event_id % 10 AS STRING) || '", "severity": "belirsiz", "section": "9", "mechanism": "kapalı ] ve } ile \\\\"tırnak\\\\" içinde"}'"""
_ITEM_3 = """'{"drug_b": "c", "severity": null}'"""
REPLY = f"CASE event_id % 6 WHEN 0 THEN 'Sonuç: ```json [' || {_ITEM_1} || ', ' || {_ITEM_2} || ', ' || {_ITEM_3} || ']``` bitti ]' WHEN 1 THEN '[' || {_ITEM_1} || ', ' || {_ITEM_2} || ',]' WHEN 2 THEN '[' || {_ITEM_1} || ', ' || {_ITEM_2} || ', {{\"drug_b\": \"ya' WHEN 3 THEN '[' || {_ITEM_1} || ', ' || substring({_ITEM_2}, 1, 70) WHEN 4 THEN '[' || substring({_ITEM_1}, 1, 20) ELSE 'hiçbir şey' END"


@query("reply_items", f"""WITH e AS (SELECT event_id, event_id % 6 AS k FROM events), i AS (SELECT event_id, k, 0 AS at_, 'ilac ' || event_id AS name, ['severe', 'mild', 'moderate'][event_id % 3 + 1] AS severity, '4.3' AS section, NULL::VARCHAR AS mechanism FROM e
 UNION ALL SELECT event_id, k, 1, 'b' || (event_id % 10), 'unknown', '4.5', 'kapalı ] ve }} ile "tırnak" içinde' FROM e UNION ALL SELECT event_id, k, 2, 'c', 'unknown', '4.5', NULL FROM e)
SELECT event_id, at_::BIGINT AS place, name, severity, section, mechanism FROM i WHERE at_ < [3, 2, 2, 1, 0, 0][k + 1]""")
def reply_items(t):
    """Items of a model's reply for each event: fenced, with a comma too many, cut behind, in and before whole items."""
    d = t.events.select("event_id", F.posexplode_outer(I.items(F.expr(REPLY))).alias("place", "i")).where("i.name is not null")
    return d.select("event_id", F.col("place").cast("long").alias("place"), "i.name", "i.severity", "i.section", "i.mechanism")


# --- sections and pages -------------------------------------------------------------------------------------------------
_GENERAL = "'Genel doz günde ' || CAST(doc_id AS STRING) || ' tablettir.'"
_RENAL_PART = "'Böbrek yetmezliği: GFR ' || CAST(doc_id AS STRING) || ' altında doz yarıya indirilmelidir.'"
_CHILD_PART, _BOTH_PART = "'Pediyatrik popülasyon: çocuklarda kullanım için yeterli veri yoktur, önerilmez.'", "'Böbrek/Karaciğer yetmezliği: her ikisinde de dikkatle kullanılmalıdır. Karaciğer yetmezliği ayrıca önemlidir.'"
GROUPS = f"CASE doc_id % 3 WHEN 0 THEN {_GENERAL} || {NL} || 'Özel popülasyonlara ilişkin ek bilgiler:' || {NL} || {_RENAL_PART} || {NL} || {_CHILD_PART} || {NL} || 'Geriyatrik popülasyon: kısa.' WHEN 1 THEN {_BOTH_PART} ELSE {_GENERAL} END"


@query("section_parts", f"""WITH g AS (SELECT doc_id AS id, 'ILAC ' || doc_id AS name, {_GENERAL} || chr(10) AS intro, doc_id % 3 AS k, {_RENAL_PART} || chr(10) AS renal, {_CHILD_PART} || chr(10) AS child, {_BOTH_PART} AS both_ FROM documents),
f AS (SELECT id, name, 0 AS place, 'bobrek' AS key, 'Böbrek Yetmezliği' AS label, 'renal' AS flags, '4.2' AS sec, intro || chr(10) || chr(10) AS lead, renal AS own FROM g WHERE k = 0 UNION ALL SELECT id, name, 1, 'pediyatrik', 'Pediyatrik Popülasyon', 'pediatric', '4.2', intro || chr(10) || chr(10), child FROM g WHERE k = 0
 UNION ALL SELECT id, name, 0, 'bobrek_karaciger', 'Böbrek / Karaciğer Yetmezliği', 'renal,hepatic', '4.2', '', both_ FROM g WHERE k = 1),
q AS (SELECT doc_id AS id, 'ILAC ' || doc_id AS name, length(x) AS size, list_filter(list_transform(string_split_regex(x, '\\n{{2,}}'), lambda p: trim(p, ' ' || chr(10) || chr(9))), lambda p: p <> '') AS ps FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS x FROM documents)),
r AS (SELECT id, name, size, ps[1][1:280] AS intro, list_reduce(list_transform(CASE WHEN len(ps) > 1 THEN ps[2:] ELSE ps END, lambda p: [{{'n': length(p), 't': p}}]), lambda acc, y: CASE WHEN acc[-1].n + y[1].n > 2200 THEN acc || y ELSE acc[:-2] || [{{'n': acc[-1].n + y[1].n, 't': acc[-1].t || chr(10) || chr(10) || y[1].t}}] END) AS gs FROM q WHERE size > 2500 AND len(ps) > 0),
s AS (SELECT id, name, intro, len(gs) AS total, unnest(range(1, len(gs) + 1)) AS i, unnest(gs) AS g FROM r WHERE len(gs) > 1),
b AS (SELECT id, name, i, 'part' || i AS key, 'Özel Uyarılar — Bölüm ' || i || '/' || total AS label, '[Başlık — Bölüm ' || i || '/' || total || ']' || chr(10) || chr(10) || '[Bağlam — Madde 4.4 girişi]: ' || intro || chr(10) || chr(10) || '--- Devam (Bölüm ' || i || '/' || total || ') ---' || chr(10) || g.t AS whole FROM s WHERE length(g.t) >= 50),
a AS (SELECT id, name, place, key, label, flags, sec, '[Başlık — ' || label || ']' || chr(10) || chr(10) || lead || '--- ' || label || ' ---' || chr(10) || own AS whole FROM f UNION ALL SELECT id, name, i, key, label, '', '4.4', whole FROM b)
SELECT id, key, label, flags, length(whole) AS size, md5(whole) AS digest, replace(name, ' ', '_') || '_' || replace(sec, '.', '_') || '_' || key || '_' || md5(name || '_' || sec || '_' || key || '_a.pdf')[1:10] AS chunk_id FROM a""")
def section_parts(t):
    """Parts by patient group of a section for each document, and its own lines, as paragraphs, in packed parts."""
    d = spread(t.documents.select("doc_id", "text")).select(_id("doc_id"), F.expr(GROUPS).alias("g"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("x"), F.concat(F.lit("ILAC "), F.col("doc_id").cast("string")).alias("name"))
    args = (F.lit("Başlık"), F.col("name"), F.lit("a.pdf"))
    none = F.array().cast(S.PART)
    both = F.concat(F.coalesce(S.group_parts(F.col("g"), *args), none), F.coalesce(S.packed_parts(F.col("x"), *args), none))
    d = d.select("id", F.explode_outer(both).alias("p")).where("p.key is not null")
    return d.select("id", "p.key", "p.label", F.array_join("p.flags", ",").alias("flags"), F.length("p.text").cast("long").alias("size"), F.md5("p.text").alias("digest"), "p.chunk_id")


_BOX = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"


@query("page_layouts", """WITH b AS (SELECT page_id, trim(regexp_replace(p, '<[^>]*>', ' ', 'g'))[1:40] AS text, (k * 37 % 5 * 20)::DOUBLE AS x, (k * 53 % 11 * 10 + k % 3)::DOUBLE AS y FROM (SELECT page_id, unnest(string_split(html, '<p>')) AS p, generate_subscripts(string_split(html, '<p>'), 1) - 1 AS k FROM pages)),
c AS (SELECT page_id, trim(text) AS text, x, y FROM b WHERE NOT (page_id % 2 = 0 AND y + 4 BETWEEN 20 AND 45) UNION ALL SELECT page_id, '| Ad | No |' || chr(10) || '| --- | --- |' || chr(10) || '| sayfa | ' || page_id || ' |', 0, 20 FROM pages WHERE page_id % 2 = 0)
SELECT page_id, md5(string_agg(text, chr(10) ORDER BY round(y / 5) * 5, x, text)) AS digest, count(*) AS blocks FROM c WHERE text <> '' GROUP BY 1""")
def page_layouts(t):
    """The paragraphs of a page as blocks in reading order, around a table on every other page."""
    text = lambda p: F.substring(F.trim(F.regexp_replace(p, "<[^>]*>", " ")), 1, 40)
    x, y = (lambda k: (k * 37 % 5 * 20).cast("double")), (lambda k: (k * 53 % 11 * 10 + k % 3).cast("double"))
    blocks = F.transform(F.split("html", "<p>"), lambda p, k: F.struct(x(k).alias("x0"), y(k).alias("y0"), (x(k) + 10).alias("x1"), (y(k) + 8).alias("y1"), text(p).alias("text")))
    rows = F.array(F.array(F.lit("Ad"), F.lit("No")), F.array(F.lit("sayfa"), F.col("page_id").cast("string")))
    box = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(100.0).alias("x1"), F.lit(45.0).alias("y1"), S.table_markdown(rows).alias("text")))
    d = t.pages.select("page_id", blocks.cast(_BOX).alias("b"), F.when(F.col("page_id") % 2 == 0, box).otherwise(F.array()).cast(_BOX).alias("t"))
    page = S.page_with_tables(F.col("b"), F.col("t"))
    d = d.select("page_id", page.alias("text"), (F.size(F.filter("b", lambda b: (F.trim(b["text"]) != "") & ((F.size("t") == 0) | ~(b["y0"] + 4).between(20, 45)))) + F.size("t")).cast("long").alias("blocks"))
    return d.select("page_id", F.md5("text").alias("digest"), "blocks")


# --- names --------------------------------------------------------------------------------------------------------------
_FIRST, _SECOND = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_LOOKED = f"CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN {_FIRST} WHEN 2 THEN lower(p_type) WHEN 3 THEN substring(p_name, 1, 3) || 'x' || substring(p_name, 4, 40) WHEN 4 THEN substring({_FIRST}, 2, 3) ELSE {_SECOND} || ' zzz' END"


@query("resolved_names")
def resolved_names(t):
    """Six tiers from the names that parts are looked for by to the entities of the part table."""
    known = R.registry(t.part.select(F.col("p_name").alias("name"), F.col("p_type").alias("ingredient"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("file")))
    got = R.resolved(t.part.select(F.expr(_LOOKED).alias("q")), known).join(known.select("entity", "name"), "entity")
    return got.select("q", "name", F.col("tier").cast("long").alias("tier"))


_WANTED = f"CASE p_partkey % 5 WHEN 0 THEN upper(p_name) || ' 0,5-MG' WHEN 1 THEN p_name || ' 0.5 - mg' WHEN 2 THEN substring(p_name, 2, 6) WHEN 3 THEN {_SECOND} || ' ' || {_FIRST} ELSE 'zz' || p_name END"
_NORM, _LOOSE = "upper(trim({}))", "regexp_replace(replace(upper(trim({})), ',', '.'), '\\s*-\\s*', '-', 'g')"


@query("canonical_names", f"""WITH n AS (SELECT DISTINCT p_name || ' 0,5-MG' AS name FROM part), q AS (SELECT DISTINCT {_WANTED} AS q FROM part),
h AS (SELECT q, name, CASE WHEN {_NORM.format('q')} = {_NORM.format('name')} THEN 1 WHEN {_LOOSE.format('q')} = {_LOOSE.format('name')} THEN 2 WHEN contains({_LOOSE.format('name')}, {_LOOSE.format('q')}) THEN 3 WHEN list_has_all(string_split({_LOOSE.format('name')}, ' '), string_split({_LOOSE.format('q')}, ' ')) THEN 4 END AS tier FROM q, n)
SELECT q, name, tier::BIGINT AS tier FROM h WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY q) UNION ALL SELECT q, q, 5 FROM q WHERE q NOT IN (SELECT q FROM h WHERE tier IS NOT NULL)""")
def canonical_names(t):
    """Five tiers from a wanted name for each part to the names of the corpus."""
    known = t.part.select(F.concat("p_name", F.lit(" 0,5-MG")).alias("name")).distinct()
    return R.canonical_names(t.part.select(F.expr(_WANTED).alias("q")), known).select("q", "name", F.col("tier").cast("long").alias("tier"))


_PROFILED = f"CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' extra' ELSE {_FIRST} || ' other' END"


@query("similar_profiles", f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT DISTINCT {_PROFILED} AS q FROM part),
h AS (SELECT q, name, CASE WHEN lower(q) = lower(name) THEN 1 WHEN contains(lower(q), lower(name)) OR contains(lower(name), lower(q)) THEN 2 WHEN split_part(lower(q), ' ', 1) = split_part(lower(name), ' ', 1) THEN 3 END AS tier FROM q, n)
SELECT q, name, tier::BIGINT AS tier FROM h WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY q)""")
def similar_profiles(t):
    """Three tiers from a query for each part to the table of profiles."""
    got = R.similar_names(t.part.select(F.expr(_PROFILED).alias("q")), t.part.select(F.col("p_name").alias("name")).distinct())
    return got.select("q", F.col("entity").alias("name"), F.col("tier").cast("long").alias("tier"))
