"""Planning of a search: kinds of a question, the sections to look into, and the enriched query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import patients as P

# --- Fixed values: patterns, sections and phrases that plans have to match --------------------------------------------
KINDS = {
    "etkilesim": (
        r"etkile[sş]im|beraber|kombinas|birlikte|yan\s+yana|ilave|ek\s+olarak|ile\s+kullan|birlikte\s+ver"
        r"|etki\s+nas[ıi]l\s+de[gğ]i[sş]|kan\s+d[üu]zeyi|plazma\s+d[üu]zeyi"
        r"|eklenirse|eklenebilir|eklendi[gğ]inde|ba[sş]lan[ıi]rsa|ba[sş]land[ıi][gğ][ıi]nda"
        r"|verili[rn]se|verildi[gğ]inde|[üu]zerine\s+etki|etkiler\s+mi"
        r"|nas[ıi]l\s+etkiler|ne\s+olur|ne\s+de[gğ]i[sş]|de[gğ]i[sş]tirir"
    ),
    "kontrendikasyon": (
        r"kontrendike|kullan[ıi]labilir\s+mi|verilir\s+mi|uygun\s+mu|yasak|sak[ıi]ncal[ıi]"
        r"|yaz[ıi]labilir\s+mi|kullan[ıi]l[ıi]r\s+m[ıi]|verilebilir\s+mi|verilmeli\s+mi"
        r"|kullanmal[ıi]\s+m[ıi]|reçete\s+edilebilir|kontrendike\s+mi"
        r"|ba[sş]lan[ıi]labilir\s+mi|ba[sş]lanabilir\s+mi|ba[sş]lan[ıi]r\s+m[ıi]"
        r"|ba[sş]lamal[ıi]\s+m[ıi]|ba[sş]lamak\s+uygun|ba[sş]lamas[ıi]\s+uygun"
        r"|endike\s+mi|endike\s+de[gğ]il|kullan[ıi]m[ıi]\s+uygun|alerjisi.*verilebilir|alerji.*kullan"
    ),
    "doz": r"doz|dozaj|pozoloji|kaç\s+(mg|tablet|kapsül|ml)|ne\s+kadar|miktar|doz\s+ayar|azalt|artır|düşür",
    "gebelik_laktasyon": r"gebelik|hamile|laktasyon|emzir|anne\s+sütü|trimester|gebelikte",
    "yan_etki": (
        r"yan\s+etki|advers|istenmeyen|reaksiyon|toksisite"
        r"|ba[sş]lad[ıi]|neden\s+olabilir|ilaca\s+ba[gğ]l[ıi]|ilactan\s+m[ıi]"
        r"|bu\s+ilaç.*m[ıi]|sebep\s+olur|yol\s+açar|ortaya\s+çıkt[ıi]"
        r"|şikayet|semptom.*ilaç|ilaç.*semptom"
        r"|enfeksiyon\s+riski|kanama\s+riski|ödem|hepatotoksisite|nefrotoksisite"
        r"|hipoglisemi|hiperglisemi|laktik\s+asidoz|nöropati|miyopati"
        r"|üriner|genitoüriner|mantar\s+enf|cilt\s+reaksiyon"
        r"|risk\s+hakkında|bu\s+ilaç.*risk|ilaç.*risk\s+ne|ne\s+(tür|gibi)\s+risk"
    ),
    "uyari": r"uyarı|önlem|dikkat|risk|tehlike|güvenlik",
    "doz_asimi": r"doz\s+aşım|toksik\s+doz|zehirlenme|overdoz",
}
GENERAL = "genel"
SECTIONS = {
    "etkilesim": ("4.5", "4.4"),
    "kontrendikasyon": ("4.3", "4.4"),
    "doz": ("4.2",),
    "gebelik_laktasyon": ("4.6", "4.3"),
    "yan_etki": ("4.8", "4.4"),
    "uyari": ("4.4", "4.3"),
    "doz_asimi": ("4.9",),
    GENERAL: ("4.3", "4.4", "4.5"),
}
ALWAYS = ("4.3", "4.4", "4.5")
SPECIAL = (
    r"feokromasitom|miyastenia\s*gravis|myasteni|parkinson|epilepsi|lupus|porfiri"
    r"|tirotoksikoz|hipertiroidi|hipotiroid|böbrek\s+ta[sş][ıi]|ürolitiyaz"
    r"|glokom|prostat|bph|üreme|çocuk\s+istememe|fertil"
    r"|alkol\s+ba[gğ][ıi]ml[ıi]|miyopati|rabdomiyoliz"
)
SIDE_EFFECT_TERMS = "yan etki istenmeyen etki advers reaksiyon güvenlilik profili"
SIDE_EFFECTS = (
    (r"üriner|idrar\s+yolu|mesane|genitoüriner", "üriner enfeksiyon genitoüriner idrar yolu"),
    (r"kanama|hemoraji|purpura|peteş", "kanama riski hemoraji"),
    (r"ödem|şişlik|periferik\s+ödem", "ödem periferik ödem sıvı tutulumu"),
    (r"karaciğer|hepatik|sarılık|transaminaz", "hepatotoksisite karaciğer enzim yüksekliği"),
    (r"kas\s+ağrı|miyalji|rabdomiyoliz", "miyopati rabdomiyoliz kas toksisitesi"),
    (r"mantar|kandida|fungal", "mantar enfeksiyonu kandida fungal"),
)
LAB_TERMS = (
    (("Kreatinin",), "yüksek", "böbrek fonksiyon bozukluğu kreatinin yüksek"),
    (("ALT", "AST"), "yüksek", "karaciğer enzim yüksekliği hepatotoksisite"),
    (("Bilirubin",), "yüksek", "karaciğer enzim yüksekliği bilirubin"),
    (("K",), "yüksek", "hiperkalemi potasyum yüksek"),
    (("K",), "kritik_düşük", "hipokalemi potasyum düşük"),
    (("INR",), "yüksek", "antikoagülan INR yüksek kanama riski"),
    (("HbA1c",), "yüksek", "diyabet glisemik kontrol bozuk"),
)
#: The abbreviations of a few words; the whole table is a parameter of expanded().
SYNONYMS = (
    (r"\bKBY\b", "kronik böbrek yetmezliği renal yetmezlik"),
    (r"\bABY\b", "akut böbrek yetmezliği renal yetmezlik"),
    (r"\bAKI\b", "akut böbrek hasarı renal yetmezlik"),
    (r"\beGFR\b", "tahmini GFR glomerüler filtrasyon böbrek"),
    (r"\bCrCl\b", "kreatinin klerensi böbrek fonksiyonu"),
    (r"\bKHY\b|\bKCY\b", "karaciğer yetmezliği hepatik yetmezlik"),
    (r"kc\s*yet", "karaciğer yetmezliği hepatik"),
    (r"\bKY\b", "kalp yetmezliği kardiyak yetmezlik"),
    (r"\bAF\b", "atriyal fibrilasyon aritmisi"),
    (r"\bKAH\b", "koroner arter hastalığı iskemik kalp"),
)
# --- End of fixed values ---------------------------------------------------------------------------------------------


def _any(pattern: str) -> str:
    return f"(?iuU){pattern}"


def expanded(question: Column, synonyms=SYNONYMS) -> Column:
    """question, and behind it the terms of every abbreviation that it has, in the order of synonyms (pattern, terms)."""
    return F.concat_ws(" ", question, *[F.when(question.rlike(_any(p)), t) for p, t in synonyms])


def question_kinds(question: Column, profile: Column | None = None) -> Column:
    """The kinds that the question has words for (pregnancy also by the profile), in their order; none: general."""
    tests = {k: question.rlike(_any(p)) for k, p in KINDS.items()}
    if profile is not None:
        tests["gebelik_laktasyon"] = tests["gebelik_laktasyon"] | F.coalesce(profile["pregnant"], F.lit(False)) | F.coalesce(profile["nursing"], F.lit(False))
    found = F.array_compact(F.array(*[F.when(t, k) for k, t in tests.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(GENERAL)))


def sections_for(kinds: Column, profile: Column | None = None, question: Column | None = None) -> Column:
    """Sections by priority, each once: those of the kinds, those that always count, those of the profile. A special
    condition in the question puts 4.4 first."""
    of = F.lit(None).cast("array<string>")
    array = lambda names: F.array(*map(F.lit, names))

    def sections(kind: Column) -> Column:
        out = of
        for k, names in SECTIONS.items():
            out = F.when(kind == k, array(names)).otherwise(out)
        return out

    parts = [F.flatten(F.transform(kinds, sections)), array(ALWAYS)]
    if profile is not None:
        either = F.coalesce(profile["pregnant"], F.lit(False)) | F.coalesce(profile["nursing"], F.lit(False))
        none = F.array().cast("array<string>")
        for test, names in ((P.renal(profile), ("4.2", "4.4")), (P.hepatic(profile), ("4.2", "4.4")), (either, ("4.6",)), (P.geriatric(profile), ("4.2",))):
            parts.append(F.when(test, array(names)).otherwise(none))
    out = F.array_distinct(F.concat(*parts))
    if question is None:
        return out
    return F.when(question.rlike(_any(SPECIAL)), F.concat(array(("4.4",)), F.array_remove(out, "4.4"))).otherwise(out)


def _is_one(names: tuple[str, ...], status: str):
    return lambda r: r["name"].isin(*names) & r["status"].contains(status)


def enriched(question: Column, kinds: Column, profile: Column) -> Column:
    """question and what the profile, side effects, special conditions and the most important abnormal value add to it."""
    p, number = profile, lambda c: c.cast("string")
    has = lambda k: F.array_contains(kinds, k)
    side = F.lit(None).cast("string")
    for pattern, terms in reversed(SIDE_EFFECTS):
        side = F.when(question.rlike(_any(pattern)), terms).otherwise(side)
    lab, abnormal = F.lit(None).cast("string"), P.abnormal_labs(p["labs"])
    for names, status, terms in reversed(LAB_TERMS):
        hit = F.coalesce(F.exists(abnormal, _is_one(names, status)), F.lit(False))
        lab = F.when(hit, terms).otherwise(lab)
    special = F.regexp_extract(question, _any(f"({SPECIAL})"), 1)
    return F.concat_ws(
        " ",
        question,
        F.when(P.renal(p), F.concat(F.lit("böbrek yetmezliği GFR "), number(p["gfr"]))),
        F.when(P.hepatic(p), F.concat(F.lit("karaciğer yetmezliği Child-Pugh "), p["child_pugh"])),
        F.when(P.geriatric(p), F.concat(F.lit("geriyatrik yaşlı hasta "), number(F.coalesce(p["age"], F.lit(0))), F.lit(" yaş"))),
        F.when(P.pediatric(p), F.concat(F.lit("pediyatrik çocuk hasta "), number(F.coalesce(p["age"], F.lit(0))), F.lit(" yaş"))),
        F.when(p["pregnant"], "gebelik hamile"),
        F.when(p["nursing"], "laktasyon emzirme"),
        F.when((F.size(p["drugs"]) > 0) & has("etkilesim"), F.concat(F.lit("ilaç etkileşimi "), F.array_join(F.slice(p["drugs"], 1, 3), " "))),
        F.when(has("yan_etki"), SIDE_EFFECT_TERMS),
        F.when(has("yan_etki"), side),
        F.when(special != "", F.concat(F.lit("özel kullanım uyarısı "), special, F.lit(" dikkatli kullanım"))),
        F.when(has("doz") | has("kontrendikasyon"), lab),
    )


def search_plans(asked: DataFrame, synonyms=SYNONYMS, n_results: int = 5) -> DataFrame:
    """One row per question and target (name null where none is given): kinds, sections, flags, query, summary and
    n_results. asked: question, profile, targets (array of names or null), and columns that stay."""
    d = asked.withColumn("expanded", expanded(F.col("question"), synonyms))
    d = d.withColumn("kinds", question_kinds(F.col("expanded"), F.col("profile")))
    d = d.select(
        "*", sections_for(F.col("kinds"), F.col("profile"), F.col("question")).alias("sections"), P.active_flags(F.col("profile")).alias("flags"), enriched(F.col("expanded"), F.col("kinds"), F.col("profile")).alias("query"), P.summary(F.col("profile")).alias("summary"), F.lit(n_results).alias("n_results"),
    )
    return d.withColumn("name", F.explode_outer("targets")).drop("expanded", "targets")
