"""Columns of patient profiles: laboratory values, stages, flags and summaries.

A profile is a struct of age, sex, weight, gfr, child_pugh, drugs, allergies, indications, pregnant, nursing, labs
(map<string,double>), notes, and two flags that may override what the age says (PROFILE). Missing fields are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROFILE = (
    "struct<age:int,sex:string,weight:double,gfr:double,child_pugh:string,drugs:array<string>,allergies:array<string>,"
    "indications:array<string>,pregnant:boolean,nursing:boolean,labs:map<string,double>,notes:string,pediatric:boolean,geriatric:boolean>"
)

# --- Fixed values: limits, units, flags and labels that results have to match ------------------------------------------
#: name: (upper normal limit, its critical multiple, critical from above, critical from below, unit, flag)
LAB_LIMITS = {
    "ALT": (40, 3, None, None, "U/L", "hepatic"),
    "AST": (40, 3, None, None, "U/L", "hepatic"),
    "GGT": (60, 3, None, None, "U/L", "hepatic"),
    "ALP": (120, 3, None, None, "U/L", "hepatic"),
    "Kreatinin": (None, None, 1.5, None, "mg/dL", "renal"),
    "K": (None, None, 5.5, 3.5, "mEq/L", None),
    "Na": (None, None, 150, 130, "mEq/L", None),
    "INR": (None, None, 2.5, None, "", None),
    "HbA1c": (None, None, 9.0, None, "%", None),
    "Hemoglobin": (None, None, None, 8.0, "g/dL", None),
    "Trombosit": (None, None, None, 50, "x10³/µL", None),
    "Bilirubin": (None, None, 2.0, None, "mg/dL", "hepatic"),
}
UNKNOWN, NORMAL, HIGH, CRITICAL_HIGH, CRITICAL_LOW = "bilinmiyor", "normal", "yüksek", "kritik_yüksek", "kritik_düşük"
ARROWS = {HIGH: "↑", CRITICAL_HIGH: "↑↑ KRİTİK", CRITICAL_LOW: "↓↓ KRİTİK"}
STAGES = (
    (90, "Evre 1 (G1, GFR ≥90)"),
    (60, "Evre 2 (G2, GFR 60-89)"),
    (45, "Evre 3a (G3a, GFR 45-59)"),
    (30, "Evre 3b (G3b, GFR 30-44)"),
    (15, "Evre 4 (G4, GFR 15-29)"),
)
LAST_STAGE = "Evre 5 (G5, GFR <15 — terminal dönem)"
RELEVANT = {
    "renal": (("4.2", "4.3"), ("böbrek", "renal", "gfr", "kreatinin", "klirens", "diyaliz", "clcr", "egfr")),
    "hepatic": (("4.2", "4.3"), ("karaciğer", "hepatik", "child-pugh", "siroz", "hepatik", "bilirubin")),
    "geriatric": (("4.2",), ("yaşlı", "geriyatrik", "65 yaş", "ileri yaş", "yaşlılarda")),
}
# --- End of fixed values ---------------------------------------------------------------------------------------------


def lab_status(name: Column, value: Column) -> Column:
    """The label of a value: multiples of the upper limit for enzymes, else inclusive critical limits; unknown names."""
    out = F.lit(UNKNOWN)
    for lab, (upper, times, above, below, _, _) in LAB_LIMITS.items():
        if times is not None:
            label = F.when(value >= upper * times, CRITICAL_HIGH).when(value > upper, HIGH).otherwise(NORMAL)
        else:
            label = F.lit(NORMAL)
            if below is not None:
                label = F.when(value <= below, CRITICAL_LOW).otherwise(label)
            if above is not None:
                label = F.when(value >= above, CRITICAL_HIGH).otherwise(label)
        out = F.when(name == lab, label).otherwise(out)
    return out


def _of_lab(name: Column, which: int) -> Column:
    out = F.lit("" if which == 4 else None).cast("string")
    for lab, limits in LAB_LIMITS.items():
        out = F.when(name == lab, F.lit(limits[which])).otherwise(out)
    return out


def abnormal_labs(labs: Column) -> Column:
    """Array of (name, value, unit, status) of the values that are neither normal nor unknown, in the order of the map."""
    rows = F.transform(F.map_entries(labs), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"), _of_lab(e["key"], 4).alias("unit"), lab_status(e["key"], e["value"]).alias("status")))
    return F.filter(rows, lambda r: ~r["status"].isin(NORMAL, UNKNOWN))


def kidney_stage(gfr: Column) -> Column:
    out = F.lit(LAST_STAGE)
    for least, label in reversed(STAGES):
        out = F.when(gfr >= least, label).otherwise(out)
    return F.when(gfr.isNull(), UNKNOWN).otherwise(out)


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def renal(p: Column) -> Column:
    return _no(p["gfr"] < 60)


def hepatic(p: Column) -> Column:
    return _no(p["child_pugh"].isin("B", "C"))


def pediatric(p: Column) -> Column:
    return F.coalesce(p["pediatric"], F.coalesce(p["age"], F.lit(0)) < 18)


def geriatric(p: Column) -> Column:
    return F.coalesce(p["geriatric"], F.coalesce(p["age"], F.lit(0)) >= 65)


def active_flags(p: Column) -> Column:
    """Flags of the profile, then those of its abnormal values, each once."""
    own = F.array(*[F.when(c, f) for c, f in ((renal(p), "renal"), (hepatic(p), "hepatic"), (pediatric(p), "pediatric"), (geriatric(p), "geriatric"))])
    labs = F.coalesce(F.transform(abnormal_labs(p["labs"]), lambda r: _of_lab(r["name"], 5)), F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.concat(own, labs)))


def flag_is_relevant(flag: str, chunks: Column) -> Column:
    """Whether a chunk of the flag's sections has one of its words; unknown flags are relevant."""
    if flag not in RELEVANT:
        return F.lit(True)
    sections, words = RELEVANT[flag]
    has = lambda c: F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(c["text"]).contains(w))
    return F.coalesce(F.exists(chunks, lambda c: c["section"].isin(*sections) & has(c)), F.lit(False))


def _number(c: Column) -> Column:
    return c.cast("string")


def _listed(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, ", ")))


def summary(p: Column) -> Column:
    """The profile in lines; what isn't known is left out."""
    labs = F.transform(F.map_entries(p["labs"]), lambda e: _lab_line(e["key"], e["value"]))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Yaş: "), _number(F.coalesce(p["age"], F.lit(0))), F.lit(", Cinsiyet: "), F.coalesce(p["sex"], F.lit("belirtilmemiş"))),
        F.when(p["gfr"].isNull(), "Böbrek fonksiyonu: bilinmiyor").otherwise(F.concat(F.lit("Böbrek fonksiyonu: GFR="), _number(p["gfr"]), F.lit(" mL/dak/1.73m² ("), kidney_stage(p["gfr"]), F.lit(")"))),
        F.concat(F.lit("Karaciğer fonksiyonu: Child-Pugh "), p["child_pugh"]),
        F.when(_no(p["pregnant"]), "Durum: GEBELİK"),
        F.when(_no(p["nursing"]), "Durum: EMZİRİYOR"),
        _listed("Mevcut ilaçlar: ", p["drugs"]),
        _listed("Alerjiler: ", p["allergies"]),
        _listed("Tanılar: ", p["indications"]),
        F.when(F.size(p["labs"]) > 0, F.concat(F.lit("Laboratuvar: "), F.array_join(labs, " | "))),
        F.when(p["notes"] != "", F.concat(F.lit("Notlar: "), p["notes"])),
    )


def _lab_line(name: Column, value: Column) -> Column:
    status, arrow = lab_status(name, value), F.lit("")
    for label, sign in ARROWS.items():
        arrow = F.when(status == label, sign).otherwise(arrow)
    return F.trim(F.concat(name, F.lit(": "), _number(value), F.lit(" "), _of_lab(name, 4), F.lit(" "), arrow))


def summary_for(p: Column, chunks: Column) -> Column:
    """The profile in lines, without stress on what the chunks have nothing about."""
    stage = F.concat(F.lit("Böbrek fonksiyonu: GFR="), _number(p["gfr"]), F.lit(" mL/dak/1.73m² ("))
    kidney = F.when(renal(p) & flag_is_relevant("renal", chunks), F.concat(stage, kidney_stage(p["gfr"]), F.lit(")")))
    kidney = kidney.when(renal(p), F.concat(stage, F.lit("Bu ilaç için KÜB'de özel renal kısıt belirtilmemiştir)"))).when(p["gfr"].isNotNull(), F.concat(stage, F.lit("normal sınırlar)")))
    liver = F.concat(F.lit("Karaciğer fonksiyonu: Child-Pugh "), p["child_pugh"], F.when(hepatic(p) & ~flag_is_relevant("hepatic", chunks), " (Bu ilaç için KÜB'de özel hepatik kısıt belirtilmemiştir)").otherwise(""))
    labs = F.transform(abnormal_labs(p["labs"]), lambda r: F.concat(r["name"], F.lit("="), _number(r["value"]), F.lit(" "), r["unit"], F.lit(" ("), r["status"], F.lit(")")))
    age = F.when(p["age"] > 0, _number(p["age"])).otherwise("belirtilmemiş")
    old = geriatric(p) & (p["age"] >= 65) & flag_is_relevant("geriatric", chunks)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Yaş: "), age, F.lit(", Cinsiyet: "), F.coalesce(F.when(p["sex"] != "", p["sex"]), F.lit("belirtilmemiş"))),
        kidney,
        liver,
        F.when(_no(p["pregnant"]), "Durum: GEBELİK"),
        F.when(_no(p["nursing"]), "Durum: EMZİRİYOR"),
        _listed("Mevcut ilaçlar: ", p["drugs"]),
        _listed("Alerjiler: ", p["allergies"]),
        _listed("Endikasyonlar: ", p["indications"]),
        F.concat(F.lit("Kilo: "), _number(p["weight"]), F.lit(" kg")),
        F.when(F.size(labs) > 0, F.concat(F.lit("Anormal lab değerleri: "), F.array_join(labs, ", "))),
        F.when(old, F.concat(F.lit("Not: Geriyatrik hasta ("), _number(p["age"]), F.lit(" yaş) — geriyatrik doz titrasyon değerlendirmesi gerekebilir"))),
        F.when(p["notes"] != "", F.concat(F.lit("Ek notlar: "), p["notes"])),
    )
