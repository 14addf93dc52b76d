"""A patient's context out of free text, and the names of a list that a text speaks of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let

_NAME = r"[\wçğıöşüÇĞİÖŞÜ][\wçğıöşüÇĞİÖŞÜ\-]{2,}"
_NAMES = rf"({_NAME}(?:\s+{_NAME})?)"

# --- Fixed values: patterns and words that results have to match -------------------------------------------------------
AGE, WEIGHT, GFR = r"(\d{1,3})\s*yaş", r"(\d{2,3}(?:\.\d+)?)\s*kg", r"e?g[fF][rR]\s*[=:;]?\s*(\d{1,3}(?:\.\d+)?)"
MALE, FEMALE = r"\berkek\b", r"\bkad[ıi]n\b|\bbayan\b"
RENAL = (
    r"böbrek\s+yetmezli[gğ]i|renal\s+yetmezlik|kronik\s+böbrek|\bKBH\b|\bCKD\b|hemodiyaliz|periton\s+diyalizi|\bdiyaliz\b|"
    r"böbrek\s+nakli|renal\s+transplant"
)
HEPATIC = (
    r"karaci[gğ]er\s+yetmezli[gğ]i|hepatik\s+yetmezlik|siroz|karaci[gğ]er\s+sirozlu|hepatit\s*[ABC]|kronik\s+hepatit|"
    r"non.alkolik\s+ya[gğ]l[ıi]\s+karaci[gğ]er|NASH|karaci[gğ]er\s+nakli|hepatik\s+ensefalopati"
)
CHILD_PUGH, PREGNANT, NURSING = r"child[-\s]pugh\s+([abc])", r"gebe[ck]|hamile|gebelik|\bG[123]\b", r"emzir"
PEDIATRIC, GERIATRIC = r"pediatrik|pediyatrik|çocuk\s+hasta|bebek|\bneonatal\b", r"geriyatrik|geriatrik|yaşlı\s+hasta"
LABS = {
    "ALT": r"ALT\s*[=:;]?\s*(\d+(?:\.\d+)?)",
    "AST": r"AST\s*[=:;]?\s*(\d+(?:\.\d+)?)",
    "INR": r"INR\s*[=:;]?\s*(\d+(?:\.\d+)?)",
    "K": r"\bK\+?\s*[=:;]?\s*(\d+(?:\.\d+)?)",
    "Na": r"\bNa\+?\s*[=:;]?\s*(\d+(?:\.\d+)?)",
    "Kreatinin": r"kreatinin\s*[=:;]?\s*(\d+(?:\.\d+)?)",
    "HbA1c": r"HbA1c\s*[=:;]?\s*(\d+(?:\.\d+)?)",
    "Hemoglobin": r"hemoglobin\s*[=:;]?\s*(\d+(?:\.\d+)?)",
    "Bilirubin": r"bilirubin\s*[=:;]?\s*(\d+(?:\.\d+)?)",
    "Trombosit": r"trombosit\s*[=:;]?\s*(\d+(?:\.\d+)?)",
}
ASKS = (
    r"(?:yazabilir\s+m[ıi]|verilebilir\s+m[ıi]|kullan[ıi]labilir\s+m[ıi]|ba[sş]lanabilir\s+m[ıi]"
    r"|uygun\s+m[ıi]|kontrendike\s+m[ıi]|yazmal[ıi]\s+m[ıi]|verilmeli\s+m[ıi]"
    r"|reçete\s+edebilir\s+m[ıi]|nas[ıi]l\s+etkiler|ne\s+olur|etkile[sş]im\s+var\s+m[ıi]"
    r"|eklemek\s+istiyorum|ekleyebilir\s+m[ıi]"
    r"|ba[sş]lamay[ıi]\s+d[uü][sş][uü]n[uü]yorum|vermeyi\s+d[uü][sş][uü]n[uü]yorum"
    r"|yazmay[ıi]\s+d[uü][sş][uü]n[uü]yorum|yazmak\s+istiyorum|vermek\s+istiyorum"
    r"|ba[sş]lamak\s+istiyorum|önerir\s+misiniz|önerebilir\s+m[ıi]"
    r"|sordu|soruldu|istedi|talep\s+etti|ba[sş]vurdu)"
)
TARGET = (
    rf"\b{_NAMES}\s+(?:yazabilir|verilebilir|kullan[ıi]labilir|ba[sş]lanabilir|verilmeli|kontrendike|uygun\s+mu|yaz[ıi]labilir|"
    r"eklemek\s+istiyorum|ekleyebilir|ba[sş]lamay[ıi]\s+d[uü][sş][uü]n[uü]yorum|"
    r"vermeyi\s+d[uü][sş][uü]n[uü]yorum|yazmay[ıi]\s+d[uü][sş][uü]n[uü]yorum|"
    r"yazmak\s+istiyorum|vermek\s+istiyorum|ba[sş]lamak\s+istiyorum|sordu|soruldu|istedi|talep\s+etti|ba[sş]vurdu)"
)
FOR_TARGET = (
    rf"\b{_NAMES}\s+için\s+{_NAMES}\s+(?:eklemek|yazmak|vermek|ba[sş]lamak|reçete|öner(?:mek)?|"
    r"sordu|istedi|talep|ba[sş]vurdu|istiyorum|isteniyor)"
)
CURRENT = (
    r"\b([\wçğıöşüÇĞİÖŞÜ][\wçğıöşüÇĞİÖŞÜ\-]{3,}(?:\s+[\wçğıöşüÇĞİÖŞÜ][\wçğıöşüÇĞİÖŞÜ\-]{2,})?)"
    r"\s+(?:kullan[ıi]yor|al[ıi]yor|kullan[ıi]mda|tedavisinde|kullan[ıi]lmakta|kullanmakta|almakta|kullanmaktad[ıi]r|almaktad[ıi]r|"
    r"kulland[ıi][gğ][ıi]|ald[ıi][gğ][ıi]|kullan[ıi]yor\s+olup|al[ıi]yor\s+olup|kullan[ıi]m[ıi]nda|tedavisindeyken)"
)
CURRENT_LIST = (
    r"(?:mevcut\s+ilaçlar[ıi]?|kulland[ıi][gğ][ıi]\s+ilaçlar[ıi]?|düzenli\s+ilaçlar[ıi]?|kronik\s+ilaçlar[ıi]?|ilaç\s+listesi)"
    r"\s*[:\-–]?\s*([^.!?\n]{3,150})"
)
ALLERGY = (
    rf"\b{_NAMES}(?:['e'a'ye'ya]|\s+)(?:alerjisi\s+(?:var|olan|mevcut|bulunuyor)|karş[ıi]\s+alerjik|alerjik|"
    r"aş[ıi]r[ıi]\s+duyarl[ıi]l[ıi][gğ][ıi]|hipersensitivitesi)"
)
NO_NAMES = [
    "hastaya", "buna", "ona", "bu", "o", "birlikte", "ile", "hasta", "yani", "sadece", "birde", "ayrıca", "ayrica", "yeni", "hemen",
    "gunluk", "günlük", "doz", "sabah", "aksam", "akşam", "gece", "için", "icin", "ile", "veya", "ya", "de", "da", "ve",
    "tedavi", "tedavisi", "nedeni", "sebebi", "amacı", "amaci",
]
DIAGNOSES = (
    (r"akut\s+miyokard\s+enfarktüsü|akut\s+mi\b|STEMI|NSTEMI|kalp\s+krizi|miyokard\s+enfarktüsü", "Akut miyokard enfarktüsü"),
    (r"atriyal\s+fibrilasyon|\bAF\b", "Atriyal fibrilasyon"),
    (r"tip\s*[12]\s*diyabet|diyabet(?:es)?|\bDM\b|diabetes\s+mellitus", "Diyabet"),
    (r"hipertansiyon|\bHT\b|hipertansif|yüksek\s+tansiyon", "Hipertansiyon"),
    (r"kalp\s+yetmezli[gğ]i|konjestif\s+kalp|kardiyak\s+yetmezlik", "Kalp yetmezliği"),
    (r"romatoid\s+artrit|\bRA\b", "Romatoid artrit"),
    (r"\bepileps[iy]\b|n[oö]bet\s+hastal", "Epilepsi"),
    (r"\bmigren\b", "Migren"),
    (r"\bKOAH\b|kronik\s+obstrüktif\s+akci[gğ]er", "KOAH"),
    (r"hipotiroid[iy]|hipertiroid[iy]|tiroid\s+hastal", "Tiroid hastalığı"),
    (r"koroner\s+arter\s+hastal|\bKAH\b", "Koroner arter hastalığı"),
    (r"\bosteoporoz\b", "Osteoporoz"),
    (r"\bdepresyon\b|major\s+depresif", "Depresyon"),
    (r"\banksiyete\b|anksiyete\s+bozuklu", "Anksiyete"),
    (r"\bParkinson\b", "Parkinson hastalığı"),
    (r"\bAlzheimer\b|\bdemans\b", "Demans"),
    (r"\bastım\b", "Astım"),
    (r"ülseratif\s+kolit|\bCrohn\b", "İnflamatuvar bağırsak hastalığı"),
    (r"\bgut\s+(?:artriti?|hastal)|\bgut\b(?=\s+(?:tanı|hasta|nedeniy))", "Gut"),
    (r"erektil\s+disfonksiyon|\bED\b(?=\s+(?:tanı|için|nedeniy))", "Erektil disfonksiyon"),
    (r"kronik\s+böbrek\s+hastal|\bKBH\b|\bCKD\b", "Kronik böbrek hastalığı"),
    (r"\bhiperlipidemi\b|\bdislipidemi\b|\byüksek\s+kolesterol\b", "Hiperlipidemi"),
    (r"\bstent\b|\bkoroner\s+stent\b|\bbypass\b", "Koroner revaskülarizasyon öyküsü"),
    (r"\binme\b|\bSVO\b|\biskemik\s+inme\b|\bstroke\b", "İnme öyküsü"),
    (r"\bpulmoner\s+emboli\b|\bPE\b(?=\s+(?:tanı|öykü|geçir))", "Pulmoner emboli"),
    (r"derin\s+ven\s+trombozu|\bDVT\b", "Derin ven trombozu"),
    (r"\bpnömoni\b|\bzatürre\b", "Pnömoni"),
    (r"\bsepsis\b", "Sepsis"),
)
# --- End of fixed values ---------------------------------------------------------------------------------------------


def _i(pattern: str) -> str:
    return f"(?iuU){pattern}"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return let(F.regexp_extract(text, _i(pattern), group), lambda got: F.when(got != "", got))


def bare_name(name: Column) -> Column:
    """name without the leading words that are no names; null where nothing is left."""

    def bare(words: Column) -> Column:
        first = F.get(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda k: ~F.lower(F.get(words, k)).isin(NO_NAMES)), F.lit(0))
        return let(first, lambda k: F.when(k.isNotNull(), F.array_join(F.slice(words, k + 1, F.size(words)), " ")))

    return let(F.split(F.trim(name), r"\s+"), bare)


def _all(text: Column, pattern: str) -> Column:
    names = F.transform(F.regexp_extract_all(text, F.lit(_i(pattern)), F.lit(1)), bare_name)
    return F.filter(names, lambda n: n.isNotNull())


def context(text: Column) -> Column:
    """Struct of what a text says of a patient: age (1 to 119), sex, weight (11 to 299), gfr, renal, hepatic, child_pugh,
    pregnant, nursing, pediatric, geriatric, labs, diagnoses, allergies, target, current (drugs), question (the sentences
    that ask, else the text). Each pattern is looked for once; take the struct as a column before its fields."""
    said = lambda p: text.rlike(_i(p))
    diagnoses = F.array_compact(F.array(*[F.when(said(p), name) for p, name in DIAGNOSES]))
    target = F.coalesce(bare_name(_first(text, FOR_TARGET, 2)), bare_name(_first(text, TARGET)))
    found = F.struct(
        text.alias("text"), _first(text, AGE).cast("int").alias("age"), _first(text, WEIGHT).cast("double").alias("weight"), _first(text, GFR).cast("double").alias("gfr"),
        diagnoses.alias("diagnoses"), target.alias("target"), F.trim(_first(text, FOR_TARGET)).alias("reason"),
    )
    return let(found, _context)


def _context(found: Column) -> Column:
    text, weight, gfr, diagnoses, target, reason = (found[c] for c in ("text", "weight", "gfr", "diagnoses", "target", "reason"))
    age = F.when((found["age"] > 0) & (found["age"] < 120), found["age"])
    said = lambda p: text.rlike(_i(p))
    no = lambda c: F.coalesce(c, F.lit(False))
    labs = F.array(*[F.struct(F.lit(k).alias("key"), _first(text, p).cast("double").alias("value")) for k, p in LABS.items()])
    known = F.exists(diagnoses, lambda d: F.lower(d).contains(F.lower(reason)) | F.lower(reason).contains(F.lower(d)))
    reason = F.when((F.length(reason) > 2) & ~known, F.concat(F.upper(F.substring(reason, 1, 1)), F.lower(F.substring(reason, F.lit(2), F.length(reason)))))
    listed = F.filter(F.transform(F.split(_first(text, CURRENT_LIST), r",|\bve\b"), lambda n: bare_name(F.rtrim(F.trim(n), F.lit(".,")))), lambda n: F.length(n) > 2)
    current = F.concat(_all(text, CURRENT), F.coalesce(listed, F.array().cast("array<string>")))
    current = F.filter(current, lambda n: target.isNull() | (F.lower(n) != F.lower(target)))
    asks = F.regexp_extract_all(text, F.lit(r"[^.!?]*\?"), F.lit(0))
    return F.struct(
        age.alias("age"), F.when(said(MALE), "erkek").when(said(FEMALE), "kadın").alias("sex"), F.when((weight > 10) & (weight < 300), weight).alias("weight"), gfr.alias("gfr"),
        (no(gfr < 60) | said(RENAL)).alias("renal"), said(HEPATIC).alias("hepatic"), F.upper(_first(text, CHILD_PUGH)).alias("child_pugh"),
        said(PREGNANT).alias("pregnant"), said(NURSING).alias("nursing"), let(age, lambda n: no(n < 18) | said(PEDIATRIC)).alias("pediatric"), let(age, lambda n: no(n >= 65) | said(GERIATRIC)).alias("geriatric"),
        F.map_from_entries(F.filter(labs, lambda e: e["value"].isNotNull())).alias("labs"), F.array_compact(F.concat(diagnoses, F.array(reason))).alias("diagnoses"),
        F.array_distinct(F.filter(_all(text, ALLERGY), lambda n: F.length(n) > 2)).alias("allergies"), target.alias("target"), F.array_distinct(current).alias("current"),
        let(asks, lambda a: F.when(F.size(a) > 0, F.trim(F.array_join(a, " "))).otherwise(text)).alias("question"),
    )


def folded(c: Column) -> Column:
    """Upper case, Turkish letters as ASCII."""
    return F.translate(F.upper(c), "İĞŞÇÜÖ", "IGSCUO")


def names_in_text(texts: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, name, at (place of the first word that is one of the name's first three, of five letters or more), asked (place
    where the text asks something, else its length), target: of the names before that place the last one, else the first
    after it. names: name. Words are joined by equality; the names are not broadcast."""
    word = F.explode(F.slice(F.split("name", r"\s+"), 1, 3)).alias("w")
    keys = names.select("name", word).select("name", folded(F.col("w")).alias("w")).where("length(w) >= 5 and not w rlike '^[0-9]'").distinct()
    t = texts.select(id_col, folded(F.col(text_col)).alias("t"), F.col(text_col).alias("raw"))
    asked = F.when(F.col("raw").rlike(_i(ASKS)), F.length(F.get(F.split("raw", _i(ASKS)), F.lit(0)))).otherwise(F.length("raw"))
    t = t.select(id_col, asked.alias("asked"), "t", F.explode(F.array_distinct(F.filter(F.split("t", r"(?U)[^\w]+"), lambda x: F.length(x) >= 5))).alias("w"))
    hits = t.join(keys, "w").select(id_col, "name", F.expr("locate(w, t) - 1").alias("at"), "asked")
    hits = hits.groupBy(id_col, "name").agg(F.min("at").alias("at"), F.first("asked").alias("asked"))
    best = hits.groupBy(id_col).agg(F.max(F.when(F.col("at") < F.col("asked"), F.struct(F.col("at"), F.col("name")))).alias("before"), F.min(F.when(F.col("at") >= F.col("asked"), F.struct("at", "name"))).alias("after"))
    return hits.join(best, id_col).select(id_col, "name", "at", "asked", (F.col("name") == F.coalesce("before.name", "after.name")).alias("target"))
