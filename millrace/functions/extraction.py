"""Facts out of section texts: severities, conditions, names, dose limits, enzyme roles, categories. All are column
expressions; where the place of a match counts, matches() gives it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: words and patterns that results have to match -------------------------------------------------------
SEVERITIES = (
    ("contraindicated", [
        "kontrendike", "kontrendikedir", "kullanılmamalıdır", "verilmemelidir", "kullanılması önerilmez", "kesinlikle önerilmez",
        "birlikte kullanımından kaçınılmalıdır", "birlikte kullanılmamalıdır", "birlikte verilmemelidir",
    ]),
    ("severe", [
        "ciddi etkileşim", "hayatı tehdit", "ölümcül", "tehlikeli kombinasyon", "şiddetli", "yoğun bakım", "kardiyak arrest",
        "serotonin sendromu", "kanama riski önemli ölçüde artar", "ciddi kanama",
    ]),
    ("moderate", [
        "dikkatli olunmalıdır", "dikkatli kullanılmalıdır", "dikkatle kullanılmalıdır", "yakın izlem", "yakından izlenmelidir",
        "doz ayarı gerekebilir", "doz azaltılmalıdır", "doz düzenlemesi", "yakın takip", "kan düzeyi izlenmelidir", "düzeyi artabilir",
        "düzeyi azalabilir", "etkisi artabilir", "etkisi azalabilir", "etkisi güçlenebilir", "etkisi potansiyalize",
        "biyoyararlanımı artar", "biyoyararlanımı azalır", "konsantrasyonu artabilir", "konsantrasyonu azalabilir",
    ]),
    ("mild", [
        "klinik önemi sınırlı", "klinik açıdan önemsiz", "minimal etkileşim", "önemsiz etkileşim", "hafif düzeyde", "hafif artış",
        "klinik önemi bilinmemektedir",
    ]),
)
MENTION = (
    r"\b([A-ZÇĞİÖŞÜ][a-zA-ZçğışöüÇĞİÖŞÜ]{4,}(?:[\s-][A-Za-zçğışöüÇĞİÖŞÜ]{5,})?)"
    r"(?=\s+(?:ile|birlikte|etkileşim|inhibitör|antagonist)\b)"
)
NO_MENTIONS = [
    "etkileşim", "etkileşimler", "etkileşimde", "etkileşimi", "inhibisyonu", "inhibisyon", "indüksiyonu", "indüksiyon", "bitkisel",
    "enzim", "mekanizma", "mekanizmayla", "tıbbi", "ürünler", "yoluyla", "potansiyel", "klinik", "sistemik", "metabolizma", "plazma",
    "konsantrasyon", "biyoyararlanım", "absorbsiyon", "birlikte", "kullanımı", "kullanımda", "kullanılması", "uygulanması",
    "uygulanırken", "tedavisinde", "hastalarda", "kombinasyonu", "kombinasyonunda", "eşzamanlı", "önerilmez", "önerilmemektedir",
    "bildirilmiştir", "artırabilir", "azaltabilir", "değiştirebilir", "etkileyebilir",
]
CONDITION = (
    r"(böbrek\s+yetmezli[gğ]i|karaci[gğ]er\s+yetmezli[gğ]i|gebelik|laktasyon"
    r"|penisilin\s+alerjisi|hipersensitivite|hipertansiyon|diyabet"
    r"|pediyatrik|geriyatrik|[a-zçğışöüA-Z]+\s+alerjisi"
    r"|aktif\s+(?:mide\s+(?:veya\s+bağırsak\s+)?)?ülseri?|peptik\s+ülseri?|gastrointestinal\s+kanam[aı]"
    r"|kalp\s+yetmezli[gğ]i|kardiyak\s+yetmezlik|solunum\s+yetmezli[gğ]i|a[sş]ırı\s+duyarlılık|bronkospazm|astım"
    r"|kanama\s+bozuklu[gğ]u|trombositopeni|epilepsi|konvülsiyon|miyastenia\s+gravis|porfiri"
    r"|şiddetli\s+böbrek\s+yetmezli[gğ]i|şiddetli\s+karaci[gğ]er\s+yetmezli[gğ]i)"
)
FILTRATION = (
    r"(?:e?GFR|glomer[üu]ler\s+filtrasyon(?:\s+h[ıi]z[ıi])?|kreatinin\s+klerensi|[Tt]ahmini\s+glomer[üu]lar\s+filtrasyon|eGFR|CrCl|Ccr)"
    r"[\s\[\]():]*([<>≤≥]|<=|>=)?\s*(\d+(?:[,.]\d+)?)(?:\s*(?:ila|to|-|–)\s*(?:<?(\d+)))?"
)
ADJUSTMENTS = (
    ("contraindicated", ["kontrendike", "kullanılmamalı", "verilmemeli", "kullanımından kaçınılmalı"]),
    ("dose_reduction", ["azaltıl", "düşürül", "yarıya", "doz ayar", "doz düzenle"]),
    ("monitoring", ["yakın izlem", "izlenmelidir", "dikkatli kullan", "dikkat"]),
)
ENZYME = r"\b(CYP\s*[1-3][A-Z]\d+(?:\.\d+)?)\b"
ROLES = (
    ("inhibitor", ["inhibitör", "inhibe eder", "inhibisyon", "inhibe", "baskılar", "tarafından inhibe", "enzim inhibitörü"]),
    ("inducer", ["indükleyici", "indüksiyon", "indükler", "indüktör", "indüksiyonuna", "enzim indükler"]),
    ("substrate", ["substrat", "metabolize", "metabolizma", "yıkım", "tarafından parçalan", "tarafından metabolize", "metabolizasyonu", "esas olarak"]),
)
PREGNANCY = r"(?:FDA\s+)?[Gg]ebelik\s+[Kk]ategorisi\s*[:/]?\s*([A-DX])\b|[Kk]ategori\s*([A-DX])\b|\b([A-DX])\s+[Kk]ategorisi\b"
PREGNANCY_PHRASES = (
    ("gebelikte kontrendike", "X"), ("gebelikte kullanılmamalı", "X"), ("gebelikte kullanılmaz", "X"), ("gebelikte güvenli", "A"),
    ("gebelikte kullanılabilir", "B"), ("gebelikte dikkatli", "C"), ("gebelikte yalnızca", "C"), ("fetal risk", "D"), ("teratojenik", "D"),
    ("teratojen", "D"),
)
NO_INGREDIENTS = [
    "dihidrat", "monohidrat", "trihidrat", "seskihidrat", "sodyum", "potasyum", "kalsiyum", "magnezyum", "maleat", "tartarat",
    "hidroklorür", "hidroklorid", "fosfat", "sitrat", "besilat", "fumarat", "sülfat", "oksalat", "glukonat", "hidrojen", "nitrat",
    "asetat", "laktat", "bromir", "klorür", "milligram", "mikrogram", "miligram", "millilitre", "eşdeğer", "içerir", "içinde",
    "içindeki", "içeren", "içerisinde", "içermektedir", "içermekte", "içeriğind", "içeriğinde", "olarak", "kaynakl", "katkı",
    "üretilen", "üretilmiş", "kullanıma", "kullanım", "maddesi", "tablette", "tabletinde", "kapsülde", "çözelti", "çözeltinin",
    "süspansiyon", "enjeksiyon", "enjeksiyonluk", "kullanılmaktadır", "kullanılmakta", "kullanılma", "kullanılm", "birlikte",
    "kullanımı", "tedavisi", "kombinasyonu", "üretiminde", "hammadde", "sütünden", "elde", "edilen", "miktarda", "edilmektedir",
    "mukozasından", "intestinal", "türetilen", "alkalin", "depolimerizasyonu", "rekombinant", "teknolojisi", "equivalent",
    "anhydrous", "hydrate", "sodium", "calcium", "escherichi",
]
LETTERS, VOWELS = "a-zA-ZçğışöüÇĞİÖŞÜ", "[aeıioöuü]$"
# --- End of fixed values ---------------------------------------------------------------------------------------------

UNKNOWN = "unknown"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start from 0, stop, text) of all matches of a pattern (not of empty ones)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,stop:int,text:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + x["gap"]
        stop = begin + F.length(x["m"])
        return F.struct(stop.alias("pos"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), stop.alias("stop"), x["m"].alias("text")))).alias("out"))

    return F.aggregate(sizes, start, step)["out"]


def window(text: Column, start: Column, stop: Column, reach: int) -> Column:
    """text from reach characters before start to reach after stop."""
    begin = F.greatest(start - reach, F.lit(0))
    return F.substring(text, begin + 1, stop + reach - begin)


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_tier(text: Column, tiers, default: str | None = None) -> Column:
    """The name of the first of some (name, words) of which text has a word."""
    out = F.lit(default).cast("string")
    for name, words in reversed(tiers):
        out = F.when(_has(text, words), name).otherwise(out)
    return out


def severity(text: Column, mention: Column, reach: int = 1500, tiers=SEVERITIES) -> Column:
    """The first tier with a word within reach of the first place of mention, in the whole text where it isn't there;
    unknown without a text or a mention."""
    low, word = F.lower(text), F.lower(mention)
    at = F.position(word, low)
    near = F.when(at > 0, window(low, at - 1, at - 1 + F.length(word), reach)).otherwise(low)
    return F.when((F.coalesce(text, F.lit("")) == "") | (F.coalesce(mention, F.lit("")) == ""), UNKNOWN).otherwise(first_tier(near, tiers, UNKNOWN))


def conditions(text: Column) -> Column:
    """The distinct conditions of a text in lower case with single spaces, of four characters or more, in order."""
    found = F.regexp_extract_all(text, F.lit(f"(?iuU){CONDITION}"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(found, lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")))), lambda c: F.length(c) >= 4)


def mentions(text: Column, name: Column) -> Column:
    """The distinct ones of the first ten names that a text speaks of beside a word of interaction, without name itself."""
    own, first = F.lower(name), F.lower(F.get(F.split(F.trim(name), r"\s+"), F.lit(0)))

    def wanted(m: Column) -> Column:
        low = F.lower(m)
        last = F.element_at(F.split(m, r"\s+"), -1)
        return (F.length(m) > 4) & ~own.contains(low) & ~low.contains(first) & ~low.endswith(" ile") & ~low.isin(NO_MENTIONS) & (F.length(last) >= 4)

    found = F.transform(F.regexp_extract_all(text, F.lit(f"(?U){MENTION}"), F.lit(1)), F.trim)
    return F.array_distinct(F.slice(F.filter(found, wanted), 1, 10))


def dose_adjustments(text: Column) -> Column:
    """Array of (op, value, upper, kind, excerpt) of the filtration limits in a text; a limit within 1 of an earlier one is
    left out. The kind comes from the words within 200 characters."""
    pattern = f"(?iu){FILTRATION}"

    def one(m: Column) -> Column:
        near = window(text, m["start"], m["stop"], 200)
        part = lambda k: F.regexp_extract(m["text"], pattern, k)
        return F.struct(
            F.when(part(1) == "", "<").otherwise(part(1)).alias("op"), F.replace(part(2), F.lit(","), F.lit(".")).cast("double").alias("value"), F.when(part(3) != "", part(3).cast("double")).alias("upper"),
            first_tier(F.lower(near), ADJUSTMENTS, "unspecified").alias("kind"), F.trim(F.substring(near, 1, 200)).alias("excerpt"),
        )

    kind = "array<struct<op:string,value:double,upper:double,kind:string,excerpt:string>>"
    fresh = lambda acc, x: ~F.exists(acc, lambda y: F.abs(y["value"] - x["value"]) < 1)
    return F.aggregate(F.transform(matches(text, pattern), one), F.array().cast(kind), lambda acc, x: F.when(fresh(acc, x), F.concat(acc, F.array(x))).otherwise(acc))


def enzyme_roles(text: Column) -> Column:
    """The distinct (enzyme, role) of a text, in order; the role comes from the words within 150 characters."""
    found = F.transform(
        matches(text, f"(?iu){ENZYME}"),
        lambda m: F.struct(F.upper(F.regexp_replace(m["text"], r"\s", "")).alias("enzyme"), first_tier(F.lower(window(text, m["start"], m["stop"], 150)), ROLES).alias("role")),
    )
    return F.array_distinct(F.filter(found, lambda e: e["role"].isNotNull()))


def pregnancy_category(text: Column) -> Column:
    """A to D or X: the letter that stands in the text, else that of the first phrase; null without either."""
    part = lambda k: F.regexp_extract(text, PREGNANCY, k)
    letter = F.upper(F.concat(part(1), part(2), part(3)))
    said = F.lit(None).cast("string")
    for phrase, category in reversed(PREGNANCY_PHRASES):
        said = F.when(F.lower(text).contains(phrase), category).otherwise(said)
    return F.when(letter != "", letter).otherwise(said)


def ingredient_words(text: Column) -> Column:
    """The five shortest words of eight letters or more in the first 120 characters; those of NO_INGREDIENTS are left out,
    a last vowel also falls, and of words of which one begins with another the shorter stays. Equal lengths by alphabet."""
    words = F.transform(F.regexp_extract_all(F.substring(text, 1, 120), F.lit(f"([{LETTERS}]{{8,}})"), F.lit(1)), F.lower)
    words = F.filter(words, lambda w: ~w.isin(NO_INGREDIENTS))
    short = F.transform(F.filter(words, lambda w: w.rlike(VOWELS) & (F.length(w) >= 9)), lambda w: F.substring(w, F.lit(1), F.length(w) - 1))
    pool = F.array_distinct(F.concat(words, short))
    kept = F.filter(pool, lambda w: ~F.exists(pool, lambda o: (o != w) & w.startswith(o)))
    return F.slice(F.transform(F.array_sort(F.transform(kept, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), lambda x: x["w"]), 1, 5)
