"""Product labels: what a label's text says of its name and ingredient, its warning block, its numbered sections and their
chunks. All are column functions: places of matches are found by the JVM, order-dependent rules are folds over them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.extraction import matches
from millrace.functions.text import ASCII, TURKISH, normalized_name

# --- Fixed values: patterns, titles, words and sizes that results have to match ---------------------------------------
#: Headings, in the order in which they are looked for. The first group is the number, the second the title.
HEADINGS = (
    r"^\s{0,8}(4\.[1-9](?:\.[0-9])?)\s*\.?\s{0,6}([A-ZÇĞİÖŞÜ][^\n]{4,90}?)\s*$",
    r"^\s{0,4}(4\.[1-9](?:\.[0-9])?)\s*\.?\s*\n\s*([A-ZÇĞİÖŞÜ][^\n]{4,80}?)\s*$",
    r"^\s{0,4}(5|6|7|8|9|10)\.\s{1,6}([A-ZÇĞİÖŞÜ][^\n]{4,70}?)\s*$",
    r"^\s{0,4}(5|6|7|8|9|10)\.\s*\n\s*([A-ZÇĞİÖŞÜ][^\n]{4,70}?)\s*$",
    r"^\|\s*(4\.[1-9](?:\.[0-9])?)\s*\.?\s{0,6}([A-ZÇĞİÖŞÜ][^\n]{4,90}?)\s*\|?\s*$",
    r"^\|\s*(5|6|7|8|9|10)\.\s{1,6}([A-ZÇĞİÖŞÜ][^\n]{4,70}?)\s*\|?\s*$",
    r"^\s{0,8}(4\.[1-9](?:\.[0-9])?)\s*\.\s*$",
    r"^\s{0,8}(4,[1-9](?:,[0-9])?)\s*\.?\s{0,6}([A-ZÇĞİÖŞÜ][^\n]{4,90}?)\s*$",
)
UNTITLED = 6  # the heading without a second group
REFERENCE, AHEAD, BEHIND = r"(bkz|bakınız|see|Bölüm|Madde|Section)\s*\.?\s*", 60, 5
DOSE = r"^\d[\d\.,]+\s*(mg|ml|mcg|iu|%|kg)"
GAP, LEAST_TITLE, LEAST_CHUNK = 50, 5, 20
TITLES = {
    "1": "Beşeri Tıbbi Ürünün Adı", "2": "Kalitatif ve Kantitatif Bileşim", "3": "Farmasötik Form", "4": "Klinik Özellikler",
    "4.1": "Terapötik Endikasyonlar", "4.2": "Pozoloji ve Uygulama Şekli", "4.3": "Kontrendikasyonlar",
    "4.4": "Özel Kullanım Uyarıları ve Önlemleri", "4.5": "Diğer Tıbbi Ürünlerle Etkileşimler", "4.6": "Gebelik ve Laktasyon",
    "4.7": "Araç ve Makine Kullanımı Üzerindeki Etkiler", "4.8": "İstenmeyen Etkiler", "4.9": "Doz Aşımı",
    "5": "Farmakolojik Özellikler", "5.1": "Farmakodinamik Özellikler", "5.2": "Farmakokinetik Özellikler",
    "5.3": "Klinik Öncesi Güvenlilik Verileri", "6": "Farmasötik Özellikler", "7": "Ruhsat Sahibi", "8": "Ruhsat Numarası",
    "9": "İlk Ruhsat Tarihi / Ruhsat Yenileme Tarihi", "10": "KÜB'ün Yenilenme Tarihi",
}
RISKS = {"4.3": "critical", "4.4": "warning", "4.5": "warning", "4.8": "info", "4.2": "info", "4.6": "info"}
CRITICAL, IMPORTANT = ("4.3", "4.4", "4.5"), ("4.1", "4.2", "4.6", "4.8", "4.9")
#: Lines of signatures and page numbers, which go from chunks.
ARTEFACTS = (
    r"Belge\s+Do[ğg]rulama\s+Kodu\s*:\s*\S+",
    r"(?i)Bu\s+belge\s*,?\s*g[üu]venli\s+elektronik\s+imza\s+ile\s+imzalanm[ıi][şs]t[ıi]r\.?",
    r"Belge\s+Tarihi\s*:\s*[\d./]+",
    r"Belge\s+Takip\s+Adresi\s*:[^\n]*",
    r"(?m)^\s*\d{1,3}\s*/\s*\d{1,3}\s*$",
    r"(?m)^\s*\d{1,3}\s*\|\s*\d{1,3}\s*$",
)
NAME_TITLE = r"BE[ŞS]ER[İI]\s+TIBB[İI]\s+[ÜU]R[ÜU]N[ÜU]N\s+ADI"
NAMES = (rf"(?im)1\.\s*{NAME_TITLE}\s*\n+([^\n]+)", rf"(?im)^1\s*\n\s*{NAME_TITLE}\s*\n+([^\n]+)")
INGREDIENT = r"(?is)etkin\s+madde\w*\s*:?\s*(.{1,600}?)(?:yard[ıi]mc[ıi]\s+madde|3\s*\.\s*[A-ZÇĞİÖŞÜ])"
FIRST_SECTION, SUMMARY = rf"(?i)1[\.\s]*\n?\s*{NAME_TITLE}", r"(?i)KISA\s+[ÜU]R[ÜU]N\s+B[İI]LG[İI]S[İI]"
WARNING, LEAST_WARNING = r"(?i)(UYARI|DİKKAT|▼|kontrendike|kullanılmamalı|şiddetlenme|ciddi advers)", 30
UNKNOWN, NAME_CHARS, INGREDIENT_CHARS, NAME_IN, INGREDIENT_IN, FILE_CHARS = "Bilinmeyen İlaç", 120, 300, 3000, 5000, 50
WARNED, WARNED_TITLE = "ozel_uyari", "Özel Uyarılar (Kara Kutu / Ek İzleme)"
# --- End of fixed values ---------------------------------------------------------------------------------------------

SPACE = " \n\t\r"
SECTION = "struct<start:int,no:string,title:string,raw:string>"
CHUNK = "struct<chunk_id:string,section:string,title:string,text:string,page:int,risk:string,priority:string>"


def _java(pattern: str) -> str:
    """Lines end at \\n only; classes and cases are those of Unicode."""
    return f"(?mdU){pattern}" if not pattern.startswith("(?i") else f"(?dUu){pattern}"


def _of(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*map(F.lit, chain(*table.items())))[key]


def candidates(text: Column, headings: tuple = HEADINGS, untitled: int = UNTITLED) -> Column:
    """Array of (start, no, title, raw) of all that looks like a heading, by pattern, then place. References to a section,
    doses, titles in brackets and short ones are left out."""
    found = []
    for k, pattern in enumerate(headings):
        p = _java(pattern)
        group = lambda n, p=p: F.regexp_extract_all(text, F.lit(p), F.lit(n))
        at = matches(text, p)
        raw = F.transform(group(2), lambda x: F.trim(x, F.lit(SPACE))) if k != untitled else F.transform(at, lambda x: F.lit(""))
        found.append(F.transform(F.arrays_zip(at.alias("at"), group(1).alias("no"), raw.alias("raw")), lambda x: F.struct(x["at"]["start"].alias("start"), F.replace(x["no"], F.lit(","), F.lit(".")).alias("no"), x["raw"].alias("raw"))))

    def is_heading(c: Column) -> Column:
        begin = F.greatest(c["start"] - AHEAD, F.lit(0))
        line = F.substring_index(F.substring(text, begin + 1, c["start"] + BEHIND - begin), "\n", -1)
        refers = F.regexp_like(line, F.concat(F.lit(f"(?iuU){REFERENCE}"), F.replace(c["no"], F.lit("."), F.lit(r"\.")), F.lit("([^0-9]|$)")))
        titled = (F.length(c["raw"]) >= LEAST_TITLE) & ~c["raw"].rlike(r"^\d+$") & ~c["raw"].contains(")") & ~c["raw"].rlike(f"(?iu){DOSE}")
        return ~refers & F.when(c["raw"] == "", _of(TITLES, c["no"]).isNotNull()).otherwise(titled)

    named = lambda c: F.struct(c["start"].alias("start"), c["no"].alias("no"), F.coalesce(_of(TITLES, c["no"]), c["raw"]).alias("title"), c["raw"].alias("raw"))
    return F.transform(F.filter(F.concat(*found), is_heading), named).cast(f"array<{SECTION}>")


def apart(found: Column, gap: int = GAP) -> Column:
    """Of candidates, in their order, those that are at least gap characters from all that were taken before."""
    none = F.array().cast(f"array<{SECTION}>")
    return F.aggregate(found, none, lambda acc, c: F.when(F.exists(acc, lambda x: F.abs(x["start"] - c["start"]) < gap), acc).otherwise(F.concat(acc, F.array(c))))


def sections(text: Column) -> Column:
    """Array of (start, no, title, raw), by place; of each number the first one. Null and empty texts have none."""
    none = F.array().cast(f"array<{SECTION}>")
    by_place = F.array_sort(apart(candidates(F.coalesce(text, F.lit("")))))
    return F.aggregate(by_place, none, lambda acc, c: F.when(F.exists(acc, lambda x: x["no"] == c["no"]), acc).otherwise(F.concat(acc, F.array(c))))


def clean(text: Column) -> Column:
    """Single spaces, at most one empty line, no signatures and page numbers."""
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "), F.lit(SPACE))
    for pattern in ARTEFACTS:
        text = F.regexp_replace(text, pattern.replace("(?m)", "(?md)").replace("(?i)", "(?iu)"), "")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"), F.lit(SPACE))


def slug(name: Column, most: int = 30) -> Column:
    upper = F.translate(F.upper(name), TURKISH, ASCII)
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(upper, "[^A-Z0-9]", "_"), "_+", "_"), F.lit("_")), 1, most)


def _id(name: Column, section: Column, file: Column, digits: int) -> Column:
    return F.concat(slug(name), F.lit("_"), F.replace(section, F.lit("."), F.lit("_")), F.lit("_"), F.substring(F.md5(F.concat_ws("_", name, section, file)), 1, digits))


def chunks(text: Column, found: Column, name: Column, file: Column, pages: Column) -> Column:
    """Array of chunks: the text from each section of found to the next, cleaned; those under 20 characters are left out.
    pages: places at which pages begin, in order."""

    def chunk(s: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(found, i + 1)["start"], F.length(text))
        no = s["no"]
        page = F.greatest(F.size(F.filter(pages, lambda p: p <= s["start"])), F.lit(1))
        priority = F.when(no.isin(*CRITICAL), "critical").when(no.isin(*IMPORTANT), "important").otherwise("normal")
        return F.struct(_id(name, no, file, 12).alias("chunk_id"), no.alias("section"), s["title"].alias("title"), clean(F.substring(text, s["start"] + 1, stop - s["start"])).alias("text"), page.alias("page"), F.coalesce(_of(RISKS, no), F.lit("info")).alias("risk"), priority.alias("priority"))

    return F.filter(F.transform(found, chunk), lambda c: F.length(c["text"]) >= LEAST_CHUNK).cast(f"array<{CHUNK}>")


def product_name(text: Column) -> Column:
    """The line under the first section's title, in the first 3,000 characters."""
    head = F.substring(text, 1, NAME_IN)
    got = [F.nullif(F.regexp_extract(head, p.replace("(?im)", "(?imduU)"), 1), F.lit("")) for p in NAMES]
    return F.coalesce(F.substring(F.trim(F.coalesce(*got), F.lit(SPACE)), 1, NAME_CHARS), F.lit(UNKNOWN))


def label_name(text: Column, file: Column) -> Column:
    """The normalised product name; where the text has none, that of the file."""
    stem = F.substring(F.replace(F.regexp_replace(file, r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")), 1, FILE_CHARS)
    return normalized_name(F.when(product_name(text) == UNKNOWN, stem).otherwise(product_name(text)))


def ingredient(text: Column) -> Column:
    """What follows "etkin madde", without leaders, at most 300 characters; '' without one."""
    raw = F.regexp_extract(F.substring(text, 1, INGREDIENT_IN), INGREDIENT.replace("(?is)", "(?isuU)"), 1)
    raw = F.trim(F.regexp_replace(F.regexp_replace(raw, r"\.{3,}", " "), r"\s+", " "))
    return F.when(F.length(raw) >= 3, F.substring(raw, 1, INGREDIENT_CHARS)).otherwise("")


def warning(text: Column, name: Column, file: Column) -> Column:
    """The chunk of what stands before the first section, if that warns of something; else null."""
    p = FIRST_SECTION.replace("(?i)", "(?iuU)")
    block = F.when(text.rlike(p), F.get(F.split(text, p, 2), F.lit(0)))
    block = clean(F.regexp_replace(F.trim(block, F.lit(SPACE)), SUMMARY.replace("(?i)", "(?iu)"), ""))
    warns = (F.length(block) >= LEAST_WARNING) & block.rlike(WARNING.replace("(?i)", "(?iu)"))
    return F.when(warns, F.struct(_id(name, F.lit(WARNED), file, 8).alias("chunk_id"), F.lit(WARNED).alias("section"), F.lit(WARNED_TITLE).alias("title"), block.alias("text"), F.lit(1).alias("page"), F.lit("critical").alias("risk"), F.lit("critical").alias("priority")).cast(CHUNK))


def parsed(labels, text: str = "text", file: str = "file", pages: str | None = None):
    """labels with name, ingredient, sections and chunks (the warning block first): a text is read once, column by column.
    pages: a column of places at which pages begin."""
    starts = F.col(pages) if pages else F.array(F.lit(0))
    out = labels.withColumn("name", label_name(F.col(text), F.col(file))).withColumn("ingredient", ingredient(F.col(text))).withColumn("sections", sections(F.col(text)))
    block = warning(F.col(text), F.col("name"), F.col(file))
    own = chunks(F.col(text), F.col("sections"), F.col("name"), F.col(file), starts)
    return out.withColumn("chunks", F.concat(F.filter(F.array(block), lambda c: c.isNotNull()), own))
