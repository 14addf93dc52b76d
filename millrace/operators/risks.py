"""Side effects that several drugs of one patient have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values: sections, categories, labels, patterns and limits that results have to match -----------------------
SECTIONS = ("4.8", "4.4", "4.5", "4.3")
CATEGORIES = (
    ("kardiyak", "Kardiyak / QT Uzaması", r"qt\s*uzama|kalp\s*ritim|aritmi|bradikardi|taşikardi|ventriküler|atriyal\s*fibril|kalp\s*durma|kardiyak\s*arrest|torsades|palpitasyon|miyokard"),
    ("hepatik", "Hepatotoksisite", r"hepat|karaciğer\s*(hasar|yetmezlik|enzim|toksis)|ALT|AST|transaminaz|sarılık|kolestaz|hepatit|bilirubin\s*yüksel|karaciğerde\s*(yan|etki|bozuk)"),
    ("renal", "Nefrotoksisite", r"böbrek\s*(hasar|yetmezlik|toksis|bozuk|fonksiyon)|nefrotoks|kreatinin\s*yüksel|GFR\s*düş|renal\s*(hasar|yetmezlik)|akut\s*böbrek|idrar\s*(azal|kesil)|oligüri"),
    ("hematolojik", "Kanama / Hematolojik Risk", r"kanama|hemoraji|trombositopeni|anemi|lökopeni|pansitopeni|koagülasyon|INR|antikoagül|pıhtılaşma|epistaksis|ekimoz|hematom|kan\s*(kayıp|kaybı)"),
    ("nörolojik", "Nörotoksisite / SSS", r"nörotoks|serotonin\s*sendrom|konvülsiyon|nöbet|baş\s*dönmesi|baş\s*ağrısı|konfüzyon|bilinç\s*(bozuk|kayıp)|ensefalopati|SSS|merkezi\s*sinir|tremor|parestezi"),
    ("solunum", "Solunum Toksisitesi", r"bronkospazm|solunum\s*(depresyon|yetmezlik|baskı)|pulmoner\s*(toksis|fibrozis|ödem)|dispne|apne|interstisyel\s*akciğer"),
    ("gastrointestinal", "Gastrointestinal Toksisite", r"gastrointestinal\s*(kanama|ülser|perforasyon)|GI\s*(kanama|toksis)|peptik\s*ülser|mide\s*(kanama|ülser)|bulantı.*kusma|diyare.*ağır|kolit"),
    ("alerji", "Alerji / Anafilaksi", r"anafilaksi|anafilaktik|aşırı\s*duyarlılık|alerjik\s*reaksiyon|anjiyoödem|ürtiker|Steven.*Johnson|toksik\s*epidermal"),
    ("endokrin", "Endokrin / Elektrolit Bozukluğu", r"hiperkalemi|hipokalemi|hiponatremi|hipernatremi|hipoglisemi|hiperglisemi|hipomagnezemi|elektrolit\s*(bozuk|dengesizlik)"),
)
TOGETHER, CRITICAL, LEVELS = 2, 3, ("kritik", "dikkat")
# --- End of fixed values ---------------------------------------------------------------------------------------------


def cumulative_risks(chunks: DataFrame, group: str) -> DataFrame:
    """group, category, label, drugs (sorted), severity, text: the categories that chunks of at least two drugs of a group
    speak of. chunks: group, name, section, text; other sections, and empty names and texts, say nothing. A chunk is read
    once for all categories; what is sent is (group, category, name), each once."""
    hit = F.array_compact(F.array(*[F.when(F.col("text").rlike(f"(?iuU){p}"), code) for code, _, p in CATEGORIES]))
    some = chunks.where(F.col("section").isin(*SECTIONS) & (F.coalesce("name", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))
    found = some.select(group, "name", F.explode_outer(hit).alias("category")).where("category is not null")
    per = found.groupBy(group, "category").agg(F.array_sort(F.collect_set("name")).alias("drugs")).where(F.size("drugs") >= TOGETHER)
    label = F.create_map(*[F.lit(x) for code, name, _ in CATEGORIES for x in (code, name)])[F.col("category")]
    per = per.withColumn("label", label).withColumn("severity", F.when(F.size("drugs") >= CRITICAL, LEVELS[0]).otherwise(LEVELS[1]))
    said = F.concat(F.size("drugs").cast("string"), F.lit(" ilaç birlikte "), F.lower("label"), F.lit(" riski taşıyor: "), F.array_join("drugs", ", "))
    return per.select(group, "category", "label", "drugs", "severity", said.alias("text"))
