"""Laboratory values out of report texts: rows of a table, and names with a number beside or below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: row patterns, names and ranges that results have to match -------------------------------------------
ROW = r"^(.+?)\s{2,}(\d{1,5}[.,]\d{1,4}|\d{1,5})(?:\s|$)"
SHORT_NAME = r"\(([A-Za-z][A-Za-z0-9#%]*)\)\s*$"
NO_ROW = (
    r"^(T\.C\.|Sağlık|Tarih\s|Adı|Doğum|Cinsiyet|Sağlık Tesisi|Sonuç\s|Referans|Birimi|Değeri|enabiz|0 850|Sayfa\s"
    r"|\d{1,2}\.\d{2}\.\d{4}|\d{2}:\d{2}|TAM KAN|HEMOGRAM)"
)
PROFILE_NAMES = {
    "ALT": "ALT", "AST": "AST", "HGB": "Hemoglobin", "HB": "Hemoglobin", "PLT": "Trombosit", "K": "K", "Na": "Na",
    "INR": "INR", "GFR": "GFR", "eGFR": "GFR", "HbA1c": "HbA1c", "HgbA1c": "HbA1c", "Bil": "Bilirubin",
    "Hemoglobin": "Hemoglobin", "Trombosit": "Trombosit", "Kreatinin": "Kreatinin", "Creatinine": "Kreatinin",
    "Bilirubin": "Bilirubin", "Potasyum (K)": "K", "Sodyum (Na)": "Na",
}
RANGES = {
    "ALT": (1, 2000), "AST": (1, 2000), "Kreatinin": (0.1, 30), "K": (1.0, 10.0), "Na": (100, 200), "INR": (0.5, 20),
    "HbA1c": (3, 20), "Bilirubin": (0.1, 50), "Hemoglobin": (1, 25), "Trombosit": (1, 2000), "GFR": (1, 200),
}
NAMES = {
    "ALT": [r"\bALT\b", r"\bSGPT\b", r"Alanin[\s\-]?[Aa]minotransferaz", r"Alanin[\s\-]?[Tt]ransaminaz", r"Alanine\s+[Aa]minotransferase"],
    "AST": [r"\bAST\b", r"\bSGOT\b", r"Aspartat[\s\-]?[Aa]minotransferaz", r"Aspartat[\s\-]?[Tt]ransaminaz", r"Aspartate\s+[Aa]minotransferase"],
    "Kreatinin": [r"\bKreatinin\b", r"\bCreatinine?\b", r"\bKREA\b", r"\bCrea\b"],
    "K": [r"\bPotasyum\b", r"\bPotassium\b", r"\bKalium\b", r"(?:^|[\s:;|])\bK\b(?:\+)?(?=\s*[:=\s]\s*\d)"],
    "Na": [r"\bSodyum\b", r"\bSodium\b", r"\bNatrium\b", r"(?:^|[\s:;|])\bNa\b(?:\+)?(?=\s*[:=\s]\s*\d)"],
    "INR": [r"\bINR\b", r"International\s+Normalized\s+Ratio", r"Uluslararas[iı]\s+Normalize"],
    "HbA1c": [r"\bHbA1[cC]\b", r"\bHgbA1[cC]\b", r"Hemoglobin\s+A1[cC]", r"Glikozile\s+Hemoglobin", r"Glikolize\s+Hemoglobin"],
    "Bilirubin": [r"Total\s+Bilirubin", r"Toplam\s+Bilirubin", r"\bBilirubin[\s,]", r"\bBilirubin$", r"\bT\.?\s*[Bb]il\b"],
    "Hemoglobin": [r"\bHemoglobin\b", r"\bHgb\b", r"\bHb\b(?!A1)"],
    "Trombosit": [r"\bTrombosit\b", r"\bThrombocyte\b", r"\bPlatelet\b", r"\bPLT\b"],
    "GFR": [r"\beGFR\b", r"\bGFR\b", r"Glomerüler\s+[Ff]iltrasyon", r"CKD[-\s]?EPI", r"Tahmini\s+GFR"],
}
NUMBER, YEAR = r"(\d{1,4}[.,]\d{1,3}|\d{1,4})", r"^\d{4}$"
# --- End of fixed values ---------------------------------------------------------------------------------------------


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).cast("double")


def _in_range(name: Column, value: Column) -> Column:
    out = value >= 0
    for lab, (low, high) in RANGES.items():
        out = F.when(name == lab, value.between(low, high)).otherwise(out)
    return out


def report_rows(reports: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line, name, value, profile_name, usable: the table rows of each report, in order. A row has a name, two or
    more spaces, and a number; headings, dates and footers are none. A name is its abbreviation in brackets if it has one;
    usable tells that the value lies in the range of its profile name."""
    lines = reports.select(id_col, F.posexplode(F.split(text_col, "\r?\n")).alias("line", "raw")).select(id_col, "line", F.trim("raw").alias("raw"))
    rows = lines.where(~F.col("raw").rlike(f"(?iu){NO_ROW}") & F.col("raw").rlike(ROW))
    rows = rows.select(id_col, "line", F.trim(F.regexp_extract("raw", ROW, 1)).alias("full"), _number(F.regexp_extract("raw", ROW, 2)).alias("value"))
    short = F.regexp_extract("full", SHORT_NAME, 1)
    rows = rows.withColumn("name", F.when(short != "", short).otherwise(F.col("full")))
    known = F.create_map(*[F.lit(x) for pair in PROFILE_NAMES.items() for x in pair])
    rows = rows.withColumn("profile_name", F.coalesce(F.try_element_at(known, F.col("name")), F.try_element_at(known, F.col("full")), F.col("name")))
    return rows.select(id_col, "line", "name", "value", "profile_name", _in_range(F.col("profile_name"), F.col("value")).alias("usable"))


def report_values(reports: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, name, value, profile: the last value of each name, and those of profile names (profile: true)."""
    rows = report_rows(reports, id_col, text_col)
    last = lambda c: F.max_by("value", "line").alias("value")  # noqa: E731, ARG005
    names = rows.groupBy(id_col, "name").agg(last("name")).withColumn("profile", F.lit(False))
    profile = rows.where("usable").groupBy(id_col, F.col("profile_name").alias("name")).agg(last("name")).withColumn("profile", F.lit(True))
    return names.unionByName(profile)


def _says(pattern: str):
    return lambda line: line.rlike(f"(?iu){pattern}")


def _first_number(lines: Column) -> Column:
    """The first number of some lines that is no year."""
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(NUMBER), F.lit(1))))
    return _number(F.get(F.filter(found, lambda n: ~n.rlike(YEAR)), F.lit(0)))


def text_values(text: Column) -> Column:
    """map<string,double> of the values in a text. For each name its patterns are tried in order; the first line with one
    gives its first number, or that of the next two lines, if it lies in the name's range."""
    let = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731  what stands in the array is worked out once

    def value(name: str, pattern: str, lines: Column) -> Column:
        at = F.array_position(F.transform(lines, _says(pattern)), F.lit(True)).cast("int")
        found = let(at, lambda k: F.when(k > 0, _first_number(F.slice(lines, F.greatest(k, F.lit(1)), 3))))
        return let(found, lambda v: F.when(_in_range(F.lit(name), v), v))

    def values(lines: Column) -> Column:
        found = [F.struct(F.lit(name).alias("key"), F.coalesce(*[value(name, p, lines) for p in patterns]).alias("value")) for name, patterns in NAMES.items()]
        return F.map_from_entries(F.filter(F.array(*found), lambda e: e["value"].isNotNull()))

    return let(F.split(text, "\r?\n"), values)
