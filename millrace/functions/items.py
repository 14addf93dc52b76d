"""Items out of a model's answer: an array of JSON objects, fenced, cut off or with commas too many, becomes rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: keys, words and limits that results have to match --------------------------------------------------
NAME_KEYS = ("drug_b", "drug2", "interaction", "drug", "name", "drug_name")
SECTIONS, SECTION, NAME_CHARS = ("4.3", "4.4", "4.5"), "4.5", 200
SEVERITIES = ("contraindicated", "severe", "moderate", "mild", "unknown")
WORDS = (
    ("kontrendike", "contraindicated"), ("kontrendikedir", "contraindicated"), ("kullanılmamalı", "contraindicated"), ("kullanılmamalıdır", "contraindicated"),
    ("verilmemelidir", "contraindicated"), ("kesinlikle önerilmez", "contraindicated"), ("birlikte kullanılmamalı", "contraindicated"),
    ("ciddi", "severe"), ("şiddetli", "severe"), ("hayati", "severe"), ("tehlikeli", "severe"), ("ağır", "severe"),
    ("orta", "moderate"), ("dikkatli", "moderate"), ("dikkat", "moderate"), ("izlem", "moderate"), ("doz ayarı", "moderate"), ("doz düzenlemesi", "moderate"),
    ("önemli", "moderate"), ("hafif", "mild"), ("minimal", "mild"), ("önemsiz", "mild"), ("sınırlı", "mild"),
    ("bilinmiyor", "unknown"), ("belirsiz", "unknown"), ("bilinmemektedir", "unknown"),
)
# --- End of fixed values ---------------------------------------------------------------------------------------------

RAW = "array<struct<" + ",".join(f"{k}:string" for k in (*NAME_KEYS, "severity", "section", "mechanism")) + ">>"
ITEM = "array<struct<name:string,severity:string,section:string,mechanism:string>>"


def severity_of(said: Column) -> Column:
    """One of SEVERITIES: the word itself, else what the first of WORDS in it says; unknown without one."""
    low, out = F.lower(F.trim(said)), F.lit("unknown")
    for word, level in reversed(WORDS):
        out = F.when(low.contains(word), level).otherwise(out)
    return F.when(low.isin(*SEVERITIES), low).otherwise(F.coalesce(out, F.lit("unknown")))


def json_array(text: Column) -> Column:
    """The first array of a text, without fences: as it stands if it is closed; else cut behind its last whole element and
    closed; '[]' without a whole element, null without a bracket. The fold goes over characters and knows how deep it is
    and whether it is in a string; brackets and quotes in strings, and escaped quotes, count for nothing."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    start = F.instr(bare, "[")
    body = F.substring(bare, start, F.length(bare))
    state = "struct<pos:int,depth:int,quoted:boolean,escaped:boolean,whole:int,closed:int>"
    first = F.struct(*[F.lit(v).alias(k) for k, v in (("pos", 0), ("depth", 0), ("quoted", False), ("escaped", False), ("whole", 0), ("closed", 0))]).cast(state)

    def step(s: Column, c: Column) -> Column:
        pos = s["pos"] + 1
        opens, closes = ~s["quoted"] & c.isin("[", "{"), ~s["quoted"] & c.isin("]", "}")
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        quote = (c == '"') & ~s["escaped"]
        return F.when(s["closed"] > 0, s).otherwise(
            F.struct(
                pos.alias("pos"), depth.alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"),
                F.when(closes & (depth == 1), pos).otherwise(s["whole"]).alias("whole"), F.when(closes & (depth == 0), pos).otherwise(F.lit(0)).alias("closed"),
            ).cast(state)
        )

    def end(s: Column) -> Column:
        return F.when(s["closed"] > 0, F.substring(body, F.lit(1), s["closed"])).when(s["whole"] > 0, F.concat(F.substring(body, F.lit(1), s["whole"]), F.lit("]"))).otherwise("[]")

    return F.when(start > 0, F.aggregate(F.split(body, ""), first, step, end))


def items(text: Column) -> Column:
    """Array of (name, severity, section, mechanism): the name under any of NAME_KEYS, trimmed, at most 200 characters;
    an item without one is left out. Other sections count as 4.5. Commas before a closing bracket are forgiven."""
    array = json_array(text)
    let = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    raw = let(array, lambda a: F.coalesce(F.from_json(a, RAW), F.from_json(F.regexp_replace(a, r",\s*([}\]])", "$1"), RAW)))

    def item(r: Column) -> Column:
        section = F.trim(r["section"])
        return F.struct(
            F.substring(F.trim(F.coalesce(*[r[k] for k in NAME_KEYS])), 1, NAME_CHARS).alias("name"), severity_of(F.coalesce(r["severity"], F.lit("unknown"))).alias("severity"),
            F.when(section.isin(*SECTIONS), section).otherwise(SECTION).alias("section"), r["mechanism"].alias("mechanism"),
        )

    return F.coalesce(F.filter(F.transform(raw, item), lambda x: x["name"].isNotNull()), F.array()).cast(ITEM)
