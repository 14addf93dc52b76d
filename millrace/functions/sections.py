"""Sections of a document and their parts: sub-headings, packed parts with an introduction, tables, page texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import let

# --- Fixed values: headings, labels and sizes that results have to match -----------------------------------------------
HEADINGS = (
    ("bobrek_karaciger", "Böbrek / Karaciğer Yetmezliği", ("renal", "hepatic"), r"B[oö]brek\s*/\s*Karaci[gğ]er\s+yetmezli[gğ]i"),
    ("bobrek", "Böbrek Yetmezliği", ("renal",), r"B[oö]brek\s+yetmezli[gğ]i"),
    ("karaciger", "Karaciğer Yetmezliği", ("hepatic",), r"Karaci[gğ]er\s+yetmezli[gğ]i"),
    ("pediyatrik", "Pediyatrik Popülasyon", ("pediatric",), r"Pediyatrik\s+pop[uü]lasyon"),
    ("geriyatrik", "Geriyatrik Popülasyon", ("geriatric",), r"Geriyatrik\s+pop[uü]lasyon"),
)
COMBINED, SINGLES = "bobrek_karaciger", ("bobrek", "karaciger")
SPECIAL_GROUPS = r"[Öo]zel\s+pop[uü]lasyonlara?\s+ili[sş]kin\s+ek\s+bilgiler"
SPLIT_FROM, PACK, INTRO, LEAST_PART, LEAST_SUB = 2500, 2200, 280, 50, 30
# --- End of fixed values ---------------------------------------------------------------------------------------------

PART = "array<struct<key:string,label:string,flags:array<string>,text:string,chunk_id:string>>"


def _place(text: Column, pattern: str) -> Column:
    """Where the first match begins, from 0; null without one."""
    p = f"(?iuU){pattern}"
    return F.when(text.rlike(p), F.length(F.get(F.split(text, p, 2), F.lit(0))))


def _slug(name: Column, n: int) -> Column:
    return F.substring(F.regexp_replace(F.upper(name), "[^A-Z0-9]", "_"), 1, n)


def chunk_id(name: Column, section: str, key: Column, file: Column, digits: int = 10, slug: int = 25) -> Column:
    """Slug of the name, section and key, and the first digits of an MD5 of all that tells the chunk."""
    whole = F.concat_ws("_", name, F.lit(section), key, file)
    return F.concat(_slug(name, slug), F.lit(f"_{section.replace('.', '_')}_"), key, F.lit("_"), F.substring(F.md5(whole), 1, digits))


def group_parts(text: Column, title: Column, name: Column, file: Column, section: str = "4.2") -> Column:
    """The parts of a section by patient group: array of (key, label, flags, text, chunk_id), in the order of the text.
    A part goes from its heading to the next one; what stands before the special groups introduces each. The combined
    heading takes the place of its two single ones; parts under 30 characters are left out."""
    place = F.coalesce(_place(text, SPECIAL_GROUPS), F.lit(0))
    return let(place, lambda start: _grouped(F.trim(F.substring(text, F.lit(1), start)), F.substring(text, start + 1, F.length(text)), start, title, name, file, section))


def _grouped(intro: Column, rest: Column, start: Column, title: Column, name: Column, file: Column, section: str) -> Column:
    """The parts of rest, a text from start on, after intro."""
    places = F.array(*[_place(rest, p) for *_, p in HEADINGS])

    def parts(at: Column) -> Column:
        hits = [F.struct(at[n].alias("at"), F.lit(n).alias("n"), F.lit(k).alias("key"), F.lit(label).alias("label"), F.array(*map(F.lit, flags)).alias("flags")) for n, (k, label, flags, _) in enumerate(HEADINGS)]
        hits = F.array_sort(F.filter(F.array(*hits), lambda h: h["at"].isNotNull() & ~(at[0].isNotNull() & h["key"].isin(*SINGLES))))
        return let(hits, lambda hits: F.filter(F.transform(hits, lambda h, i: part(h, F.get(hits, i + 1)["at"])), lambda p: p["text"].isNotNull()).cast(PART))

    def part(h: Column, stop: Column) -> Column:
        own = F.trim(F.substring(rest, h["at"] + 1, F.coalesce(stop, F.length(rest)) - h["at"]))
        head = F.concat(F.lit("["), title, F.lit(" — "), h["label"], F.lit("]\n\n"))
        whole = F.concat(head, F.when((start > 0) & (intro != ""), F.concat(intro, F.lit("\n\n"))).otherwise(""), F.lit("--- "), h["label"], F.lit(" ---\n"), own)
        return F.struct(h["key"].alias("key"), h["label"].alias("label"), h["flags"].alias("flags"), F.when(F.length(own) >= LEAST_SUB, whole).alias("text"), chunk_id(name, section, h["key"], file).alias("chunk_id"))

    return let(places, parts)


def packed_parts(text: Column, title: Column, name: Column, file: Column, section: str = "4.4", lead: str = "Özel Uyarılar", split_from: int = SPLIT_FROM, pack: int = PACK, introduction: int = INTRO) -> Column:
    """A section over split_from characters in parts: its paragraphs after the first are put together while a part's
    paragraphs have at most pack characters; each part gets the beginning of the first paragraph. One part is none."""
    none = F.array().cast(PART)
    paragraphs = F.filter(F.transform(F.split(text, r"\n{2,}"), lambda p: F.trim(p, F.lit(" \n\t"))), lambda p: p != "")
    # a group is a range of paragraphs and their length: texts are put together once, when the groups are known
    start = F.array().cast("array<struct<n:int,first:int,last:int>>")

    def step(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        new = F.array(F.struct(p["n"].alias("n"), p["at"].alias("first"), p["at"].alias("last")))
        more = F.array(F.struct((last["n"] + p["n"]).alias("n"), last["first"].alias("first"), p["at"].alias("last")))
        return F.when((F.size(acc) == 0) | (last["n"] + p["n"] > pack), F.concat(acc, new)).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), more))

    def parts(ps: Column) -> Column:
        sizes = F.transform(ps, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("at")))
        rest = F.filter(sizes, lambda p: (p["at"] > 0) | (F.size(sizes) == 1))
        return let(F.aggregate(rest, start, step), lambda groups: F.when(F.size(groups) > 1, labelled(ps, groups)).otherwise(none))

    def labelled(ps: Column, groups: Column) -> Column:
        def part(g: Column, i: Column) -> Column:
            own = F.array_join(F.slice(ps, g["first"] + 1, g["last"] - g["first"] + 1), "\n\n")
            number = F.concat((i + 1).cast("string"), F.lit("/"), F.size(groups).cast("string"))
            key = F.concat(F.lit("part"), (i + 1).cast("string"))
            intro = F.substring(F.get(ps, F.lit(0)), 1, introduction)
            whole = F.concat(F.lit("["), title, F.lit(" — Bölüm "), number, F.lit("]\n\n[Bağlam — Madde "), F.lit(section), F.lit(" girişi]: "), intro, F.lit("\n\n--- Devam (Bölüm "), number, F.lit(") ---\n"), own)
            return F.struct(key.alias("key"), F.concat(F.lit(f"{lead} — Bölüm "), number).alias("label"), F.array().cast("array<string>").alias("flags"), F.when(F.length(own) >= LEAST_PART, whole).alias("text"), chunk_id(name, section, key, file).alias("chunk_id"))

        return F.filter(F.transform(groups, part), lambda p: p["text"].isNotNull()).cast(PART)

    return F.when(F.length(text) > split_from, let(paragraphs, parts)).otherwise(none)


def page_text(blocks: Column) -> Column:
    """The texts of blocks (x, y, text) in reading order: by y rounded to fives, then x; empty ones are left out."""
    order = F.array_sort(F.transform(blocks, lambda b: F.struct((F.round(b["y"] / 5) * 5).alias("y"), b["x"].alias("x"), F.trim(b["text"]).alias("text"))))
    return F.array_join(F.transform(F.filter(order, lambda b: b["text"] != ""), lambda b: b["text"]), "\n")


def table_markdown(rows: Column) -> Column:
    """A table (array of arrays of cells) as Markdown, the first row as its head; null for under four cells that say
    something. Cells lose line ends, null cells are empty."""
    cell = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " "))
    clean = F.transform(rows, lambda r: F.transform(r, cell))
    filled = F.size(F.filter(F.flatten(clean), lambda c: c != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.get(clean, F.lit(0)), lambda c: F.lit(" --- ")), "|"), F.lit("|"))
    lines = F.concat(F.array(line(F.get(clean, F.lit(0))), rule), F.transform(F.slice(clean, 2, F.greatest(F.size(clean) - 1, F.lit(1))), line))
    return F.when(filled >= 4, F.array_join(lines, "\n"))


def page_with_tables(blocks: Column, tables: Column) -> Column:
    """page_text of blocks (x0, y0, x1, y1, text) and tables (x0, y0, x1, y1, text): a block whose centre lies in a table's
    box goes, and the table's text stands once at its y."""
    inside = lambda b, t: ((b["x0"] + b["x1"]) / 2).between(t["x0"], t["x1"]) & ((b["y0"] + b["y1"]) / 2).between(t["y0"], t["y1"])
    at = lambda b: F.struct(b["x0"].alias("x"), b["y0"].alias("y"), b["text"].alias("text"))
    own = F.transform(F.filter(blocks, lambda b: ~F.exists(tables, lambda t: inside(b, t))), at)
    return page_text(F.concat(own, F.transform(F.filter(tables, lambda t: t["text"].isNotNull()), at)))


def is_scanned(pages: Column, least: int = 50) -> Column:
    """Whether the trimmed pages of a document have under least characters on average; a document without pages is."""
    total = F.aggregate(F.transform(pages, lambda p: F.length(F.trim(p))), F.lit(0), lambda a, n: a + n)
    return F.when(F.size(pages) > 0, total / F.size(pages) < least).otherwise(True)
