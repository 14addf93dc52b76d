"""Labels: sections, chunks and heads of label texts, which are made of the given pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import labels as L
from millrace.functions.text import capital
from millrace.plans.registry import query
from millrace.plans.texts import NORM

#: A page's paragraphs become sections of a label; their headings are written in eight ways, which go by page and place.
NUMBERS = ["4.1", "4.2", "4.3", "4.4", "4.5", "4.6", "4.7", "4.8", "4.9", "5", "6", "7", "8", "9", "10", "4.3", "4.2.1", "4.5"]
FORMS = ["\n  {no} {t}", "\n{no}.\n{t}", "\n{no}. {t}", "\n| {no}. {t} |", "\n{no}.", "\n{comma} {t}", "\nbkz. {no} {t}", "\n{no} 5 mg"]
NAME, PARTS = "\n1. BEŞERİ TIBBİ ÜRÜNÜN ADI\n", "\n2. KALİTATİF VE KANTİTATİF BİLEŞİM\nEtkin madde: "


def label_texts(pages):
    """page_id, file, text: a label text for each page. Arrays made of texts are taken apart with explode_outer: for explode
    the optimizer would put a test of their size before the scan, and so make every array twice."""
    d = pages.select("page_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("h1"), F.slice(F.split("html", "<p>"), 2, 40).alias("parts"))
    body = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", " "), r"\s+", " "))
    d = d.withColumn("bodies", F.transform("parts", body))

    def section(b, k):
        no = F.get(F.array(*map(F.lit, NUMBERS)), (k % len(NUMBERS)).cast("int"))
        parts = {"no": no, "comma": F.replace(no, F.lit("."), F.lit(",")), "t": F.concat(capital(F.substring(b, 1, 1)), F.substring(b, 2, 24))}
        form = F.get(F.array(*[F.concat(*[parts[x[1:-1]] if x[:1] == "{" else F.lit(x) for x in _pieces(f)]) for f in FORMS]), ((F.col("page_id") + k) % len(FORMS)).cast("int"))
        return F.concat(form, F.lit("\n"), b)

    first = F.coalesce(F.get("bodies", F.lit(0)), F.lit(""))
    warn = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("KISA ÜRÜN BİLGİSİ\n▼ UYARI: "), F.substring(first, 1, 200))).otherwise("KISA ÜRÜN BİLGİSİ")
    name = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit(NAME), "h1"))
    text = F.concat(warn, name, F.lit(PARTS), F.substring(first, 1, 60), F.lit("\nYardımcı maddeler: su\n"), F.array_join(F.transform("bodies", section), "\n1/2\n"))
    return d.select("page_id", F.concat(F.lit("label_"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("file"), text.alias("text"))


def _pieces(form: str) -> list[str]:
    import re

    return [x for x in re.split(r"(\{\w+\})", form) if x]


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_T = "upper(b[1:1]) || b[2:25]"
_NO = f"[{', '.join(map(_sql, NUMBERS))}][(k - 1) % {len(NUMBERS)} + 1]"
_FORMS = ", ".join(" || ".join({"{no}": _NO, "{comma}": f"replace({_NO}, '.', ',')", "{t}": _T}.get(x, _sql(x)) for x in _pieces(f)) for f in FORMS)
LABELS = f"""b AS (SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h1, list_transform(string_split(html, '<p>')[2:41], lambda p: trim(regexp_replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS bodies FROM pages),
labels AS (SELECT page_id, 'label_' || page_id || '.pdf' AS file, {_sql("KISA ÜRÜN BİLGİSİ")} || CASE WHEN page_id % 3 = 0 THEN {_sql(chr(10) + "▼ UYARI: ")} || left(coalesce(bodies[1], ''), 200) ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '' ELSE {_sql(NAME)} || h1 END
 || {_sql(PARTS)} || left(coalesce(bodies[1], ''), 60) || {_sql(chr(10) + "Yardımcı maddeler: su" + chr(10))} || coalesce(array_to_string(list_transform(bodies, lambda b, k: [{_FORMS}][(page_id + k - 1) % {len(FORMS)} + 1] || chr(10) || b), chr(10) || '1/2' || chr(10)), '') AS text FROM b)"""
_TITLES = "map {" + ", ".join(f"{_sql(k)}: {_sql(v)}" for k, v in L.TITLES.items()) + "}"
_MATCHES = "\n UNION ALL ".join(
    f"SELECT page_id, text, {k} AS p, i, list_sum(list_transform(parts[1:i - 1], lambda x: length(x)))::BIGINT - i + 2 AS start, replace(regexp_extract(split_part(parts[i], chr(2), 1), '(?m){p}', 1), ',', '.') AS no, {'trim(' + f"regexp_extract(split_part(parts[i], chr(2), 1), '(?m){p}', 2)" + ')' if k != L.UNTITLED else chr(39) * 2} AS raw FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM (SELECT page_id, text, string_split(regexp_replace(text, '(?m){p}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts FROM labels))"
    for k, p in enumerate(L.HEADINGS)
)
#: The candidates are folded in the order of patterns and places: one that is near to a taken one is dropped.
SECTIONS = f"""{LABELS}, m AS ({_MATCHES}),
c AS (SELECT page_id, p, i, start, no, raw, coalesce(list_extract({_TITLES}[no], 1), raw) AS title FROM (SELECT *, split_part(reverse(split_part(reverse(text[greatest(start - 60, 0) + 1:start + 5]), chr(10), 1)), chr(10), 1) AS line FROM m)
 WHERE NOT regexp_matches(line, '(?i)(bkz|bakınız|see|Bölüm|Madde|Section)\\s*\\.?\\s*' || replace(no, '.', '\\.') || '([^0-9]|$)') AND CASE WHEN raw = '' THEN {_TITLES}[no] IS NOT NULL ELSE length(raw) >= 5 AND NOT contains(raw, ')') END),
f AS (SELECT page_id, list_reduce(list([{{'start': start, 'no': no, 'title': title, 'raw': raw}}] ORDER BY p, i), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y.start - x[1].start) < 50)) > 0 THEN acc ELSE acc || x END) AS taken FROM c GROUP BY 1),
s AS (SELECT page_id, s.start AS start, s.no AS no, s.title AS title, s.raw AS raw FROM (SELECT page_id, unnest(taken) AS s FROM f) QUALIFY row_number() OVER (PARTITION BY page_id, s.no ORDER BY s.start) = 1)"""
SECTIONS = SECTIONS.replace(f"list_extract({_TITLES}[no], 1)", f"{_TITLES}[no]")


@query("label_sections", f"WITH {SECTIONS} SELECT page_id, no, start, title, raw FROM s")
def label_sections(t):
    """Numbered sections of label texts: eight ways to write a heading, taken in order, at least 50 characters apart."""
    d = label_texts(t.pages).select("page_id", F.explode_outer(L.sections(F.col("text"))).alias("s")).where("s.start is not null")
    return d.select("page_id", "s.no", F.col("s.start").cast("long").alias("start"), "s.title", "s.raw")


def _cleaned(x: str) -> str:
    space = "' ' || chr(10) || chr(9) || chr(13)"
    x = f"trim(regexp_replace(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), {space})"
    for p in L.ARTEFACTS:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return f"trim(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {space})"


_SLUG = "trim(regexp_replace(regexp_replace(translate(upper(name), 'ğüşıöçĞÜŞİÖÇ', 'gusiocGUSIOC'), '[^A-Z0-9]', '_', 'g'), '_+', '_', 'g'), '_')[1:30]"
HEADS = rf"""n AS (SELECT page_id, file, text, regexp_extract(text[1:3000], '(?im)1\.\s*{L.NAME_TITLE}\s*\n+([^\n]+)', 1) AS own, regexp_extract(text[1:5000], '{L.INGREDIENT}', 1) AS ing FROM labels),
h AS (SELECT page_id, file, text, {NORM.format("CASE WHEN own = '' THEN replace(regexp_replace(file, '[.][^.]*$', ''), '_', ' ')[1:50] ELSE trim(own)[1:120] END")} AS name, trim(regexp_replace(regexp_replace(ing, '\.{{3,}}', ' ', 'g'), '\s+', ' ', 'g')) AS ing FROM n)"""
#: Of each section the text up to the next one.
CHUNKS = f"""{SECTIONS}, {HEADS}, k AS (SELECT page_id, no, start, {_cleaned("text[start + 1:stop]")} AS body, name, file FROM (SELECT *, coalesce(lead(start) OVER (PARTITION BY page_id ORDER BY start), length(text)) AS stop FROM s JOIN h USING (page_id)))"""


@query("label_chunks", f"WITH {CHUNKS} SELECT page_id, {_SLUG} || '_' || replace(no, '.', '_') || '_' || md5(name || '_' || no || '_' || file)[1:12] AS chunk_id, no AS section, length(body) AS size, md5(body) AS digest, CASE no WHEN '4.3' THEN 'critical' WHEN '4.4' THEN 'warning' WHEN '4.5' THEN 'warning' ELSE 'info' END AS risk, CASE WHEN no IN ('4.3', '4.4', '4.5') THEN 'critical' WHEN no IN ('4.1', '4.2', '4.6', '4.8', '4.9') THEN 'important' ELSE 'normal' END AS priority FROM k WHERE length(body) >= 20")
def label_chunks(t):
    """Label texts in chunks by section, cleaned, with ids, risks and priorities."""
    d = L.parsed(label_texts(t.pages)).select("page_id", F.explode_outer("chunks").alias("c")).where(F.col("c.section") != L.WARNED)
    return d.select("page_id", "c.chunk_id", "c.section", F.length("c.text").cast("long").alias("size"), F.md5("c.text").alias("digest"), "c.risk", "c.priority")


_BLOCK = _cleaned(f"regexp_replace(trim(string_split_regex(text, '{L.FIRST_SECTION}')[1], ' ' || chr(10) || chr(9) || chr(13)), '{L.SUMMARY}', '')")


@query("label_heads", f"WITH {LABELS}, {HEADS}, w AS (SELECT *, CASE WHEN regexp_matches(text, '{L.FIRST_SECTION}') THEN {_BLOCK} END AS block FROM h), v AS (SELECT *, length(block) >= 30 AND regexp_matches(block, '{L.WARNING}') AS warns FROM w) SELECT page_id, name, CASE WHEN length(ing) >= 3 THEN ing[1:300] ELSE '' END AS ingredient, CASE WHEN warns THEN {_SLUG} || '_ozel_uyari_' || md5(name || '_ozel_uyari_' || file)[1:8] END AS warning_id, CASE WHEN warns THEN md5(block) END AS warning FROM v")
def label_heads(t):
    """Name, ingredient and warning block of label texts."""
    d = L.parsed(label_texts(t.pages))
    w = F.get(F.filter("chunks", lambda c: c["section"] == L.WARNED), F.lit(0))
    return d.select("page_id", "name", "ingredient", w["chunk_id"].alias("warning_id"), F.md5(w["text"]).alias("warning"))
