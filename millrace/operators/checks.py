"""Checks of a generated answer against the sections it was given. Every check is a column expression, so a table of
answers is checked where it stands, without a shuffle; checked() applies them in order, each to what the one before left.

An answer comes with its question and with chunks: array<struct<section: string, name: string, text: string>>. A null
answer stays null, a null question is an empty one, and null chunks are none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values ----------------------------------------------------------------------------------------------------
# Patterns, words and tags that answers have to match letter for letter.
SAFE = (
    r"güvenlidir|güvenle\s+kullan[ıi]labilir|sorun\s+yoktur|risk\s+ta[sş][ıi]maz"
    r"|herhangi\s+bir\s+risk\s+[yo]k|zararsızdır|endişe\s+yoktur"
)
SAFE_NOTICE = "[SİSTEM DÜZELTMESİ: KÜB verileri bu kombinasyon için spesifik güvenlik onayı içermemektedir. Klinik değerlendirme önerilir.]"
FORBIDS = "kontrendikedir|kontrendikasyon|kullanılmamalıdır"
SOFTER = "dikkatli kullanılmalıdır"
TAG_NO_SECTION = " [AŞIRI YORUM: Madde 4.3 retrieve edilmedi, kontrendike kanıtlanamıyor]"
TAG_NOT_IN_SECTION = " [AŞIRI YORUM: Madde 4.3 bu durum için kontrendikasyon içermiyor]"
CONDITIONS = {
    "hiperpotasemi": ["hiperpotasemi", "hiperkalem", "potasyum"],
    "hiperkalemi": ["hiperkalem", "hiperpotasemi", "potasyum"],
    "potasyum": ["potasyum", "hiperkalem", "hiperpotasem"],
    "hipopotasemi": ["hipopotasemi", "hipokalem"],
    "hipokalemi": ["hipokalem", "hipopotasemi"],
    "böbrek yetmezliği": ["böbrek", "renal", "kreatinin", "gfr", "klirens", "diyaliz", "hemodiyaliz", "nefr"],
    "renal yetmezlik": ["böbrek", "renal", "kreatinin", "gfr", "klirens"],
    "renal": ["böbrek", "renal", "kreatinin", "gfr"],
    "karaciğer yetmezliği": ["karaciğer", "hepatik", "hepat", "child", "siroz", "bilirubin", "karaciğer fonksiyon"],
    "hepatik": ["hepatik", "karaciğer", "hepat", "child", "siroz"],
    "gebelik": ["gebelik", "hamilelik", "fetal", "embriyo", "prenatal", "hamile"],
    "hamile": ["hamile", "gebelik", "fetal"],
    "laktasyon": ["laktasyon", "emzirme", "anne sütü"],
    "emzir": ["emzir", "laktasyon", "anne sütü"],
    "hipertansiyon": ["hipertansiyon", "kan basıncı", "kb"],
    "kalp yetmezliği": ["kalp yetmezliği", "kardiyak yetmezlik", "konjestif"],
    "diyabet": ["diyabet", "glukoz", "insülin", "hipoglisemi"],
    "hipoglisemi": ["hipoglisemi", "glukoz", "kan şekeri"],
    "hiperglisemi": ["hiperglisemi", "glukoz", "kan şekeri"],
    "alerji": ["alerji", "hipersensitivite", "anafilaksi", "ürtiker"],
    "hipersensitivite": ["hipersensitivite", "alerji", "anafilaksi"],
    "üriner": ["üriner", "idrar", "mesane", "üretral"],
    "enfeksiyon": ["enfeksiyon", "infeksiyon", "bakteri", "mantar"],
    "trombositopeni": ["trombositopeni", "trombosit", "plt"],
    "lökopeni": ["lökopeni", "lökosit", "nötropeni"],
}
UNVERIFIED = "[DOĞRULANAMADI]"
SOURCE_TAG = r"\[[^\]]+\|\s*Madde\s+[\d.]+[^\]]*\]|\[Graf\]|\[CYP450\]|\[BİLGİ\s*YOK[^\]]*\]|\[SİSTEM\s*DÜZELTMESİ[^\]]*\]|\[DOĞRULANAMADI\]"
SPECIAL_TAG = r"\[Graf\]|\[CYP450\]|\[BİLGİ\s*YOK[^\]]*\]|\[SİSTEM\s*DÜZELTMESİ[^\]]*\]|\[DOĞRULANAMADI\]"
CLAIM_WORDS = [
    "kontrendik", "kullanılmamalı", "kullanılabilir", "doz", " mg", " mcg", " ml", "yan etki", "etkileşim", "metaboliz",
    "inhibis", "indüksi", "substrat", "böbrek", "karaciğer", "renal", "hepatik", "gebelik", "emzirme", "laktasyon",
    "pediatrik", "geriyatrik", "konsantrasyon", "plazma", "biyoyararlanım", "yarı ömür", "toksik", "teratojenik", "embriyo",
    "klirens", "gfr", "kreatinin", "dikkatli kullanıl", "izlem öneril", "uyarı",
]
PROTECTED = ["## KAYNAKLAR", "## UYARI"]
SKIPPED = ["[BİLGİ YOK", "[SİSTEM", "[DOĞRULANAMADI", "##", "- ", "* "]
DOSE = r"\b(\d+(?:[.,]\d+)?)\s*(mg|mcg|ml|iu|mmol|μg|µg|ng|mg/ml|mg/dl|mek)\b"
FILTRATION = r"\b(?:gfr|egfr|kreatinin\s+klerensi?)\s*[<>≤≥=]?\s*(\d+)"
CITED = r"\[.+?\|\s*(?:KÜB\s+)?Madde\s+([\d.]+)"
ENZYME_TAG = r"\[CYP450\]"
INHIBITS, INDUCES = r"inhibit(?:ör|ör[üu]|or)", r"indükl?e(?:yici|yici)"
RISES, FALLS = r"düzey[i]?\s*(?:artar|artabilir|yükselir|yükselme)", r"düzey[i]?\s*(?:azalır|azalabilir|düşer|düşme)"
TAG_RISES, TAG_FALLS = " [DOĞRULANAMADI-CYP: inhibitör → düzey artmalı]", " [DOĞRULANAMADI-CYP: indükleyici → düzey azalmalı]"
FORBIDDEN = "kontrendikedir|kontrendike|kullanılmamalı|verilmemeli|uygulanmamalı"
NOT_ADVISED = "önerilmez|önerilmemeli"
GROUPS = [["böbrek", "renal", "gfr", "kreatinin", "diyaliz"], ["karaciğer", "hepatik", "siroz", "child"], ["gebelik", "hamile", "fetal"], ["emzir", "laktasyon"]]
CONCLUSION = r"##\s*SONU[ÇC][^\n]*\n([^\n]*)"
TAG_VERDICT = " [AŞIRI YORUM: bağlam bu şiddet seviyesini desteklemiyor]"
HEADINGS = (r"\[KÜB Aktarımı\]|\[KUB Aktarimi\]|KÜB Aktarımı", r"\[Değerlendirme\]|\[Degerlendirme\]|Değerlendirme\]")
# --- End of fixed values ---------------------------------------------------------------------------------------------

SENTENCE_END = r"(?<=[.!?])\s+(?!\[)"

def _any_case(pattern: str) -> str:
    return f"(?iuU){pattern}"


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def section_text(chunks: Column, *sections: str) -> Column:
    """The lower-cased texts of the chunks of some sections (of all where none is named), with spaces between."""
    chosen = F.filter(chunks, lambda c: c["section"].isin(*sections)) if sections else chunks
    return F.coalesce(F.lower(F.array_join(F.transform(chosen, lambda c: F.coalesce(c["text"], F.lit(""))), " ")), F.lit(""))


def safe_phrases(answer: Column) -> Column:
    """V-01: absolute statements of safety become a notice."""
    return F.regexp_replace(answer, _any_case(SAFE), SAFE_NOTICE)


def forbidding_claims(answer: Column, question: Column, chunks: Column) -> Column:
    """V-02: a claim that something is forbidden is softened and tagged, if section 4.3 isn't there or has none of the
    words for a condition that the question names."""
    asked, text = F.lower(F.coalesce(question, F.lit(""))), section_text(chunks, "4.3")
    there = F.exists(chunks, lambda c: c["section"] == "4.3")
    missing = _either([asked.contains(c) & ~_has(text, words) for c, words in CONDITIONS.items()])
    tag = F.when(~F.coalesce(there, F.lit(False)), TAG_NO_SECTION).when(missing, TAG_NOT_IN_SECTION)
    softer = answer
    for word in ("kontrendikedir", "kullanılmamalıdır"):
        softer = F.regexp_replace(softer, F.lit(_any_case(word)), F.concat(F.lit(SOFTER), tag))
    return F.when(answer.rlike(_any_case(FORBIDS)) & tag.isNotNull(), softer).otherwise(answer)


def _by_sentence(answer: Column, change) -> Column:
    """answer with change applied to every sentence outside headings and protected parts. The fold carries whether the
    last heading protects what follows."""

    def sentences(line: Column) -> Column:
        return F.array_join(F.transform(F.split(line, SENTENCE_END), change), " ")

    def step(acc: Column, line: Column) -> Column:
        bare = F.trim(line)
        heading = bare.startswith("##")
        protected = F.when(heading, bare.isin(PROTECTED)).otherwise(acc["protected"])
        out = F.when(heading | acc["protected"] | (bare == ""), line).otherwise(sentences(line))
        return F.struct(protected.alias("protected"), F.concat(acc["lines"], F.array(out)).alias("lines"))

    start = F.struct(F.lit(False).alias("protected"), F.array().cast("array<string>").alias("lines"))
    return F.array_join(F.aggregate(F.split(answer, "\n"), start, step)["lines"], "\n")


def _tagged(sentence: Column) -> Column:
    return F.concat(F.rtrim(sentence), F.lit(f" {UNVERIFIED}"))


def uncited_claims(answer: Column, chunks: Column) -> Column:
    """V-03: sentences of 35 characters or more that make a claim (by a word, or by the first word of a chunk's name) and
    have no source tag are tagged."""
    first = F.filter(F.transform(chunks, lambda c: F.get(F.split(F.trim(F.upper(c["name"])), r"\s+"), F.lit(0))), lambda w: F.length(w) >= 4)

    def change(s: Column) -> Column:
        bare = F.trim(s)
        skipped = (F.length(bare) < 35) | _either([bare.startswith(p) for p in SKIPPED]) | s.rlike(_any_case(SOURCE_TAG))
        claim = _has(F.lower(bare), CLAIM_WORDS) | F.coalesce(F.exists(first, lambda w: F.upper(bare).contains(w)), F.lit(False))
        return F.when(~skipped & claim, _tagged(s)).otherwise(s)

    return _by_sentence(answer, change)


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(_any_case(pattern)), F.lit(group))


def numeric_claims(answer: Column, question: Column, chunks: Column) -> Column:
    """V-04: sentences with a dose or a filtration limit that the cited section (without a citation: no chunk) has are
    tagged. A cited section that isn't there leaves its sentence alone, and so do numbers that the question has."""
    everything = section_text(chunks)
    known = F.transform(_all(F.coalesce(question, F.lit("")), r"\b\d+(?:[.,]\d+)?\b", 0), lambda n: F.replace(n, F.lit(","), F.lit(".")))

    def change(s: Column) -> Column:
        bare, lower = F.trim(s), F.lower(F.trim(s))
        skipped = (F.length(bare) < 30) | _either([bare.startswith(p) for p in [*SKIPPED, "["]]) | s.rlike(_any_case(SPECIAL_TAG))
        section = F.regexp_extract(s, _any_case(CITED), 1)
        cited = s.rlike(_any_case(CITED))
        own = F.lower(F.array_join(F.transform(F.filter(chunks, lambda c: F.trim(c["section"]) == section), lambda c: F.coalesce(c["text"], F.lit(""))), " "))
        text = F.when(cited, own).otherwise(everything)
        numbers = F.concat(_all(lower, DOSE, 1), _all(lower, FILTRATION, 1))
        there = lambda n: text.contains(F.replace(n, F.lit(","), F.lit("."))) | text.contains(F.replace(n, F.lit("."), F.lit(",")))
        wrong = F.exists(numbers, lambda n: ~F.array_contains(known, n) & ~there(n))
        return F.when(~skipped & (text != "") & wrong, _tagged(s)).otherwise(s)

    return F.when(F.trim(everything) == "", answer).otherwise(_by_sentence(answer, change))


def enzyme_directions(answer: Column, chunks: Column) -> Column:
    """V-05: lines with the enzyme tag that let a level fall beside an inhibitor, or rise beside an inducer, are tagged."""
    text = section_text(chunks, "4.5")
    inhibitor, inducer = text.rlike(_any_case(INHIBITS)), text.rlike(_any_case(INDUCES))

    def change(line: Column) -> Column:
        rises, falls, tag = line.rlike(_any_case(RISES)), line.rlike(_any_case(FALLS)), line.rlike(_any_case(ENZYME_TAG))
        wrong = F.when(inhibitor & falls & ~rises, TAG_RISES).when(inducer & rises & ~falls, TAG_FALLS)
        return F.when(tag & wrong.isNotNull(), F.concat(F.rtrim(line), wrong)).otherwise(line)

    return F.array_join(F.transform(F.split(answer, "\n"), change), "\n")


def verdict_levels(answer: Column, question: Column, chunks: Column) -> tuple[Column, Column, Column]:
    """(first line of the conclusion, its level, the level that the sections support): 4 forbidden, 3 not advised, 2 less."""
    first = F.trim(F.regexp_extract(answer, _any_case(CONCLUSION), 1))
    level = F.when(first.rlike(_any_case(FORBIDDEN)), 4).when(first.rlike(_any_case(NOT_ADVISED)), 3).otherwise(2)
    asked, text = F.lower(F.coalesce(question, F.lit(""))), section_text(chunks, "4.3")
    named = _either([_has(asked, g) for g in GROUPS])
    there = _either([_has(asked, g) & _has(text, g) for g in GROUPS])
    supported = F.when(text.rlike(_any_case(FORBIDDEN)) & (~named | there), 4).otherwise(2)
    return first, level, supported


def verdict(answer: Column, question: Column, chunks: Column) -> Column:
    """V-06: the first line of a conclusion that goes further than the sections is tagged."""
    first, level, supported = verdict_levels(answer, question, chunks)
    at = F.position(first, answer)
    tagged = F.concat(F.substring(answer, F.lit(1), at - 1 + F.length(first)), F.lit(TAG_VERDICT), F.substring(answer, at + F.length(first), F.length(answer)))
    return F.when((first != "") & (level > supported), tagged).otherwise(answer)


def format_flags(answer: Column) -> Column:
    """V-07: struct of has_conclusion, cited (the conclusion has a source tag), unverified (tags in the answer), poor
    (three or more), quoted and judged (the conclusion has these parts). The answer stays as it is."""
    start = F.position(F.lit("## SONUÇ"), answer)
    rest = F.substring(answer, start + 8, F.length(answer))
    part = F.when(start > 0, F.get(F.split(rest, "\n## "), F.lit(0)))
    count = F.size(F.split(answer, r"\[DOĞRULANAMADI[\]-]")) - 1
    said = lambda p: F.coalesce(part.rlike(_any_case(p)), F.lit(False))
    return F.struct(
        (start > 0).alias("has_conclusion"), said(r"\[.+?\|\s*Madde\s*\d+[\.\d]*\]").alias("cited"), count.alias("unverified"), (count >= 3).alias("poor"), said(HEADINGS[0]).alias("quoted"), said(HEADINGS[1]).alias("judged"),
    )


def checked(answers: DataFrame, answer: str = "answer", question: str = "question", chunks: str = "chunks") -> DataFrame:
    """answers with the answer after all checks, and a column format. The checks run one after the other, each as a
    projection of its own, so that none is computed twice."""
    q, c = F.col(question), F.coalesce(F.col(chunks), F.array().cast("array<struct<section:string,name:string,text:string>>"))
    steps = [lambda a: safe_phrases(a), lambda a: forbidding_claims(a, q, c), lambda a: uncited_claims(a, c), lambda a: numeric_claims(a, q, c), lambda a: enzyme_directions(a, c), lambda a: verdict(a, q, c)]
    for step in steps:
        answers = answers.withColumn(answer, step(F.col(answer)))
    return answers.withColumn("format", format_flags(F.col(answer)))
