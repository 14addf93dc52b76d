"""Column functions on names and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turkish letters and the ASCII letters that stand for them.
TURKISH, ASCII = "ğüşıöçĞÜŞİÖÇ", "gusiocGUSIOC"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Letters whose upper case is one letter only as that of a title.
_TITLED = "ß" + "".join(c for c in map(chr, range(0x1F80, 0x2000)) if len(c.upper()) > 1 and len(c.title()) == 1 and c.title() != c)


def capital(letter: Column) -> Column:
    """A letter in upper case, as one letter: ß becomes ẞ and not SS; a letter without one stays."""
    one = F.translate(letter, _TITLED, "".join("ẞ" if c == "ß" else c.title() for c in _TITLED))
    return F.when(F.length(F.upper(one)) == F.length(one), F.upper(one)).otherwise(one)


def normalized_name(c: Column) -> Column:
    """No marks, Turkish letters as ASCII, single spaces, trimmed, upper case; null as ''."""
    return F.upper(F.trim(F.regexp_replace(_unmarked(c), "\\s+", " ")))


def _unmarked(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "[®™©\\x{E000}-\\x{F8FF}]", "")
    return F.translate(c, TURKISH, ASCII)


def base_name(c: Column) -> Column:
    return F.split_part(normalized_name(c), F.lit(" "), F.lit(1))


def canonical_id(c: Column) -> Column:
    return F.substring(F.sha1(normalized_name(c)), 1, 12)


def tokens(c: Column) -> Column:
    """Tokens of at least two characters, in upper case: those of normalized_name, whose spaces needn't be put together first."""
    return F.filter(F.split(F.upper(_unmarked(c)), r"[\s,;:.!?()\[\]/\-]+"), lambda x: F.length(x) >= 2)


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^a-z]+"), lambda x: F.length(x) >= 1)


def strip_tags(html: Column) -> Column:
    html = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def windows(c: Column, size: int, overlap: int) -> Column:
    """Array of (start from 0, text) of fixed windows; the last one reaches the end."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(c) - overlap) / step).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), last - 1), lambda k: F.struct((k * step).alias("start"), F.substring(c, k * step + 1, F.lit(size)).alias("text")))


def around(c: Column, word: Column | str, reach: int) -> Column:
    """The text up to reach characters before and after the first place of word; the whole text where it isn't."""
    w = F.lit(word) if isinstance(word, str) else word
    at = F.instr(c, w) if isinstance(word, str) else F.locate(word, c)
    start = F.greatest(at - reach, F.lit(1))
    return F.when(at > 0, F.substring(c, start, at + F.length(w) + reach - start)).otherwise(c)


def tier(c: Column, tiers: list[tuple[str, str]], default: str) -> Column:
    """The name of the first tier of (name, pattern) that c matches."""
    out = F.lit(default)
    for name, pattern in reversed(tiers):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def packed(parts: Column, most: int) -> Column:
    """Greedy packing: parts are put together, with newlines, while a pack has at most `most` characters."""
    start = F.array().cast("array<string>")
    full = lambda acc, p: F.length(F.element_at(acc, -1)) + 1 + F.length(p) > most
    more = lambda acc, p: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit("\n"), p)))
    return F.aggregate(parts, start, lambda acc, p: F.when((F.size(acc) == 0) | full(acc, p), F.concat(acc, F.array(p))).otherwise(more(acc, p)))


def spaced(positions: Column, gap: int) -> Column:
    """Of sorted positions those that are at least gap after the last one kept."""
    start = F.array().cast("array<int>")
    return F.aggregate(positions, start, lambda acc, p: F.when((F.size(acc) == 0) | (p - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(p))).otherwise(acc))
