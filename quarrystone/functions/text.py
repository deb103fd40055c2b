"""Text functions as Column builders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\u4e00-\\u9fff"
#: White space of any script, and the separators of ASCII.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def stripped(text: Column) -> Column:
    """Without outer white space of any script."""
    return F.btrim(text, F.lit(SPACES))


def squeezed(text: Column) -> Column:
    """Lines without outer white space and without empty ones; empty for null."""
    t = F.coalesce(text, F.lit(""))
    # Each run of white space is looked at once, from its beginning.
    return stripped(F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, r"(?U)(?<![\s\x1c-\x1f])[\s\x1c-\x1f&&[^\n]]*+\n[\s\x1c-\x1f]*", "\n")).otherwise(t))


def collapsed(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def structure_key(text: Column) -> Column:
    """Lower case, full-width signs as half-width, separators and brackets gone."""
    wide = "（）［］，．：；　" + "".join(chr(0xFF10 + i) for i in range(10))
    half = "()[],.:; 0123456789"
    return F.regexp_replace(F.translate(F.lower(text), wide, half), r"[\s\-_.,:;()\[\]<>]", "")


def cache_key(text: Column) -> Column:
    """Lower case, words and CJK characters only."""
    return F.regexp_replace(F.lower(text), rf"(?U)[^\w{CJK}]+", "")


def bigrams(text: Column) -> Column:
    """Pairs of successive characters; one character is itself, none gives none.

    From an array of characters: a place in a string is only found by reading
    it from its start.
    """
    chars = F.filter(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), ""), lambda c: c != "")
    n = F.size(chars)
    pairs = F.zip_with(F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1), lambda a, b: F.concat(a, b))
    return F.when(n > 1, pairs).otherwise(chars)


def bucket(token: Column, buckets: int) -> Column:
    """The first four bytes of a token's SHA-256, modulo the number of buckets."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def fingerprint(text: Column) -> Column:
    """Twelve hexadecimal digits of SHA-1."""
    return F.substring(F.sha1(text), 1, 12)


def token_estimate(text: Column) -> Column:
    """CJK characters and a quarter of the others, at least 1."""
    others = F.char_length(F.regexp_replace(text, f"[{CJK}]", ""))
    return F.greatest(F.char_length(text) - others + F.ceil(others / 4), F.lit(1)).cast("long")


def quality(text: Column) -> Column:
    """Shares of letters and digits and of white space, and a bonus for length; bad characters count against."""
    n = F.char_length(text)
    of = lambda keep: F.char_length(F.regexp_replace(text, keep, "")) / n
    score = of("[^A-Za-z0-9]") + 0.2 * of("[^ \n]") - 2.0 * of("[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]") + F.least(n / 2000, F.lit(1.0)) * 0.5
    return F.when(n > 0, F.round(score, 6)).otherwise(F.lit(0.0))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, cells are joined by bars, blocks end lines."""
    steps = [
        (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""),
        (r"(?s)<!--.*?-->", ""),
        (r"(?i)</t[dh]>\s*<t[dh][^>]*>", " | "),
        (r"(?i)</?(p|div|br|li|ul|tr|table|h[1-6]|article|nav|header|footer|section|title)[^>]*>", "\n"),
        (r"<[^>]*>", ""),
        (r"[ \t]+", " "),
        (r" ?\n[ \n]*", "\n"),
    ]
    for pattern, by in steps:
        html = F.regexp_replace(html, pattern, by)
    return F.btrim(html, F.lit(" \n"))


def tag_list(text: Column, longest: int = 32, most: int = 20) -> Column:
    """Tags of a comma or line separated list: trimmed, cut, first spelling of each, at most ``most``."""
    parts = F.filter(F.transform(F.split(text, "[,，\n]"), lambda t: F.substring(F.trim(t), 1, longest)), lambda t: t != "")
    empty = F.array().cast("array<string>")
    fold = F.aggregate(parts, empty, lambda a, t: F.when(F.exists(a, lambda x: F.lower(x) == F.lower(t)), a).otherwise(F.concat(a, F.array(t))))
    return F.slice(fold, 1, most)


def flags(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Names of the rules whose pattern is found, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(F.rlike(text, F.lit(p)), F.lit(False)), F.lit(name)) for name, p in rules]), lambda x: x.isNotNull())


def first_subject(text: Column, cues: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first subject in order one of whose cues the text has."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(name)) for name, words in cues])


def topic(text: Column, prefixes: Sequence[str], longest: int = 22) -> Column:
    """Without the first of the prefixes that it has and outer punctuation, shortened."""
    cut = F.regexp_replace(text, "^(?:" + "|".join(prefixes) + ")", "")
    cut = F.regexp_replace(cut, r"^[\s,.:;!?]+|[\s,.:;!?]+$", "")
    return F.when(F.char_length(cut) > longest, F.concat(F.substring(cut, 1, longest), F.lit("..."))).otherwise(cut)


def boilerplate_key(text: Column) -> Column:
    """Without white space and leader signs."""
    return F.regexp_replace(text, r"[\s.·…_-]+", "")


def difficulty(value: Column) -> Column:
    """Bins of a level in words or as a number (over 1: percent)."""
    number = F.expr("try_cast(NULL AS DOUBLE)") if value is None else F.try_to_number(F.regexp_extract(value, r"\d+(\.\d+)?", 0), F.lit("9999.9999")).cast("double")
    scaled = F.when(number > 1, number / 100).otherwise(number)
    return F.when(scaled >= 0.85, "challenge").when(scaled >= 0.70, "advanced").when(scaled >= 0.45, "standard").otherwise("basic")


def chinese_number(text: Column) -> Column:
    """Chinese numerals up to 99, or digits, as an integer; null for anything else."""
    digits = F.translate(text, "零〇一二两三四五六七八九", "001223456789")
    ten = "十"
    before, after = F.substring_index(digits, ten, 1), F.substring_index(digits, ten, -1)
    tens = F.when(before == "", F.lit(1)).otherwise(F.expr("NULL"))
    tens = F.coalesce(tens, before.try_cast("int")) * 10 + F.when(after == "", F.lit(0)).otherwise(after.try_cast("int"))
    return F.when(F.contains(digits, F.lit(ten)), tens).otherwise(digits.try_cast("int"))


def promoted(grade: Column, last_year: Column, now: Column) -> Column:
    """The grade after as many school years (they begin in August) as have passed; null once over 3."""
    year = F.year(now) - F.when(F.month(now) >= 8, 0).otherwise(1)
    new = grade + F.greatest(year - last_year, F.lit(0))
    return F.when(new <= 3, new)
