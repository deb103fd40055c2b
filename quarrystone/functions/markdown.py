"""Markdown in one form: soft line breaks join, formulas and fences stay."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrystone.functions.text import stripped

# What begins a block of its own, and signs that need no backslash in a formula.
BLOCK_START = r"^(?:#{1,6}\s|[*+-]\s|[0-9]{1,2}(?:\\?\.)\s|[0-9]{1,2}[)）]\s|>\s|```|~~~|\|)"
BLOCK_STARTS = re.compile(BLOCK_START.replace(r"\s", r"[^\S\x1c-\x1f]"))
PLAIN_SIGNS = r"\\([_=.#])"
#: Not behind an odd number of backslashes; looked at only where a formula may begin or end, as looking back costs much at every place.
FREE = r"(?=[$\\])(?<!(?<!\\)(?:\\\\){0,12}\\)"
CODE = r"```.*?```"
FORMULAS = (("$$", r"\$\$", r"\$\$"), (r"\[", r"\\\[", r"\\\]"), (r"\(", r"\\\(", r"\\\)"), ("$", r"\$(?!\$)", r"\$"))
SPAN = "|".join([CODE, *[f"{FREE}{begin}.*?{FREE}{end}" for _, begin, end in FORMULAS]])


def spans(text: Column) -> Column:
    """The text in order as protected spans (behind a ``\\x1f``) and what stands between them."""
    marked = F.regexp_replace(F.translate(text, "\x1e\x1f", ""), f"(?s)({SPAN})", "\x1e\x1f$1\x1e")
    return F.filter(F.split(marked, "\x1e"), lambda t: t != "")


def formula(token: Column) -> Column:
    """A formula with single spaces and without needless backslashes; code as it is."""
    out = token
    for opening, _, _ in reversed(FORMULAS):
        n = len(opening)
        closing = opening.translate({ord("["): "]", ord("("): ")"})
        body = F.substring(token, n + 1, F.char_length(token) - 2 * n)
        clean = stripped(F.regexp_replace(F.regexp_replace(body, PLAIN_SIGNS, "$1"), r"(?U)\s+", " "))
        out = F.when(F.startswith(token, F.lit(opening)) & F.endswith(token, F.lit(closing)) & (F.char_length(token) >= 2 * n), F.concat(F.lit(opening), clean, F.lit(closing))).otherwise(out)
    return out


def joined_lines(text: str) -> str:
    """See ``soft_breaks_joined``."""
    out: list[str] = []
    now: list[str] = []
    fenced = False
    for line in map(str.strip, text.split("\n")):
        fence = line.startswith(("```", "~~~"))
        begins = not (fence or fenced) and BLOCK_STARTS.match(line) is not None
        if line and not (fence or fenced or begins):
            now.append(line)
            continue
        if now:
            out.append(" ".join(now))
        now = [line] if begins else []
        if line and not begins:
            out.append(line)
        elif not line and out and out[-1]:
            out.append("")
        fenced ^= fence
    return "\n".join([*out, " ".join(now)] if now else out)


@F.pandas_udf(StringType())
def soft_breaks_joined(texts: pd.Series) -> pd.Series:
    """Lines of a paragraph as one; empty lines, fences and what stands in them, lists, headings, quotes and tables begin anew.

    A line is looked at once: a column of arrays would be copied for each of its lines.
    """
    return texts.map(joined_lines)


def normalised_markdown(text: Column) -> Column:
    """One form of a Markdown text; null is empty. An opener without its end protects nothing."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    t = F.replace(t, F.lit("\xa0"), F.lit(" "))
    t = F.array_join(F.transform(spans(t), lambda s: F.when(F.startswith(s, F.lit("\x1f")), formula(F.substring(s, F.lit(2), F.char_length(s)))).otherwise(s)), "")
    t = soft_breaks_joined(F.replace(t, F.lit("\\."), F.lit(".")))
    for pattern, new in ((r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        t = F.regexp_replace(t, pattern, new)
    return stripped(t)
