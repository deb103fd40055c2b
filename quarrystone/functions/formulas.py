"""Formulas as layout parsers print them: spacing repaired, also within text and table lines; rows with two numbers in a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions.banks import let
from quarrystone.functions.text import stripped

# What is rewritten, in this order.
SPACING = (
    (r"\s+", " "),
    (r"\\overbar", r"\\overline"),
    (r"\^\{'\}", "'"),
    (r"\\(begin|end)\s*\{\s*([A-Za-z*]+)\s*\}", r"\\$1{$2}"),
    (r"\s*([_^])\s*\{\s*", "$1{"),
    (r"\}\s+\{", "}{"),
    (r"\s+\}", "}"),
    (r"\\([A-Za-z]+)\s+\{", r"\\$1{"),
    (r"\{\s+", "{"),
    (r"(?<=\d)\s*\.\s*(?=\d)", "."),
    (r"(?<=\d)\s+(?=\d)", ""),
    (r"\^\{(-?)\s*(\d+)\}", "^{$1$2}"),
    (r"\\mathrm\{\{([^{}]+)\}\s*([^}]*)\}", r"\\mathrm{$1$2}"),
    (r"(\\mathrm\{|(?!^)\G)([^}\s]*)\s+(?=[^}]*\})", "$1$2"),
    (r"\\\\\s*\{\{\s*\\\s*\}\}\s*\\\\", r"\\\\"),
    (r"\\\\\s*\{\s*\\\s*\}\s*\\\\", r"\\\\"),
    (r"\\\\\s*\{\s*\}\s*\\\\", r"\\\\"),
)
NUMBER = r"[+-]?\d+(?:\.\d+)?"


def spaced(formula: Column) -> Column:
    """A formula without its marks, its spaces in one form; brackets that a first ``\\mathrm`` leaves open are closed. Null stays null."""
    t = stripped(formula)
    for pattern, new in SPACING:
        t = F.regexp_replace(t, f"(?U){pattern}", new)
    count = lambda sign: F.char_length(t) - F.char_length(F.replace(t, F.lit(sign), F.lit("")))
    missing = count("(") - count(")")
    closed = F.concat(F.substring(t, F.lit(1), F.char_length(t) - 1), F.repeat(F.lit(")"), missing), F.lit("}"))
    return stripped(F.when(F.startswith(t, F.lit(r"\mathrm{(")) & (missing > 0) & F.endswith(t, F.lit("}")), closed).otherwise(t))


def fragments_spaced(text: Column) -> Column:
    """Text whose formulas between dollars are spaced, and all its spaces single."""
    pieces = F.split(F.regexp_replace(F.translate(text, "\x1e\x1f", ""), r"\$(.+?)\$", "\x1e\x1f$1\x1e"), "\x1e")
    done = F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("\x1f")), F.concat(F.lit("$"), spaced(F.substring(p, F.lit(2), F.char_length(p))), F.lit("$"))).otherwise(p))
    return stripped(F.regexp_replace(F.array_join(done, ""), r"(?U)\s+", " "))


def is_table_line(line: Column) -> Column:
    """Two cells or more between bars: ``∣`` anywhere, or ``|`` with spaces around."""
    cells = F.filter(F.split(F.translate(line, "∣", "|"), r"\|"), lambda c: stripped(c) != "")
    bars = F.contains(line, F.lit("∣")) | F.rlike(line, F.lit(r"(?U)\s\|\s"))
    return F.coalesce(bars & (F.size(cells) >= 2), F.lit(False))


def table_line(line: Column) -> Column:
    """Cells without empty ones, formulas between dollars spaced, one bar between two."""
    cells = F.transform(F.split(F.translate(line, "∣", "|"), r"\|"), lambda c: fragments_spaced(c))
    return F.array_join(F.filter(cells, lambda c: c != ""), " | ")


def sparse_row(cells: Column) -> Column:
    """Cells of a row, two numbers in its last filled cell taken apart where a cell before it is no number.

    The second takes the place of an empty last cell, else it becomes a new
    one. Rows of fewer than three cells stay, as does null.
    """
    n = F.size(cells)
    empty = stripped(F.element_at(cells, -1)) == ""
    at = F.when(empty, n - 1).otherwise(n)

    def taken_apart(both: Column) -> Column:
        before = F.slice(cells, F.lit(1), at - 1)
        numbers = F.split(both, r"(?U)\s+")
        holds = F.rlike(both, F.lit(rf"(?U)^{NUMBER}\s+{NUMBER}$")) & F.exists(before, lambda c: ~F.rlike(stripped(c), F.lit(f"(?U)^{NUMBER}$")))
        return F.when(holds, F.concat(before, numbers)).otherwise(cells)

    return F.when(n >= 3, let(stripped(F.element_at(cells, at)), taken_apart)).otherwise(cells)
