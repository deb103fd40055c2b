"""Answers, explanations and headings as sections of a text; layout of questions for reading."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions.policy import any_word
from quarrystone.functions.text import let, squeezed, stripped, structure_key

# Heads of sections in answer banks, and lines of banks that belong to neither section.
ANSWER_HEAD = r"【?(?:参考)?答案】?\s*(?:[:：]\s*)?"
EXPLANATION_HEAD = r"【?(?:解析|详解|解答|思路(?:点拨)?|点拨|说明|分析|点睛)】?\s*(?:[:：]\s*)?"
EXPLANATION_MARK = r"【?(?:解析|详解|解答|思路(?:点拨)?|点拨|说明|分析|点睛)】?\s*[:：]"
OTHER_HEAD = r"【?(?:难度|知识点)】?"
QUESTION_START = r"\s*(?:第\s*\d+\s*题|\d{1,3}(?:\s*[.．、)]|\s*[:：](?!\s*\d))|[（(]\d{1,3}[)）])"
JUDGEMENTS = ["正确", "错误", "对", "错", "√", "×", "T", "F"]
# Headings of chapters and sections, and what no heading is.
NUMERAL = "[一二三四五六七八九十百零两0-9]+"
CHAPTER_HEADINGS = [rf"第{NUMERAL}(?:章|单元|编|部分)(?:\s*[-—－:：]?\s*\S.*)?", rf"专题{NUMERAL}.*", r"(?i:Unit)\s+\d+.*"]
SECTION_HEADINGS = [rf"第{NUMERAL}(?:节|课)(?:\s*[-—－:：]?\s*\S.*)?", r"[0-9]{1,2}(?:\.[0-9]{1,2})+\s*\S.*", r"[0-9]{1,2}[.．、]\s*\S.*", rf"[（(]{NUMERAL}[)）]\s*\S.*", r"[A-Za-z][.、]\s*\S.*"]
#: How each of these headings and of BACK_MATTER begins.
MAY_BE_HEADING = r"(?U)^[\s\x1c-\x1f]*(?:第|专题|(?i:Unit)|[0-9]{1,2}[.．、]|[（(]|[A-Za-z][.、]|课题研究|学生实验|索引|后记|附录)"
QUESTION_HINTS = ["？", "?", "求", "多少", "下列", "正确", "错误", "判断", "计算", "解答", "写出", "指出", "求出"]
BACK_MATTER = ["课题研究", "学生实验", "索引", "后记", "附录"]
SENTENCE_SIGNS = ["，", "；", "。", "！", "？", ",", ";", "!", "?", "“", "”", '"', "‘", "’"]
STRUCTURED_KINDS = ["knowledge_note", "textbook", "exercise", "question_set"]


def any_line(text: Column, *heads: str) -> Column:
    """Whether a line of a squeezed text begins with one of the heads."""
    return F.rlike(text, F.lit(f"(?dmU)^(?:{'|'.join(heads)})"))


def _filled(text: Column) -> Column:
    """Stripped; null where nothing is left."""
    return let(stripped(text), lambda t: F.when(t != "", t))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), stripped), lambda t: t != "")


def answer_sections(text: Column) -> Column:
    """The answer and the explanation of a part of an answer bank, null where there is none.

    Lines before any head are answers; lines of difficulty and topics belong to
    neither. Without a section of its own an explanation begins at its mark
    within the answer, or after white space of the answer's last line.
    """
    cut = lambda t, head: F.regexp_replace(t, f"(?U)^{head}", "")
    begins = lambda t, head: F.rlike(t, F.lit(f"(?U)^{head}"))

    def step(acc: Column, line: Column) -> Column:
        is_answer = begins(line, ANSWER_HEAD)
        is_why = ~is_answer & begins(line, EXPLANATION_HEAD)
        now = F.when(is_answer, False).when(is_why, True).otherwise(acc["why"])
        body = F.when(is_answer, cut(line, ANSWER_HEAD)).when(is_why, cut(line, EXPLANATION_HEAD)).otherwise(line)
        grown = lambda name, mine: F.when(mine & (body != ""), F.concat(acc[name], F.array(body))).otherwise(acc[name])
        return F.struct(now.alias("why"), grown("a", ~now).alias("a"), grown("e", now).alias("e"))

    none = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("why"), none.alias("a"), none.alias("e"))

    def whole(acc: Column) -> Column:
        return let(_filled(F.array_join(acc["a"], "\n")), lambda answer: let(_filled(F.array_join(acc["e"], "\n")), lambda why: told(answer, why)))

    def told(answer: Column, why: Column) -> Column:
        after = f"(?dU)^(.*?)\\s+({EXPLANATION_HEAD}.+)$"
        marked = why.isNull() & F.rlike(answer, F.lit(f"(?U){EXPLANATION_MARK}"))
        spaced = why.isNull() & ~marked & F.rlike(answer, F.lit(after.replace(".*?", ".+?")))
        rest = lambda t: F.coalesce(_filled(cut(t, EXPLANATION_HEAD)), _filled(t))
        first = F.regexp_extract(answer, f"(?sU)^(.*?)({EXPLANATION_MARK}.*)$", 1)
        second = F.regexp_extract(answer, f"(?sU)^(.*?)({EXPLANATION_MARK}.*)$", 2)
        inline = after.replace(".*?", ".+?")
        return F.struct(
            F.when(marked, _filled(first)).when(spaced, _filled(F.regexp_extract(answer, inline, 1))).otherwise(answer).alias("answer"),
            F.when(marked, rest(second)).when(spaced, rest(F.regexp_extract(answer, inline, 2))).otherwise(why).alias("explanation"),
        )

    def of(t: Column) -> Column:
        kept = F.filter(_lines(t), lambda x: ~begins(x, OTHER_HEAD))
        # Without heads, and explanations within lines, the whole text is the answer.
        headed = F.rlike(t, F.lit(f"(?dmU)^(?:{ANSWER_HEAD}|{OTHER_HEAD})|{EXPLANATION_HEAD}"))
        return F.when(headed, F.aggregate(kept, start, step, whole)).otherwise(F.struct(F.nullif(t, F.lit("")).alias("answer"), F.lit(None).cast("string").alias("explanation")))

    return let(squeezed(text), of)


def numbered_entries(text: Column, numbers: Column) -> Column:
    """For each expected number its last entry in a text, null where it has none: array of (number, entry).

    An entry begins at one of the numbers with a dot or bracket behind it, or
    at 第n题 after white space or the end of a sentence, and goes on to the
    next beginning of any expected number.
    """
    wanted = F.filter(F.array_distinct(F.transform(numbers, stripped)), lambda n: n != "")

    def filled(wanted: Column) -> Column:
        longest_first = F.array_sort(wanted, lambda a, b: F.char_length(b) - F.char_length(a))
        any_number = F.array_join(F.transform(longest_first, lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))), "|")
        begin = F.concat(F.lit("(?U)(?:("), any_number, F.lit(r")\s*[.．、)]|(?<![^\s；;。])第\s*("), any_number, F.lit(r")\s*题)"))
        parts = F.split(F.regexp_replace(stripped(F.coalesce(text, F.lit(""))), begin, F.lit("\x1e$1$2\x1f")), "\x1e")
        cells = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("\x1f"))), lambda p: F.split(p, "\x1f"))
        return F.filter(cells, lambda c: stripped(c[1]) != "")

    def entry(n: Column, cells: Column) -> Column:
        return F.struct(n.alias("number"), stripped(F.try_element_at(F.filter(cells, lambda c: c[0] == n), F.lit(-1))[1]).alias("entry"))

    # The text is searched once, not anew for each number.
    return let(wanted, lambda ns: let(filled(ns), lambda cells: F.transform(ns, lambda n: entry(n, cells))))


def readable(text: Column) -> Column:
    """Choices on lines of their own, an empty line before numbered parts, never two."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\t"), F.lit("\n"))
    t = F.regexp_replace(t, r"(?U)(?<!\n)(?=[A-HTtFf]\s*[．.、])", "\n")
    t = F.regexp_replace(t, r"\n(?=[（(][0-9]{1,2}[)）])", "\n\n")
    return stripped(F.regexp_replace(t, "\n{3,}", "\n\n"))


def judgement_lines(question: Column, answer: Column) -> Column:
    """Judgements of a question's numbered parts, a line each, where every part has one; other answers as they are."""
    plain = _filled(answer)
    parts = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"[（(]([0-9]{1,2})[)）]"), F.lit(1))
    words = F.split(plain, r"(?U)\s+")
    fits = ~F.contains(plain, F.lit("\n")) & (F.size(parts) >= 2) & (F.size(parts) == F.size(words)) & F.forall(words, lambda w: w.isin(*JUDGEMENTS))
    return F.when(fits, F.array_join(F.zip_with(parts, words, lambda n, w: F.concat(F.lit("（"), n, F.lit("）"), w)), "\n")).otherwise(plain)


def without_formula_marks(text: Column) -> Column:
    """Lines that only name a formula go, and so does a picture's path behind one; other lines behind one are stripped."""

    def step(acc: Column, line: Column) -> Column:
        plain = stripped(line)
        mark = F.lower(plain).isin("equation_inline", "equation_display")
        path = F.rlike(plain, F.lit(r"^(?i)images?/[^ \n]+\.(?:png|jpg|jpeg|webp)$"))
        own = (plain == "") | F.rlike(plain, F.lit(f"(?U)^{QUESTION_START}"))
        taken = acc["after"] & ~own
        goes = F.when(taken, path).otherwise(mark)
        out = F.when(goes, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.when(taken, plain).otherwise(line))))
        return F.struct(out.alias("out"), (~taken & mark).alias("after"))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda t: F.regexp_replace(t, r"(?U)\s+$", ""))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("after"))
    return F.array_join(F.aggregate(lines, start, step, lambda acc: acc["out"]), "\n")


def sentence_like(line: Column) -> Column:
    """Lines of a textbook that are sentences, quotations, or too short behind their number."""
    body = F.regexp_replace(line, r"(?U)^\s*(?:[（(]?\d+[)）]?|第\s*\d+\s*题|\d+\s*[.．、:：)])\s*", "")
    return (line != "") & (any_word(line, SENTENCE_SIGNS) | (F.char_length(stripped(body)) <= 3))


def heading(text: Column, kind: Column) -> Column:
    """The chapter or section that a chunk's first three lines open: (chapter, section), at most one of them filled."""
    textbook = kind == "textbook"
    hints = F.lit("|".join(map(re.escape, QUESTION_HINTS)))
    matches = lambda t, patterns: F.rlike(t, F.lit(r"(?U)^(?:" + "|".join(patterns) + ")$"))
    part = lambda chapter, section: F.struct(chapter.alias("chapter"), section.alias("section"))
    null = F.lit(None).cast("string")

    def of_line(t: Column) -> Column:
        possible = ~F.endswith(t, F.lit("。")) & (F.char_length(t) <= 48)
        chapter = possible & ((textbook & t.isin(*BACK_MATTER)) | matches(t, CHAPTER_HEADINGS))
        section = possible & matches(t, SECTION_HEADINGS) & ~F.rlike(t, hints) & ~(textbook & sentence_like(t))
        return F.when(chapter, part(t, null)).when(section, part(null, t))

    found = F.filter(F.transform(F.slice(_lines(text), 1, 3), of_line), lambda x: x.isNotNull())
    # One line needs no list of lines, and most begin like no heading.
    first = F.when(F.contains(text, F.lit("\n")), F.try_element_at(found, F.lit(1))).when(F.rlike(text, F.lit(MAY_BE_HEADING)), let(stripped(text), of_line))
    return F.when(kind.isin(*STRUCTURED_KINDS), first)


def title_key(title: Column) -> Column:
    """The key of a title under which entries of a catalogue are found; null where nothing is left."""
    return F.nullif(structure_key(F.coalesce(title, F.lit(""))), F.lit(""))
