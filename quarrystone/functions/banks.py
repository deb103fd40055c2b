"""Texts of answer banks: sections of a question, one form for all banks, and what answers a repeated bank gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions.answers import looks_like_answer
from quarrystone.functions.sections import ANSWER_HEAD, EXPLANATION_HEAD, OTHER_HEAD, QUESTION_START, any_line
from quarrystone.functions.text import let, squeezed, stripped

# How an entry within a line begins, and the mark of an explanation in the normal form.
ENTRY_START = r"(?:第\s*\d+\s*题|\d{1,3}\s*[.．、)])"
EXPLAINED = "解析："
# White space, and such that ends no line.
SPACE, LINE_SPACE = r"\s", r"[\s&&[^\n]]"
#: The number in QUESTION_START, whichever form it has.
FIRST_NUMBER = r"(?U)^\D*(\d+)"


def filled(text: Column) -> Column:
    return F.nullif(stripped(text), F.lit(""))


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), stripped), lambda t: t != "")


def begins(text: Column, head: str) -> Column:
    return F.rlike(text, F.lit(f"(?U)^{head}"))


def behind(text: Column, head: str) -> Column:
    """What stands behind a head."""
    return stripped(F.regexp_replace(text, f"(?U)^{head}", ""))


def headed(line: Column) -> Column:
    """Whether a line begins with the head of an answer or of an explanation, and what stands behind that."""
    answer = begins(line, ANSWER_HEAD)
    why = ~answer & begins(line, EXPLANATION_HEAD)
    body = F.when(answer, behind(line, ANSWER_HEAD)).when(why, behind(line, EXPLANATION_HEAD)).otherwise(line)
    return F.struct(answer.alias("answer"), why.alias("why"), body.alias("body"))


def halves(text: Column, head: str, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of a squeezed text before its first line with this head, and from there on without the heads, null if empty."""

    def of(before: Column) -> Column:
        rest = squeezed(F.regexp_replace(F.substr(text, F.char_length(before) + 1), f"(?dmU)^{head.replace(SPACE, LINE_SPACE)}", ""))
        return use(F.rtrim(before, F.lit("\n")), let(rest, lambda t: F.when(t != "", t)))

    return let(F.regexp_replace(text, rf"(?dmU)^(?:{head})[\s\S]*", ""), of)


def question_sections(text: Column) -> Column:
    """(question, answer, explanation) of a question's lines: each line belongs to the last head before it.

    Lines of difficulty and topics belong to none. The question is never null, the others are where they are empty.
    """

    def step(acc: Column, line: Column) -> Column:
        return let(headed(line), lambda h: added(acc, F.when(h["answer"], 1).when(h["why"], 2).otherwise(acc["now"]), h["body"]))

    def added(acc: Column, now: Column, body: Column) -> Column:
        grown = [F.when((now == i) & (body != ""), F.concat(acc[c], F.array(body))).otherwise(acc[c]).alias(c) for i, c in enumerate("qae")]
        return F.struct(now.alias("now"), *grown)

    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("now"), *[none.alias(c) for c in "qae"])
    null = F.lit(None).cast("string")
    parts = lambda q, a, e: F.struct(q.alias("question"), a.alias("answer"), e.alias("explanation"))
    joined = lambda acc, c: stripped(F.array_join(acc[c], "\n"))
    whole = lambda acc: parts(joined(acc, "q"), F.nullif(joined(acc, "a"), F.lit("")), F.nullif(joined(acc, "e"), F.lit("")))

    def of(t: Column) -> Column:
        # Line by line only where heads of several kinds take turns.
        kept = F.filter(lines_of(t), lambda x: ~begins(x, OTHER_HEAD))
        return (
            F.when(~any_line(t, ANSWER_HEAD, EXPLANATION_HEAD, OTHER_HEAD), parts(t, null, null))
            .when(~any_line(t, EXPLANATION_HEAD, OTHER_HEAD), halves(t, ANSWER_HEAD, lambda asked, answer: parts(asked, answer, null)))
            .otherwise(F.aggregate(kept, start, step, whole))
        )

    return let(squeezed(text), of)


def entries_of(line: Column) -> Column:
    """The numbered entries of a line: two or more that begin after white space (what stands before the first goes), or the line if it begins with a number."""
    parts = F.filter(F.split(line, rf"(?U)(?<=^|\s)(?={ENTRY_START})", -1), lambda p: begins(p, ENTRY_START))
    several = F.filter(F.transform(parts, stripped), lambda p: p != "")
    alone = F.when(begins(line, QUESTION_START), F.array(line)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(parts) > 1, several).otherwise(alone)


def explained(entry: Column) -> Column:
    """An entry among explanations in normal form; one that has an answer's head within is an answer."""
    number = F.regexp_extract(entry, FIRST_NUMBER, 1)
    body = behind(entry, QUESTION_START)
    is_answer = begins(body, ANSWER_HEAD)
    return (
        F.when(~begins(entry, QUESTION_START), F.concat(F.lit(EXPLAINED), entry))
        .when(is_answer, stripped(F.concat(number, F.lit(". "), behind(body, ANSWER_HEAD))))
        .otherwise(F.concat(number, F.lit(f". {EXPLAINED}"), body))
    )


def normalised_bank(text: Column) -> Column:
    """A bank as lines that begin with an entry's number, explanations marked as such; empty for null.

    A head opens a section, whose entries may stand in its line; a line without
    number goes on with the entry before it, whatever its section.
    """

    def step(acc: Column, line: Column) -> Column:
        return let(headed(line), lambda h: let(entries_of(h["body"]), lambda found: added(acc, line, h, found)))

    def added(acc: Column, line: Column, h: Column, found: Column) -> Column:
        now = F.when(h["answer"], False).when(h["why"], True).otherwise(acc["why"])
        head, body, out = h["answer"] | h["why"], h["body"], acc["out"]
        n = F.size(out)
        shown = F.when(now, F.transform(found, explained)).otherwise(found)
        plain = F.array(F.when(h["why"], F.concat(F.lit(EXPLAINED), body)).otherwise(body))
        longer = F.concat(F.slice(out, F.lit(1), n - 1), F.array(F.concat(F.element_at(out, -1), F.lit("\n"), line)))
        new = F.when(head & (body == ""), out).when(F.size(found) > 0, F.concat(out, shown)).when(~head & (n > 0), longer).otherwise(F.concat(out, plain))
        return F.struct(now.alias("why"), new.alias("out"))

    start = F.struct(F.lit(False).alias("why"), F.array().cast("array<string>").alias("out"))

    def of(t: Column) -> Column:
        # Without heads and without entries within lines it has that form.
        inner = F.rlike(t, F.lit(f"(?U){LINE_SPACE}(?:{ENTRY_START})"))
        return F.when(any_line(t, ANSWER_HEAD, EXPLANATION_HEAD) | inner, F.array_join(F.aggregate(lines_of(t), start, step, lambda acc: acc["out"]), "\n")).otherwise(t)

    return let(squeezed(text), of)


def at_mark(text: Column, why: Column) -> Column:
    """(text, why): without an explanation, the text is cut where one begins behind white space."""
    pattern = f"(?dU)^(.+?)\\s+({EXPLANATION_HEAD}.+)$"
    cut = why.isNull() & F.rlike(text, F.lit(pattern))
    rest = F.regexp_extract(text, pattern, 2)
    return F.struct(
        F.when(cut, filled(F.regexp_extract(text, pattern, 1))).otherwise(text).alias("text"),
        F.when(cut, F.coalesce(F.nullif(behind(rest, EXPLANATION_HEAD), F.lit("")), filled(rest))).otherwise(why).alias("why"),
    )


def answer_payload(text: Column) -> Column:
    """(answer, explanation) if a block is but an answer to a question asked before, else both null."""

    def kept(question: Column, answer: Column, why: Column, only: Column) -> Column:
        given, refused = answer.isNotNull() | why.isNotNull(), question.isNotNull() & ~only
        return F.struct(
            F.when(given & answer.isNull() & only, question).when(given & ~refused, answer).when(~given & only, question).alias("answer"),
            F.when(given & (~refused | (answer.isNull() & only)), why).alias("explanation"),
        )

    def of_cuts(first: Column, second: Column) -> Column:
        return let(F.coalesce(looks_like_answer(second["text"]), F.lit(False)), lambda only: kept(second["text"], first["text"], second["why"], only))

    def of_parts(parts: Column) -> Column:
        question = F.nullif(parts["question"], F.lit(""))
        return let(at_mark(parts["answer"], parts["explanation"]), lambda first: let(at_mark(question, first["why"]), lambda second: of_cuts(first, second)))

    return let(question_sections(text), of_parts)


def composed(number: Column, question: Column, answer: Column, explanation: Column) -> Column:
    """A question's text for reading: its number, and the parts that it has."""
    part = lambda name, t: F.when(filled(t).isNotNull(), F.concat(F.lit(f"{name}：\n"), stripped(t)))
    return stripped(F.concat_ws("\n\n", F.concat(F.lit("第"), number, F.lit("题")), F.concat(F.lit("题目：\n"), stripped(F.coalesce(question, F.lit("")))), part("答案", answer), part("解析", explanation)))
