"""Retrieved chunks as labelled context."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions.text import stripped

# Names of kinds of material, of levels and of grades.
MATERIALS = {"knowledge_note": "知识讲义", "textbook": "教材", "exercise": "习题例题", "question_set": "题库试卷", "extension": "拓展资料"}
LEVELS = {"basic": "基础", "standard": "标准", "advanced": "提高", "challenge": "挑战"}
GRADES = {1: "高一", 2: "高二", 3: "高三"}
OTHER_MATERIAL, OTHER_GRADE, PIECE, WITH_PICTURES = "资料", "{}年级", "资料片段 {}", "含图片"


def named(value: Column, names: Mapping[object, str], otherwise: Column) -> Column:
    """The name of a value, or what stands for those without one; null stays null."""
    given = [F.when(value == F.lit(k), F.lit(v)) for k, v in names.items()]
    return F.when(value.isNotNull(), F.coalesce(*given, otherwise))


def filled(value: Column) -> Column:
    """A text that says something, else null."""
    return F.when(stripped(value) != "", value)


def around(template: str, value: Column) -> Column:
    """A value within a template's text; null where it is null."""
    before, after = template.split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def pages(first: Column, last: Column) -> Column:
    """One page, or the range of pages, where both ends are known and not zero."""
    one, two = (x.cast("string") for x in (first, last))
    return F.when((first != 0) & (last != 0), F.when(first == last, F.concat(F.lit("p"), one)).otherwise(F.concat(F.lit("p"), one, F.lit("-"), two)))


def labels(kind: Column, grade: Column, chapter: Column, section: Column, level: Column, number: Column, first: Column, last: Column, pictures: Column) -> Column:
    """What a chunk is, in the order of a reader's interest; parts without a value are left out, a chunk without a kind is a note."""
    parts = [
        named(F.coalesce(filled(kind), F.lit("knowledge_note")), MATERIALS, F.lit(OTHER_MATERIAL)),
        named(F.when(grade != 0, grade), GRADES, around(OTHER_GRADE, grade)),
        filled(chapter),
        filled(section),
        around("难度:{}", named(filled(level), LEVELS, level)),
        around("第{}题", F.when(number != 0, number)),
        pages(first, last),
        F.when(pictures, F.lit(WITH_PICTURES)),
    ]
    return F.filter(F.array(*parts), lambda t: t.isNotNull())


def piece(place: Column, about: Column, content: Column) -> Column:
    """A chunk under its place and labels; without content the labels alone."""
    head = F.array_join(F.concat(F.array(around(PIECE, place)), about), " | ")
    return F.concat(F.lit("["), head, F.lit("] "), F.coalesce(content, F.lit("")))


def context(place: Column, text: Column) -> Column:
    """An aggregate: the few retrieved pieces of a question, by place, an empty line between them."""
    rows = F.array_sort(F.collect_list(F.struct(place.alias("place"), text.alias("text"))))
    return F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n")
