"""What lines and texts of question banks are: answers, covers, noise, table rows; and their normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions.policy import any_word
from quarrystone.functions.text import cache_key, stripped

# A short text that is an answer by itself; words of answers and of questions.
ANSWER_TOKEN = r"^(?:[A-H](?:\s*[、,，/]\s*[A-H]){0,7}|[√×]|正确|错误|对|错|T|F|\d+(?:\.\d+)?)$"
ANSWER_WORDS = ["答案", "解析", "详解"]
QUESTION_WORDS = ["如图", "求", "已知", "下列", "判断", "计算", "实验", "分析", "选择"]
PICTURE_WORDS = ["图", "图示", "模型", "装置", "几何体", "受力图", "电路图"]
# Accepted media types by file ending, and declared types that say nothing.
MEDIA_TYPES = {
    "pdf": ["application/pdf"],
    "docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"],
    "txt": ["text/plain"],
    "md": ["text/markdown", "text/x-markdown", "text/plain"],
    "tex": ["text/x-tex", "application/x-tex", "text/plain"],
}
UNTOLD_TYPES = ["", "application/octet-stream"]
TABLE_MARKERS = ["simple_table", "complex_table", "wireless_table"]


def without_number(text: Column, number: Column) -> Column:
    """A question's text without its own number before it; ``3.`` is no number of ``3.5``. Null where nothing is left."""
    plain = stripped(F.coalesce(text, F.lit("")))
    quoted = F.concat(F.lit(r"\Q"), F.coalesce(number, F.lit("")), F.lit(r"\E"))
    pattern = F.concat(F.lit(r"^(?:第\s*"), quoted, F.lit(r"\s*题|"), quoted, F.lit(r"(?:\s*[、)]|\s*[.．](?!\s*\d)|\s*[:：](?!\s*\d)))\s*"))
    cut = stripped(F.when(F.coalesce(number, F.lit("")) == "", plain).otherwise(F.regexp_replace(plain, pattern, F.lit(""))))
    return F.nullif(F.when(cut == "", plain).otherwise(cut), F.lit(""))


def looks_like_answer(text: Column) -> Column:
    """Whether a text is an answer only; of several lines every one must be, unless the whole is an answer's token."""

    def line(t: Column) -> Column:
        short = (F.char_length(t) <= 24) & F.rlike(t, F.lit(ANSWER_TOKEN))
        plain = (F.char_length(t) <= 80) & ~any_word(t, QUESTION_WORDS)
        return (t != "") & ~F.contains(t, F.lit("题")) & (short | any_word(t, ANSWER_WORDS) | plain)

    whole = stripped(F.coalesce(text, F.lit("")))
    lines = F.filter(F.transform(F.split(whole, "\n"), stripped), lambda t: t != "")
    return (F.size(lines) > 0) & F.forall(lines, line)


def looks_like_cover(text: Column) -> Column:
    """An examination's cover asks for school, name and class, in one line."""
    return F.rlike(F.coalesce(text, F.lit("")), F.lit("学校[:：].*姓名[:：].*班级[:：]"))


def noisy_line(line: Column) -> Column:
    """Short lines of a page that are remains of drawings or formulas."""
    n = F.char_length(line)
    return ((n > 0) & (n <= 10) & F.contains(line, F.lit("~"))) | ((n > 0) & (n <= 8) & F.rlike(line, F.lit(r"[A-Za-z]{2,}.*[^\w\s\p{L}\p{N}一-鿿]")))


def page_text(text: Column) -> Column:
    """A page's text: control characters and noisy lines gone, spaces collapsed, one empty line at most between others."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    lines = F.transform(F.split(t, "\n"), lambda x: stripped(F.regexp_replace(x, "[ \t　]+", " ")))
    kept = F.array_join(F.filter(lines, lambda x: ~noisy_line(x)), "\n")
    return stripped(F.regexp_replace(kept, "\n{3,}", "\n\n"))


def table_cells(line: Column) -> Column:
    """The cells of a line that stands for a row of a table; null for other lines."""
    plain = stripped(F.coalesce(line, F.lit("")))
    cells = F.filter(F.transform(F.split(F.replace(plain, F.lit("∣"), F.lit("|")), r"\|"), stripped), lambda c: c != "")
    drawn = F.contains(plain, F.lit("∣")) | F.rlike(plain, F.lit(r"\s\|\s"))
    return F.when(drawn & (F.size(cells) >= 2), F.transform(cells, lambda c: F.regexp_replace(c, r"\s+", " ")))


def table_marker(line: Column) -> Column:
    return F.lower(stripped(F.coalesce(line, F.lit("")))).isin(*TABLE_MARKERS)


def media_type(filename: Column, declared: Column) -> Column:
    """The media type of an upload: the declared one if its ending accepts it, the ending's own if none was told, else null."""
    end = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"\.([^./\\]+)$", 1))
    told = F.lower(stripped(F.coalesce(declared, F.lit(""))))
    accepted = F.coalesce(*[F.when(end == e, F.array(*map(F.lit, kinds))) for e, kinds in MEDIA_TYPES.items()])
    return F.when(F.array_contains(accepted, told), told).when(told.isin(*UNTOLD_TYPES), accepted[0])


def cacheable(question: Column, history: Column, has_image: Column) -> Column:
    """Only first questions without image, of six letters or more, can be answered from the cache."""
    return ~has_image & (F.coalesce(F.size(history), F.lit(0)) <= 0) & (F.char_length(cache_key(question)) >= 6)


def recommendation_bonus(question: Column, kind: Column, answer: Column, explanation: Column, images: Column, binding: Column) -> Column:
    """What speaks for a question besides its relevance: whole items, answers, pictures where they are asked for."""

    def if_true(test: Column, gain: float, other: float = 0.0) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), gain).otherwise(other)

    parts = [
        if_true(kind == "question_item", 0.22, -0.05),
        if_true(answer != "", 0.03),
        if_true(explanation != "", 0.03),
        if_true((images > 0) & any_word(question, PICTURE_WORDS), 0.16),
        if_true(binding == "missing_required", -0.08),
    ]
    return F.round(sum(parts[1:], parts[0]), 6)


def beijing_iso(at: Column) -> Column:
    """An instant as local ISO text of Shanghai, which has no summer time."""
    return F.concat(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.to_timestamp_ntz(at.cast("string"))), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))


def expired(expires: Column, now: Column) -> Column:
    """A null expiry never comes."""
    return F.coalesce(expires <= now, F.lit(False))
