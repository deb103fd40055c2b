"""Question profiles, relevance from metadata, and formulas as words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions.policy import any_word
from quarrystone.functions.text import collapsed, structure_key

# Kinds of material in the order that each type of question prefers.
PREFERRED = {
    "concept": ["knowledge_note", "textbook", "exercise", "question_set", "extension"],
    "calculation": ["exercise", "question_set", "knowledge_note", "textbook", "extension"],
    "analysis": ["knowledge_note", "textbook", "extension", "exercise", "question_set"],
}
# Cue words of question types, of wide reading and of levels.
CALCULATION_CUES = ["求", "计算", "解", "证明", "推导", "例题", "题目", "真题", "试卷"]
ANALYSIS_CUES = ["分析", "评价", "说明原因", "材料", "比较"]
EXTENSION_CUES = ["物理学史", "生活中的", "拓展", "科学家", "历史", "应用"]
BASIC_CUES = ["基础", "简单", "入门"]
ADVANCED_CUES = ["提高", "综合", "压轴", "竞赛", "难"]

# Formula signs and the words that stand for them, in the order of replacement.
FORMULA_WORDS = [
    ("$$", " "), ("$", " "), (r"\[", " "), (r"\]", " "), (r"\(", " "), (r"\)", " "),
    (r"\cdot", " 点乘 "), (r"\times", " 乘 "), (r"\div", " 除 "), (r"\pm", " 正负 "), (r"\mp", " 负正 "),
    (r"\leq", " 小于等于 "), (r"\geq", " 大于等于 "), (r"\neq", " 不等于 "), (r"\approx", " 约等于 "), (r"\sim", " 相似 "),
    (r"\triangle", " 三角形 "), (r"\angle", " 角 "), (r"\sin", " 正弦 "), (r"\cos", " 余弦 "), (r"\tan", " 正切 "),
    (r"\log", " 对数 "), (r"\ln", " 自然对数 "), (r"\sum", " 求和 "), (r"\int", " 积分 "), (r"\lim", " 极限 "),
    (r"\frac", " 分式 "), (r"\sqrt", " 根号 "), (r"\alpha", " alpha "), (r"\beta", " beta "), (r"\gamma", " gamma "),
    (r"\delta", " delta "), (r"\theta", " theta "), (r"\lambda", " lambda "), (r"\mu", " mu "), (r"\omega", " omega "),
    (r"\pi", " pi "), (r"\Delta", " delta "),
]


def formula_words(text: Column) -> Column:
    """Formulas in words, for embedding; a text that leaves nothing stays as it is."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = reduce(lambda t, w: F.replace(t, F.lit(w[0]), F.lit(w[1])), FORMULA_WORDS, out)
    base = r"([A-Za-z0-9)\]])\s*"
    for pattern, by in (
        (base + r"\^\s*\{?2\}?", "$1 平方 "),
        (base + r"\^\s*\{?3\}?", "$1 立方 "),
        (base + r"_\s*\{?([^{}\s]{1,8})\}?", "$1 下标 $2 "),
        (r"\\[A-Za-z]+|[{}^_]", " "),
    ):
        out = F.regexp_replace(out, pattern, by)
    out = collapsed(out)
    return F.when(out == "", F.trim(text)).otherwise(out)


def question_type(question: Column) -> Column:
    return F.when(any_word(question, CALCULATION_CUES), "calculation").when(any_word(question, ANALYSIS_CUES), "analysis").otherwise("concept")


def prefers_extension(question: Column) -> Column:
    return any_word(question, EXTENSION_CUES)


def desired_difficulty(question: Column) -> Column:
    return F.when(any_word(question, BASIC_CUES), "basic").when(any_word(question, ADVANCED_CUES), "advanced").when(question_type(question) == "calculation", "standard")


def resource_order(question: Column) -> Column:
    """Kinds of material, the most wanted first."""
    kind = question_type(question)
    orders = F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, v))) for k, v in PREFERRED.items()])
    wide = F.concat(F.array(F.lit("extension")), F.array_remove(orders, "extension"))
    return F.when(prefers_extension(question), wide).otherwise(orders)


def metadata_score(question: Column, resource: Column, difficulty: Column, chapter: Column, section: Column, tags: Column) -> Column:
    """What a chunk's metadata add to its relevance: kind, level, chapter, section and tags that the question names."""
    kind = F.coalesce(resource, F.lit("knowledge_note"))
    rank = F.array_position(resource_order(question), kind)
    wanted = desired_difficulty(question)
    low, key = F.lower(question), structure_key(question)
    near = wanted.isin("basic", "standard") & difficulty.isin("basic", "standard")
    parts = [
        F.when(rank > 0, F.greatest(F.lit(0.04), 0.26 - (rank - 1) * 0.05)),
        F.when(prefers_extension(question) & (kind == "extension"), 0.18),
        F.when(kind.isin("exercise", "question_set"), F.when(wanted == difficulty, 0.14).when(near, 0.06)),
        *[F.when((F.trim(c) != "") & (F.contains(low, F.lower(F.trim(c))) | F.contains(key, structure_key(c))), gain) for c, gain in ((chapter, 0.22), (section, 0.16))],
        0.08 * F.size(F.filter(F.slice(F.array_distinct(F.coalesce(tags, F.array().cast("array<string>"))), 1, 8), lambda t: F.contains(low, F.lower(t)))),
    ]
    return F.round(reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts]), 6)


def overlap_bonus(question: Column, text: Column, first: int = 12, by: int = 20) -> Column:
    """The share of the question's first characters that the text has."""
    letters = F.filter(F.split(F.substring(question, 1, first), ""), lambda c: c != "")
    return F.size(F.filter(letters, lambda c: F.contains(text, c))) / by


def grade_score(grades: Column, own: Column, recommend: bool = False) -> Column:
    """A bonus for material of the student's grade, a malus for material of others; nothing without grades."""
    gain, more, loss = (0.52, 0.24, -0.18) if recommend else (0.34, 0.12, -0.10)
    hits = F.size(F.filter(grades, lambda g: g == own))
    return F.when(own.isNull() | (F.coalesce(F.size(grades), F.lit(0)) <= 0), 0.0).when(hits > 0, gain + more * (hits - 1)).otherwise(loss)
