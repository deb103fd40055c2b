"""Which questions are admitted, and which answers say too much."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions.text import stripped

# Subjects in the order in which they are tried, with their cue words.
SUBJECT_CUES: dict[str, list[str]] = {
    "语文": ["古诗", "文言文", "修辞", "阅读理解", "作文", "病句", "成语", "议论文", "论点", "意象"],
    "数学": ["函数", "导数", "数列", "几何", "概率", "方程", "不等式", "三角", "圆锥曲线"],
    "英语": ["语法", "完形", "阅读", "时态", "从句", "单词", "翻译"],
    "物理": ["速度", "受力", "电场", "磁场", "动能", "牛顿", "电路"],
    "化学": ["氧化", "还原", "离子", "方程式", "滴定", "平衡", "电解"],
    "生物": ["细胞", "遗传", "呼吸作用", "光合作用", "生态", "DNA"],
    "政治": ["哲学", "经济", "法治", "文化", "价值观", "国家"],
    "历史": ["朝代", "改革", "战争", "制度", "史料", "近代史", "历史", "材料题"],
    "地理": ["气候", "洋流", "农业", "地形", "人口", "区域"],
}
# What is never admitted, by kind.
BLOCKED: dict[str, str] = {
    "daily life": "天气|股价|彩票|恋爱|表白|游戏攻略|写代码|帮我写作文",
    "roles": "你是谁|讲个笑话|闲聊|角色扮演|扮演成|忽略之前|无视规则|系统提示词|开发者模式|管理员模式|DAN",
    "prompts": "prompt|system prompt|越过限制|绕过过滤|不要遵守|泄露提示词",
    "sources": "知识库原文|检索片段|资料片段|向量库|RAG|完整输出资料",
    "secrets": "身份证|银行卡|密码|越狱|翻墙|成人",
}
# Words that mark a question of study without any subject's cue.
GENERAL_CUES = ["为什么", "如何", "怎么", "求", "分析", "解释", "评价", "概括"]
# How an answer gives the result away, and how it owns up to an unclear image.
GIVEN_AWAY = ["最终答案[是为]", "标准答案[是为]", "答案[：:]\\s*[A-D0-9一二三四五六七八九十]", "所以结果[是为]", "正确结论[是为]"]
UNCERTAIN = ["可能不准确", "不一定准确", "看得不太清", "理解可能有误", "识别失败", "可能理解得不完全准确"]
REFUSAL = "抱歉，我只能解答高中学科相关问题"
IMAGE_NOTE = "这张图片我看得不太清，理解可能有误。请你帮我核对一下。"


def any_word(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def any_pattern(text: Column, patterns: Iterable[str]) -> Column:
    """Whether one of the patterns is found, whatever its case."""
    return reduce(lambda a, b: a | b, [F.rlike(text, F.lit(f"(?iu){p}")) for p in patterns])


def decision(question: Column, declared: Column, cues: Mapping[str, Sequence[str]] = SUBJECT_CUES) -> Column:
    """A struct of allowed, reason and subject, by the first rule that holds."""
    q = stripped(F.coalesce(question, F.lit("")))
    matched = F.coalesce(*[F.when(any_word(q, words), F.lit(subject)) for subject, words in cues.items()])
    known = F.coalesce(declared.isin(*cues), F.lit(False))

    def said(allowed: bool, reason: str, subject: Column) -> Column:
        return F.struct(F.lit(allowed).alias("allowed"), F.lit(reason).alias("reason"), subject.cast("string").alias("subject"))

    return (
        F.when(q == "", said(False, "empty_question", F.lit(None)))
        .when(any_pattern(q, BLOCKED.values()), said(False, "blocked_non_subject", F.lit(None)))
        .when(known, said(True, "declared_subject", declared))
        .when(matched.isNotNull(), said(True, "keyword_match", matched))
        .when((F.char_length(q) >= 6) & any_word(q, GENERAL_CUES), said(True, "generic_academic_pattern", declared))
        .otherwise(said(False, "subject_not_recognized", F.lit(None)))
    )


def answer_issues(answer: Column, image: bool = False) -> Column:
    """Names of what is wrong with an answer, in order; for one on an image also a missing note of doubt."""
    found = [
        F.when(any_pattern(answer, GIVEN_AWAY), "direct_answer_detected"),
        F.when(F.contains(answer, F.lit(REFUSAL)) & (F.char_length(answer) > 30), "mixed_refusal"),
    ]
    if image:
        found.append(F.when(~any_pattern(answer, UNCERTAIN), "missing_image_uncertainty_disclaimer"))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def with_image_note(answer: Column) -> Column:
    """An answer on an image, the note of doubt before it where anything is wrong with it."""
    plain = stripped(answer)
    return F.when(F.size(answer_issues(answer, image=True)) == 0, plain).when(plain == "", F.lit(IMAGE_NOTE)).otherwise(F.concat(F.lit(IMAGE_NOTE + "\n\n"), plain))
