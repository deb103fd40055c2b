from pyspark.sql import functions as F

from quarrystone.functions import metadata as M
from quarrystone.operators import lifecycle as Y


def one(spark, column, *values):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], "t string").select(column.alias("x")).collect()]


def test_titles(spark):
    t = F.col("t")
    assert one(spark, M.clean_title(t), "第一章 函数_v2(1).pdf", "1.2 数列 副本.docx", "plain", "notes 2024-05-01.md") == ["函数", "数列", "plain", "notes"]
    assert one(spark, M.title_tags(t), "《函数》与《数列》", "复习：导数", "x", "数列") == [["函数", "数列"], ["导数"], [], ["数列"]]


def test_json(spark):
    t = F.col("t")
    assert one(spark, M.kept_keys(t, ["a", "c"]), '{"a":"1","b":"2"}') == ['{"a":"1"}']
    assert one(spark, M.layered({"x": {"a": t, "b": F.lit(None).cast("string")}, "y": {"c": F.lit("")}}), "1", "") == ['{"x":{"a":"1"}}', "{}"]
    (u,) = one(spark, M.usage_tokens(t), '{"input_tokens":3,"output_tokens":4}')
    assert (u.prompt, u.completion, u.total) == (3, 4, 7)


def test_flags_and_grades(spark):
    t = F.col("t")
    assert one(spark, M.question_flags(t, F.lit("x"), F.lit(0), F.lit(True)), " ", "1. a\n2. b") == [["empty_question_text", "missing_required_image"], ["missing_required_image", "multi_question_suspected"]]
    assert one(spark, M.image_binding(F.lit(True), F.lit(True), t.cast("int")), "0", "2") == ["missing_required", "bound"]
    assert one(spark, M.confidence(t.cast("double"), F.lit(0.9)), "0.9", "0.7", "0.1") == ["high", "medium", "low"]
    assert one(spark, F.round(M.meaningful(t), 2), "ab中.", "") == [0.75, 0.0]


def test_best_extractor(spark):
    pages = lambda texts: spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "path string, page int, text string")
    best = Y.best_of([pages(["aa", "b"]), pages(["a", "bbb"]), pages(["cc", ""])], F.char_length("text"))
    assert sorted((r.page, r.text, r.extractor) for r in best.collect()) == [(0, "aa", 0), (1, "bbb", 1)]
