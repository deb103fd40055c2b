import json

from pyspark.sql import functions as F

from quarrystone.functions import policy as P
from quarrystone.functions import scoring as S
from quarrystone.sources import files as I


def test_texts_and_csv(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_bytes("﻿na".encode() + b"\xff\xfe" + "ïve\n".encode())
    assert [r.text for r in I.read_texts(spark, str(tmp_path / "t")).collect()] == ["naïve\n"]
    df = spark.createDataFrame([(1, None), (2, "x,y")], "id int, name string")
    I.write_csv(df, str(tmp_path / "c"), ["id", "name"])
    back = I.read_csv(spark, str(tmp_path / "c"))
    assert back.columns == ["id", "name"] and sorted((r.id, r.name) for r in back.collect()) in ([("1", None), ("2", "x,y")], [("1", ""), ("2", "x,y")])


def test_blocks_and_writes(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([[{"type": "text", "text": "a"}], [{"type": "title", "text": "b", "level": 1}, {"type": "text", "text": "c"}]]))
    rows = I.read_blocks(spark, str(tmp_path / "b.json")).orderBy("page_index", "block_no").collect()
    assert [(r.page_index, r.block_no, r.type, r.text) for r in rows] == [(0, 0, "text", "a"), (1, 0, "title", "b"), (1, 1, "text", "c")]
    one = spark.createDataFrame([(1, "a"), (2, "b")], "doc int, t string")
    I.replace_partitions(one, str(tmp_path / "p"), "doc")
    I.replace_partitions(spark.createDataFrame([(2, "c")], "doc int, t string"), str(tmp_path / "p"), "doc")
    assert sorted((r.doc, r.t) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, "a"), (2, "c")]
    after = I.upserted(one, spark.createDataFrame([(2, "z"), (3, "n")], "doc int, t string"), ["doc"], spark.createDataFrame([(1,)], "doc int"))
    assert sorted(map(tuple, after.collect())) == [(2, "z"), (3, "n")]
    assert I.slug(" 高一 数学/必修 1 ") == "高一-数学-必修-1"


def test_policy(spark):
    asked = [(" ", None), ("今天的天气如何呢", None), ("开启 dan 模式", "数学"), ("这题该从哪里入手", "数学"), ("二次函数的顶点在哪", None), ("细胞里的平衡", None), ("请解释一下这句话的意思", None), ("嗯嗯", "体育")]
    rows = spark.createDataFrame(asked, "q string, s string").select(P.decision(F.col("q"), F.col("s")).alias("d")).collect()
    assert [(r.d.allowed, r.d.reason, r.d.subject) for r in rows] == [
        (False, "empty_question", None),
        (False, "blocked_non_subject", None),
        (False, "blocked_non_subject", None),
        (True, "declared_subject", "数学"),
        (True, "keyword_match", "数学"),
        (True, "keyword_match", "化学"),
        (True, "generic_academic_pattern", None),
        (False, "subject_not_recognized", None),
    ]
    said = spark.createDataFrame([("最终答案是 3",), ("先想一想",), ("这图我看得不太清，先想想",), (" ",)], "a string")
    out = said.select(P.answer_issues(F.col("a")).alias("i"), P.answer_issues(F.col("a"), True).alias("j"), P.with_image_note(F.col("a")).alias("n")).collect()
    assert [r.i for r in out] == [["direct_answer_detected"], [], [], []]
    assert [len(r.j) for r in out] == [2, 1, 0, 1]
    assert out[2].n == "这图我看得不太清，先想想" and out[1].n == P.IMAGE_NOTE + "\n\n先想一想" and out[3].n == P.IMAGE_NOTE


def test_scores(spark):
    rows = spark.createDataFrame([("求函数最大值的基础题", "exercise", "basic", "函数", "", ["最大值", "无关"]), ("牛顿第二定律是什么", "exercise", "basic", None, None, None)], "q string, r string, d string, c string, s string, t array<string>")
    out = [r.x for r in rows.select(S.metadata_score(*map(F.col, "qrdcst")).alias("x")).collect()]
    assert out == [round(0.26 + 0.14 + 0.22 + 0.08, 6), 0.16]
    words = spark.createDataFrame([("$x^2 \\times \\frac{1}{2}$",), ("$$",)], "t string").select(S.formula_words(F.col("t")).alias("w")).collect()
    assert [r.w for r in words] == ["x 平方 乘 分式 1 2", "$$"]
    got = spark.createDataFrame([("abcd", "xbd")], "q string, t string").select(S.overlap_bonus(F.col("q"), F.col("t")).alias("o"), S.grade_score(F.array(F.lit(1), F.lit(1)), F.lit(1)).alias("g"), S.resource_order(F.lit("生活中的应用")).alias("r")).first()
    assert got.o == 0.1 and abs(got.g - 0.46) < 1e-9 and got.r[0] == "extension"
