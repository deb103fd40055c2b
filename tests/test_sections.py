"""Sections of texts by hand-made cases: empty and null texts, marks in a row, ties of titles."""

from pyspark.sql import functions as F

from quarrystone.functions import sections as S
from quarrystone.operators import bank as B


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_answer_sections(spark):
    cases = {
        None: (None, None),
        " \n ": (None, None),
        "A": ("A", None),
        "【答案】A\nB\n【难度】易\n【解析】因为\n所以": ("A\nB", "因为\n所以"),
        "A 解析 因为": ("A", "因为"),
        "A解析：因为\n所以": ("A", "因为\n所以"),
        "解析\n答案：C": ("C", None),
        "详解：X\n参考答案 D": ("D", "X"),
    }
    for text, want in cases.items():
        assert tuple(one(spark, S.answer_sections(F.col("t")), t=text)) == want, text


def test_numbered_entries(spark):
    entries = lambda t, *n: {r.number: r.entry for r in one(spark, S.numbered_entries(F.col("t"), F.col("n")), t=t, n=list(n))}
    assert entries("1.A 2、B 12.C", "1", "2", "12") == {"1": "A", "2": "B", "12": "C"}
    assert entries("第1题 A 第2题 B", "2", " 2", "") == {"2": "B"}
    assert entries("1.A 1. 2.B 1.C", "1") == {"1": "C"}
    assert entries(None, "1") == {"1": None}


def test_formula_marks(spark):
    clean = lambda t: one(spark, S.without_formula_marks(F.col("t")), t=t)
    assert clean(None) == ""
    assert clean("a \nequation_inline\n  x^2\nb") == "a\nx^2\nb"
    assert clean("equation_inline\nequation_display\nx") == "equation_display\nx"
    assert clean("equation_inline\n\nx") == "\nx"
    assert clean("equation_inline\nimages/a.jpg\nx\nequation_display") == "x"
    assert clean("equation_inline\n  3. q") == "  3. q"


def test_headings(spark):
    opened = lambda t, kind="textbook": (lambda r: r and (r.chapter, r.section))(one(spark, S.heading(F.col("t"), F.col("k")), t=t, k=kind))
    assert opened("第一章 力") == ("第一章 力", None)
    assert opened("x\n\ny\n1.2 运动的描述") == (None, "1.2 运动的描述")
    assert opened("x\ny\nz\n第一章 力") is None
    assert opened("附录") == ("附录", None) and opened("附录", "exercise") is None
    assert opened("1. 求速度的大小") is None and opened("1.2 力，与运动") is None
    assert opened("1.2 力，与运动", "exercise") == (None, "1.2 力，与运动")
    assert opened("第一章 力", "extension") is None and opened(None) is None


def test_readable(spark):
    assert one(spark, S.readable(F.col("t")), t="题\tA．甲 B．乙\n（1）丙\n\n\n（2）丁") == "题\nA．甲 \nB．乙\n\n（1）丙\n\n（2）丁"
    judged = lambda q, a: one(spark, S.judgement_lines(F.col("q"), F.col("a")), q=q, a=a)
    assert judged("（1）(2)", "对  错") == "（1）对\n（2）错"
    assert judged("（1）", "对") == "对" and judged("（1）（2）", "对 5") == "对 5" and judged(None, None) is None


def test_catalogue_titles_first_entry_and_none(spark):
    entries = spark.createDataFrame([(1, 2, "力（上）"), (1, 1, "力 (上)"), (1, 3, "")], "doc_id int, place int, title string")
    rows = B.catalogue_titles(spark.createDataFrame([(1, 1, "力上"), (2, 1, "热"), (3, 1, None), (4, 2, "力上")], "heading_id int, doc_id int, title string"), entries)
    assert {tuple(r) for r in rows.collect()} == {(1, "力 (上)", True), (2, "热", False), (3, None, False), (4, "力上", False)}
