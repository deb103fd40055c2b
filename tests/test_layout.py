"""Answer banks, Markdown, formulas and layout blocks by hand-made cases and plain searches."""

import random

from pyspark.sql import functions as F

from quarrystone.functions import banks as K
from quarrystone.functions.answers import page_text
from quarrystone.functions.markdown import normalised_markdown
from quarrystone.operators import layout as L
from quarrystone.sources.formulas import with_latex


def each(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column.alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def check(spark, column, cases):
    for (text, want), got in zip(cases.items(), each(spark, column, list(cases)), strict=True):
        assert got == want, (text, got)


def test_normalised_bank(spark):
    check(
        spark,
        K.normalised_bank(F.col("t")),
        {
            None: "",
            " \n": "",
            "A": "A",
            "1. A 2. B\n3、C": "1. A\n2. B\n3、C",
            "第1题 A 第2题 B": "第1题 A\n第2题 B",
            "题 1. A 2. B": "1. A\n2. B",
            "1. A\ngoes on\n2. B": "1. A\ngoes on\n2. B",
            "答案\n1. A": "1. A",
            "答案：1. A 2. B": "1. A\n2. B",
            "【答案】C": "C",
            "1. A\n解析：1. why 2. how": "1. A\n1. 解析：why\n2. 解析：how",
            "解析\n1. why\nbecause\n（2）how": "1. 解析：why\nbecause\n2. 解析：how",
            "详解：so it is": "解析：so it is",
            "解析：1. 答案：B 2. 答案：\n3. 解析": "1. B\n2.\n3. 解析：解析",
            "1. A\n答案：B": "1. A\nB",
            "解析：\n3.5 m": "3. 解析：5 m",
        },
    )


def test_question_sections_and_payloads(spark):
    sections = lambda t: tuple(each(spark, K.question_sections(F.col("t")), [t])[0])
    assert sections(None) == ("", None, None)
    assert sections("how?\nfar\n答案：A\n难度：易\nB\n【解析】 why\nso") == ("how?\nfar", "A\nB", "why\nso")
    assert sections("解析\n答案\nC") == ("", "C", None)
    cases = {
        None: (None, None),
        "A": ("A", None),
        "已知甲下列哪个，求速度": (None, None),
        "B 解析：why": ("B", "why"),
        "答案：C": ("C", None),
        "C\n解析：why": ("C", "why"),
        "已知甲求速度\n答案：C": (None, None),
        "第2题的题目": (None, None),
    }
    for (text, want), got in zip(cases.items(), each(spark, K.answer_payload(F.col("t")), list(cases)), strict=True):
        assert tuple(got) == want, text
    shown = spark.range(1).select(K.composed(F.lit("3"), F.lit(" q "), F.lit(None), F.lit("e"))).first()[0]
    assert shown == "第3题\n\n题目：\nq\n\n解析：\ne"


def test_markdown(spark):
    check(
        spark,
        normalised_markdown(F.col("t")),
        {
            None: "",
            "a\r\nb\rc": "a b c",
            "a\n\n\n\nb": "a\n\nb",
            "# h\ntext\non\n- one\n  two\n- three": "# h text on\n- one two\n- three",
            "1\\. a\n2) b\n| x |\n> q": "1. a\n2) b\n| x |\n> q",
            "```\na\nb\n```\nc\nd": "```\na\nb\n```\nc d",
            "~~~\na  b\n\n~~~\nc": "~~~\na b\n\n~~~\nc",
            "```\nnever\nclosed": "```\nnever\nclosed",
            "$a \\_ b\n + c$ and\nd": "$a _ b + c$ and d",
            "$$ x\n\n= 1 $$": "$$x = 1$$",
            "\\( a\\=b \\) \\[ c\\#d \\]": "\\(a=b\\) \\[c#d\\]",
            "costs \\$5 and\n\\$ 6": "costs \\$5 and \\$ 6",
            "an $ open one\n\nb": "an $ open one\n\nb",
            "\\\\$ x\n y $": "\\\\$x y$",
            "a\xa0 \xa0b \nc": "a b c",
            "`` ```x\\_y``` ": "`` ```x\\_y```",
        },
    )
    again = each(spark, normalised_markdown(normalised_markdown(F.col("t"))), ["# h\ntext $a\nb$\n\n- x\ny"])
    assert again == each(spark, normalised_markdown(F.col("t")), ["# h\ntext $a\nb$\n\n- x\ny"])


M = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def r(text):
    return f"<m:r><m:rPr><m:t>no</m:t></m:rPr><m:t>{text}</m:t></m:r>"


def e(tag, *parts):
    return f"<m:{tag}>{''.join(parts)}</m:{tag}>"


def chr_(group, tag, value):
    return f'<m:{group}><m:{tag} m:val="{value}"/></m:{group}>'


def test_formulas(spark):
    frac = e("f", e("num", r("a")), e("den", r("b")))
    cases = {
        r(" x "): "x",
        frac: r"\frac{a}{b}",
        e("f", e("num")): "",
        e("sSup", e("e", r("x")), e("sup", r("2"))): "{x}^{2}",
        e("sSub", e("e", r("x")), e("sub", r("i"))): "{x}_{i}",
        e("sSubSup", e("e", frac), e("sub", r("i")), e("sup", r("2"))): r"{\frac{a}{b}}_{i}^{2}",
        e("rad", e("deg"), e("e", r("x"))): r"\sqrt{x}",
        e("rad", e("deg", r("3")), e("e", r("x"))): r"\sqrt[3]{x}",
        e("nary", chr_("naryPr", "chr", "∫"), e("sub", r("0")), e("sup", r("1")), e("e", r("x"))): r"\int_{0}^{1} x",
        e("nary", e("e", r("x"))): r"\sum x",
        e("nary", chr_("naryPr", "chr", "⊕"), e("e")): "⊕",
        e("d", e("e", r("x"))): r"\left(x\right)",
        e("d", '<m:dPr><m:begChr m:val="{"/><m:endChr m:val="⌋"/><m:sepChr m:val="|"/></m:dPr>', e("e", r("x")), e("e", r("y"))): r"\left\{x|y\right\rfloor",
        e("func", e("fName", r("sin")), e("e", r("x"))): "sinx",
        e("limLow", e("e", r("lim")), e("lim", r("n"))): "{lim}_{n}",
        e("limUpp", e("e", r("lim")), e("lim", r("n"))): "{lim}^{n}",
        e("acc", chr_("accPr", "chr", "→"), e("e", r("v"))): r"\vec{v}",
        e("acc", e("e", r("v"))): "v",
        e("m", e("mr", e("e", r("a")), e("e", r("b"))), e("mr", e("e", r("c")), e("e", frac))): r"\begin{matrix}a & b \\ c & \frac{a}{b}\end{matrix}",
        e("eqArr", e("e", r("a")), e("e", r("b"))): r"\begin{aligned}a \\ b\end{aligned}",
        e("sPre", e("sub", r("1")), e("sup", r("2")), e("e", r("x"))): "_{1}^{2}x",
        e("box", e("unknown", r("x"), e("borderBox", frac))): r"x\frac{a}{b}",
    }
    rows = [(f"<m:oMath {M}>{x}</m:oMath>", f"${want}$" if want else "") for x, want in cases.items()]
    rows += [(f"<m:oMathPara {M}><m:oMath>{r('a')}</m:oMath><m:oMath/><m:oMath>{frac}</m:oMath></m:oMathPara>", "$$a$$\n$$\\frac{a}{b}$$")]
    rows += [(None, None), ("<broken", None)]
    out = with_latex(spark.createDataFrame(rows, "x string, latex string").withColumnRenamed("latex", "want"), "x").collect()
    for row in out:
        assert row.latex == row.want, row.x


def split_of(blocks):
    """The plain search: each split anew."""
    like = [t in ("A", "B") for _, t in blocks]
    for s in range(1, len(blocks)):
        front, rest = [n for n, _ in blocks[:s]], [n for n, _ in blocks[s:]]
        order = list(dict.fromkeys(front))
        if len(blocks) < 3 or len(rest) < 2 or len(set(rest)) < len(rest) or not set(rest) <= set(order):
            continue
        if rest == sorted(rest, key=order.index) and sum(like[s:]) >= max(1, len(rest) - 1):
            return s if all(like[s:]) else None
    return None


def test_repeated_banks(spark):
    dice = random.Random(11)
    rows, docs = [], {}
    for doc in range(300):
        n, kinds = dice.randint(1, 6), dice.randint(1, 3)
        numbers = [str(i % 9) for i in range(n)] + [str(i) for i in sorted(dice.sample(range(n), dice.randint(0, n)))]
        if kinds == 3:
            numbers = [dice.choice("123") for _ in numbers]
        docs[doc] = [(x, dice.choice(["A", "B", "A", "已知甲求速度"] if kinds > 1 else ["A"])) for x in numbers]
        rows += [(doc, 3 * i + doc, x, t) for i, (x, t) in enumerate(docs[doc])]
    got = {}
    for row in L.repeated_banks_merged(spark.createDataFrame(rows, "doc_id int, position int, number string, text string")).collect():
        got.setdefault(row.doc_id, []).append((row.position, row.number, row.text, row.bank_answer))
    for doc, blocks in docs.items():
        s = split_of(blocks)
        told = dict(blocks[s:]) if s else {}
        assert [x[1:] for x in sorted(got[doc])] == [(n, t, told.get(n)) for n, t in blocks[: s or len(blocks)]], doc
    assert sum(split_of(b) is not None for b in docs.values()) > 20


BLOCKS = "doc_id int, page int, block_no int, type string, text string, asset_id string"


def test_questions_over_blocks_and_pages(spark):
    rows = [
        (1, 0, 0, "title", "第一章 力", None),
        (1, 0, 1, "text", "preface", None),
        (1, 0, 2, "text", "1. What is it?", None),
        (1, 0, 3, "image", None, "img-2"),
        (1, 1, 0, "text", "goes on\n答案：A", "img-1"),
        (1, 1, 1, "title", "第一节 运动", None),
        (1, 1, 2, "text", "lost between", None),
        (1, 1, 3, "text", "（2）", None),
        (1, 2, 0, "text", "second?", None),
        (1, 2, 1, "text", "第3题 third", "img-3"),
        (1, 2, 2, "text", "4.", None),
        (1, 3, 0, "title", "参考答案", None),
        (1, 3, 1, "text", "1. X 2. B", None),
        (1, 3, 2, "text", "3. C\n解析：3. why", None),
        (2, 0, 0, "text", "1. alone?", None),
    ]
    out = L.question_blocks(spark.createDataFrame(rows, BLOCKS).repartition(3)).orderBy("doc_id", "question_no").collect()
    assert [tuple(r) for r in out] == [
        (1, 1, "1", "第一章 力", None, "What is it?\ngoes on", "A", None, 0, 1, ["image", "text"], ["img-2", "img-1"]),
        (1, 2, "2", "第一章 力", "第一节 运动", "second?", "B", None, 1, 2, ["text"], []),
        (1, 3, "3", "第一章 力", "第一节 运动", "third", None, "why", 2, 2, ["text"], ["img-3"]),
        (2, 1, "1", None, None, "alone?", None, None, 0, 0, ["text"], []),
    ]
    assert L.question_blocks(spark.createDataFrame([], BLOCKS)).count() == 0


def test_segments_follow_headings_and_page_maps(spark):
    rows = [
        (1, 1, 0, "text", "contents", None),
        (1, 2, 0, "text", "before", None),
        (1, 2, 1, "title", "第一章 力", None),
        (1, 2, 2, "text", "a", None),
        (1, 3, 0, "title", "第一节 动", None),
        (1, 3, 1, "text", "b", None),
        (1, 3, 2, "image", " ", "p1"),
        (1, 4, 0, "text", "c", None),
        (1, 4, 1, "title", "第九章 光", None),
        (1, 4, 2, "text", "d", None),
        (1, 5, 0, "text", "e", None),
        (1, 6, 0, "text", "f", None),
        (1, 6, 1, "text", None, None),
    ]
    pages = [(1, 4, "第二章 热", None), (1, 5, "第二章 热", "page section"), (1, 6, None, "other")]
    blocks = spark.createDataFrame(rows, BLOCKS).repartition(2)
    told = spark.createDataFrame(pages, "doc_id int, page int, chapter string, section string")
    out = L.structured_segments(blocks, told, spark.createDataFrame([(1, 1)], "doc_id int, page int")).orderBy("segment_no").collect()
    assert [(r.chapter, r.section, r.text, r.page_start, r.page_end, r.assets) for r in out] == [
        (None, None, "before", 2, 2, []),
        ("第一章 力", None, "a", 2, 2, []),
        ("第一章 力", "第一节 动", "b", 3, 3, ["p1"]),
        ("第二章 热", None, "c", 4, 4, []),
        ("第二章 热", None, "d", 4, 4, []),
        ("第二章 热", "page section", "e", 5, 5, []),
        ("第二章 热", "other", "f", 6, 6, []),
    ]
    assert L.structured_segments(blocks).count() == 4


def test_page_text_keeps_short_words_of_any_script(spark):
    rows = spark.createDataFrame([("Adoó\nEinöge\nabc中\nAB²\nab×\nabc.",)], "text string")
    assert rows.select(page_text(F.col("text")).alias("t")).first().t == "Adoó\nEinöge\nabc中\nAB²"


def test_places_are_looked_behind_only_where_formulas_may_be(spark):
    from quarrystone.functions.markdown import FREE
    from quarrystone.functions.sections import numbered_entries

    assert FREE.startswith(r"(?=[$\\])")
    text = "word " * 4000 + r"$a  \_b$ \$ \\$c  d$ \(e  f\)"
    rows = spark.createDataFrame([(text,)], "text string")
    assert rows.select(normalised_markdown(F.col("text")).alias("t")).first().t == "word " * 4000 + r"$a _b$ \$ \\$c d$ \(e f\)"
    # The dynamic pattern of a bank stands in the plan once, not in each number's entry.
    plan = rows.select(numbered_entries(F.lit("1. a 2. b"), F.array(F.lit("1"), F.lit("2"))).alias("e"))
    assert [tuple(x) for x in plan.first().e] == [("1", "a"), ("2", "b")]


def test_question_blocks_read_their_blocks_once(spark, tmp_path):
    spark.createDataFrame([(1, 0, 0, "text", "1. q?", None), (1, 1, 0, "text", "答案", None), (1, 1, 1, "text", "1. A", None)], BLOCKS).write.parquet(str(tmp_path / "b"))
    out = L.question_blocks(spark.read.parquet(str(tmp_path / "b")))
    assert [(r.question, r.answer) for r in out.collect()] == [("q?", "A")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan


def test_sections_equal_a_fold_over_lines(spark):
    heads = {"答案：": 1, "【参考答案】": 1, "解析": 2, "点拨:": 2, "难度": 3, "": 0}
    rng = random.Random(4)
    texts, want = [], []
    for _ in range(400):
        now, parts, lines = 0, ([], [], []), []
        for _ in range(rng.randint(0, 5)):
            head = rng.choice(list(heads) if rng.random() < 0.3 else ["", "答案："] if len(texts) % 2 else [""])
            body = rng.choice(["a", "：b", "1. c", "\u3000", "", "d 答案 e", "\x1cf"])
            lines.append(rng.choice(["", " ", "\r"]) + head + body + rng.choice(["", "\t", "\u2028"]))
            if heads[head] != 3:
                now = heads[head] or now
                body = body.strip()
                body = body.removeprefix("：").strip() if head in ("【参考答案】", "解析") else body
                parts[now].extend([body] if body else [])
        texts.append("\n".join(lines))
        want.append(("\n".join(parts[0]), "\n".join(parts[1]) or None, "\n".join(parts[2]) or None))
    for text, got, expected in zip(texts, each(spark, K.question_sections(F.col("t")), texts), want, strict=True):
        assert tuple(got) == expected, text


def test_stripped_knows_the_white_space_of_all_scripts(spark):
    from quarrystone.functions.text import squeezed, stripped

    c = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
    rows = spark.range(1, 0x3100).where("id NOT BETWEEN 55296 AND 57343").select(c.alias("c")).withColumn("t", F.concat("c", F.lit("a"), "c", F.lit("b"), "c"))
    old = F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    assert rows.where(stripped(F.col("t")) != old).count() == 0
    assert rows.where(stripped(F.col("c")) == "").count() == 29
    assert each(spark, squeezed(F.col("t")), [None, "", " \n ", "a b", " a \n\n\u3000b c\t\n"]) == ["", "", "", "a b", "a\nb c"]


def test_headings_begin_as_they_may(spark):
    from quarrystone.functions.sections import BACK_MATTER, heading

    heads = ["第一章 a", "第二单元", "专题三 b", "UNIT 3 c", "第一节", "1.2 d", "12、e", "（一） f", "(3)g", "A. h", "b、i"]
    for kind, texts in (("exercise", heads), ("textbook", BACK_MATTER)):
        assert [(r.chapter or r.section) for r in each(spark, heading(F.col("t"), F.lit(kind)), [f"\x1c {t}" for t in texts])] == texts
