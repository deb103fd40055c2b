import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import catalog as C
from quarrystone.operators import documents as D


def test_chunks_are_bounded_and_cover_the_text():
    rng = random.Random(4)
    words = ["word", "other.", "thing;", "x^2", "long" * 9, "\n", "\n\n", "为了。", "$a+b$", "$$\nx = y\n$$", "```\ncode here\n```", "\\(z\\)"]
    for _ in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(0, 400)))
        made = D.chunks(text, 80, 10)
        assert all(c.strip() for c in made)
        assert all(len(c) <= 80 or D.PROTECTED.search(c) for c in made)
        joined = "".join("".join(made).split())
        assert len(joined) >= len("".join(text.split()))
    assert D.chunks("") == [] == D.chunks(" \n ")
    span = "$$" + "a" * 900 + "$$"
    assert span in D.chunks("before " + span + " after", 100, 20)
    assert all(len(c) <= 100 for c in D.chunks("y" * 1000, 100, 20)) and len(D.chunks("y" * 1000, 100, 20)) > 10


def slices(spark, text):
    rows = D.question_slices(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("group_no", "number").collect()
    return [(r.group_no, r.number, r.question, r.answer, r.explanation, r.suffix) for r in rows]


def test_question_slices(spark):
    text = "一、选择题\n1. 甲是什么？\nA. 一 B. 二\n2．乙是多少 1.5 吗？\n(3) 丙？\n答案\n1. A\n2. 乙\n解析\n3. 因为丙"
    assert slices(spark, text) == [(0, 1, "甲是什么？\nA. 一 B. 二", "A", None, ""), (0, 2, "乙是多少 1.5 吗？", "乙", None, ""), (0, 3, "丙？", None, "因为丙", "")]
    assert slices(spark, "no questions here\nat all") == []
    assert [s[2] for s in slices(spark, "1. first\n2. second\n1. wrapped point\n3. third")] == ["first", "second\n1. wrapped point", "third"]
    assert slices(spark, "") == []


def test_running_lines(spark):
    rows = [(1, p, i, t) for p in range(3) for i, t in enumerate(["Head er", f"text {p}", "body", "Foot 1"])]
    lines = spark.createDataFrame(rows, "doc int, page int, at int, line string")
    edge = F.col("at").isin(0, 3)
    left = D.without_running_lines(lines, "doc", "page", "line", edge, F.col("line") == "Foot 1").collect()
    assert sorted(r.line for r in left) == ["Foot 1"] * 3 + ["body"] * 3 + ["text 0", "text 1", "text 2"]


def test_titles_and_tags(spark):
    titles = spark.createDataFrame([(1, "Plane geometry and circles"), (2, "none")], "title_id long, title string")
    tags = spark.createDataFrame([("geometry",), ("Plane Geometry",), ("circles",), ("geo",)], "tag string")
    assert {r.title_id: r.tags for r in D.contained_tags(titles, tags).collect()} == {1: ["plane geometry", "circles"]}
    labels = spark.createDataFrame([(1, "Plane-Geometry"), (2, "Planet geometri"), (3, "Algebra")], "label_id long, label string")
    asked = spark.createDataFrame([(1, "plane geometry"), (2, "Planet geometry"), (3, "gebraal"), (4, "zzz")], "title_id long, title string")
    found = {r.title_id: (r.label_id, r.score) for r in D.similar_titles(asked, labels).collect()}
    assert found[1] == (1, 300) and found[2] == (1, 208) and found[3] == (3, 200) and 4 not in found


def test_tags_are_found_like_plain_substrings(spark):
    rng = random.Random(7)
    vocabulary = ["平面几何", "几何", "函数", "geometry", "a tag of more than six words in all", "2", "b  c", " Trim ", "", "ab", "bca"]
    vocabulary += ["".join(rng.choices("ab c", k=rng.randint(1, 4))) for _ in range(20)]
    asked = ["高中平面几何与函数讲义.pdf", "geometry_v2", "on geometry, 3", "so A  tag of more than six words in all is", "", "trimmed", None]
    asked += ["".join(rng.choices("ab c", k=rng.randint(1, 14))) for _ in range(40)]
    want = {}
    for i, title in enumerate(asked):
        whole, kept = re.sub(r"\s+", " ", (title or "").lower().strip(" ")), []
        for tag in sorted({v.strip(" ").lower() for v in vocabulary} - {""}, key=lambda t: (-len(t), t)):
            if tag in whole and not any(tag in k for k in kept):
                kept.append(tag)
        if kept:
            want[i] = kept
    assert want[0] == ["平面几何", "函数"] and want[1] == ["geometry", "2"] and len(want[3][0]) > 30
    titles = spark.createDataFrame(list(enumerate(asked)), "title_id long, title string")
    tags = spark.createDataFrame([(v,) for v in [*vocabulary, None]], "tag string")
    assert {r.title_id: r.tags for r in D.contained_tags(titles, tags).collect()} == want


def plain_score(a, b, least):
    ratio = SequenceMatcher(None, a, b, autojunk=False).ratio()
    if a == b:
        return 300
    if b in a:
        return 220
    if min(len(a), len(b)) > 2 and sorted(a) == sorted(b):
        return 200
    if len(a) > 2 and a in b:
        return 180
    return int(170 + 40 * ratio) if min(len(a), len(b)) > 2 and ratio >= least else None


@pytest.mark.parametrize("least", [0.82, 0.6])
def test_similar_titles_equal_all_pairs(spark, least):
    rng = random.Random(11)
    asked = ["函数与方程", "abtest", "pqr", "abcdef", "ab", "x"]
    known = ["函数", "ab", "rpq", "abxcdxef", "abtests", "x", "ba"]
    for size in range(1, 26):
        for _ in range(6):
            text = "".join(rng.choices("abcdefgh", k=size))
            edited = "".join(c + rng.choice(["", "", "", "", "z"]) for c in text)
            spaced = "".join(c + ("z" if i % 2 else "") for i, c in enumerate(text))
            asked.append(text)
            known.append(rng.choice([edited, spaced, text[::-1], text[: size // 2 + 1]]))
    want = {}
    for i, a in enumerate(asked):
        scores = [(-score, -len(b), j) for j, b in enumerate(known) if (score := plain_score(a, b, least)) is not None]
        if scores:
            want[i] = (min(scores)[2], -min(scores)[0])
    assert want[0] == (0, 220) and want[2] == (2, 200)
    titles, labels = spark.createDataFrame(list(enumerate(asked)), "title_id long, title string"), spark.createDataFrame(list(enumerate(known)), "label_id long, label string")
    assert {r.title_id: (r.label_id, r.score) for r in D.similar_titles(titles, labels, least).collect()} == want
    alone = D.similar_titles(spark.createDataFrame([(1, "AB test"), (2, "abcdef"), (3, "ab")], "title_id long, title string"), spark.createDataFrame([(1, "AB"), (2, "abxcdxef")], "label_id long, label string"))
    assert {r.title_id: (r.label_id, r.score) for r in alone.collect()} == {1: (1, 220), 2: (1, 220), 3: (1, 300)}


def test_text_functions(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x

    t = F.col("t")
    assert one(T.stripped(t), "　 a b \n") == "a b"
    assert one(T.structure_key(t), "第１章（上）") == "第1章上"
    assert one(T.bigrams(t), "abc") == ["ab", "bc"] and one(T.bigrams(t), "a") == ["a"] and one(T.bigrams(t), "") == []
    assert one(T.token_estimate(t), "中文ab") == 3 and one(T.token_estimate(t), "") == 1
    assert [one(T.chinese_number(t), x) for x in ("十", "十二", "二十", "三十五", "七", "12", "x")] == [10, 12, 20, 35, 7, 12, None]
    assert [one(T.difficulty(t), x) for x in ("0.9", "72", "0.5", "30")] == ["challenge", "advanced", "standard", "basic"]
    assert one(T.html_text(t), "<script>x</script><table><tr><td>a</td><td>b</td></tr></table><p>c</p>") == "a | b\nc"
    assert one(T.tag_list(t), "a, B,b，c\na") == ["a", "B", "c"]
    assert one(T.first_subject(t, [("maths", ["sum", "circle"]), ("physics", ["force"])]), "A FORCE on a Circle") == "maths"
    assert one(T.topic(t, ["please ", "can you "], 10), "please explain the force of it") == "explain th..."


def test_reconcile_and_missing(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, ""), (5, "c")], "n int, name string")
    known = spark.createDataFrame([("b",)], "name string")
    out = {r.n: r.outcome for r in C.reconciled(rows, known, "name", F.when(F.col("name") == "", "no name"), "n").collect()}
    assert out == {1: "created", 2: "duplicate", 3: "existing", 4: "invalid", 5: "created"}
    assert {r.n for r in C.missing(rows, known, "name").collect()} == {1, 2, 4, 5}
    page = C.page_with_total(rows, ["n"], 2, 2).collect()
    assert [(r.n, r.total) for r in page] == [(3, 5), (4, 5)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_slices_and_tags_without_large_shuffles(spark):
    docs = spark.createDataFrame([(7, "1. a?\n2. b\r\nmore\nAnswers\n2. x\nPart 2\n1. c\nanswers:\n1. y\n3. z"), (8, None), (9, "")], "doc_id int, text string")
    cut = D.question_slices(docs)
    assert [tuple(r) for r in cut.collect()] == [(7, 0, 1, "a?", "y", None, "v:1"), (7, 0, 2, "b\nmore", "x", None, ""), (7, 1, 1, "c", "y", None, "v:2")]
    assert "Window" not in plan_of(cut) and "Join" not in plan_of(cut)
    titles = spark.createDataFrame([(i, "a common title") for i in range(50)], "title_id long, title string")
    found = D.contained_tags(titles, spark.createDataFrame([("common",), ("mm",), ("none of them",)], "tag string"))
    assert {tuple(r.tags) for r in found.collect()} == {("common",)}
    assert "Generate explode(array_distinct" not in plan_of(found)


def test_pieces_in_one_pass(spark):
    from quarrystone.plans.document_queries import cut_in_pieces

    rows = [(1, 1, "abc\n😀fgh😀"), (1, 2, ""), (1, 3, None), (1, 4, "1234567")]
    cut = cut_in_pieces(spark.createDataFrame(rows, "conv_id long, turn int, text string"))
    assert sorted(map(tuple, cut.collect()), key=str) == [("1-1", 0, "abc\n😀fg", False), ("1-1", 1, "h😀", True), ("1-2", 0, "", True), ("1-3", 0, None, True), ("1-4", 0, "1234567", True)]
    assert "substr" not in plan_of(cut)
