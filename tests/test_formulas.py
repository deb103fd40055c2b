import random

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import formulas as M


def each(spark, make, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (None, None),
    ("  ", ""),
    (r"x _ { 1 2 } ^ { - 3 }", r"x_{12}^{-3}"),
    (r"1 . 6 \times 1 0 ^ { - 1 9 } \mathrm { C }", r"1.6 \times 10^{-19} \mathrm{C}"),
    (r"\frac { a } { b }", r"\frac{a}{b}"),
    (r"\overbar { A B }", r"\overline{A B}"),
    (r"f^{'} ( x )", "f' ( x )"),
    (r"\begin { array } { l } a \\ { { \ } } \\ b \\ { } \\ c \end { array }", r"\begin{array}{l} a \\ b \\ c \end{array}"),
    (r"\mathrm { { k } g }", r"\mathrm{kg}"),
    (r"\mathrm { m / s } + \mathrm{ a b } c d", r"\mathrm{m/s}+ \mathrm{ab} c d".replace("}+", "} +")),
    (r"\mathrm{(aq}", r"\mathrm{(aq)}"),
    (r"\mathrm{((aq}", r"\mathrm{((aq))}"),
    (r"\mathrm{a b", r"\mathrm{a b"),
    ("1 2 3 . 4  5", "123.45"),
    ("１ ２", "１２"),
    ("已 知 x", "已 知 x"),
]


def test_spacing(spark):
    got = each(spark, M.spaced, [a for a, _ in CASES])
    assert got == [b for _, b in CASES]
    assert each(spark, M.spaced, got) == got


def test_order_matters(spark):
    """A prime is seen only where nothing is spaced; scripts close up before digits do, digits before signs of exponents, and spaces go from what mathrm opened only then."""
    assert each(spark, M.spaced, [r"1 0 ^ { - 1 2 }", "f ^ { ' }", r"\mathrm { { m o l } \cdot  L ^ { - 1 } }"]) == ["10^{-12}", "f^{'}", r"\mathrm{mol\cdotL^{-1}}"]


def test_idempotent_on_random_formulas(spark):
    rng = random.Random(5)
    parts = ["x", "1", "2", ".", " ", "  ", "_ { 1 }", "^ { - 2 }", r"\frac { a } { b }", r"\mathrm { k g }", r"\alpha", "+", "(", ")", r"\begin { matrix } 1 \\ 2 \end { matrix }"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    once = each(spark, M.spaced, texts)
    assert each(spark, M.spaced, once) == once
    squeezed = ["".join(t.split()).replace("\\overbar", "\\overline") for t in texts]
    assert ["".join(t.split()) for t in once if not t.startswith(r"\mathrm{(")] == [s for s, t in zip(squeezed, once, strict=True) if not t.startswith(r"\mathrm{(")]


def test_fragments_and_table_lines(spark):
    assert each(spark, M.fragments_spaced, ["a  $x _ { 1 }$ b $ 1 . 5 $", "one $ only", "$$", None]) == ["a $x_{1}$ b $1.5$", "one $ only", "$$", None]
    lines = ["a ∣ $v _ { 0 }$ ∣ ∣ 3", "a|b", "a | b", "| a |", " | ", None, "∣∣x"]
    assert each(spark, M.is_table_line, lines) == [True, False, True, False, False, False, False]
    assert each(spark, M.table_line, lines[:3]) == ["a | $v_{0}$ | 3", "a | b", "a | b"]


@pytest.mark.parametrize(
    ("cells", "want"),
    [
        (["t", "x", "1 2"], ["t", "x", "1", "2"]),
        (["t", "1.5 -2", ""], ["t", "1.5", "-2"]),
        (["1", "2", "3 4"], ["1", "2", "3 4"]),
        (["1", "", "3 4"], ["1", "", "3", "4"]),
        (["t", "3 4"], ["t", "3 4"]),
        (["t", "x", "1 2 3"], ["t", "x", "1 2 3"]),
        (["t", "x", "1 b"], ["t", "x", "1 b"]),
        ([], []),
        (None, None),
    ],
)
def test_sparse_rows(spark, cells, want):
    assert each(spark, M.sparse_row, [cells], "array<string>") == [want]
