"""Queries of laid-out pages, answer banks, Markdown and formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import banks as K
from quarrystone.functions.markdown import normalised_markdown
from quarrystone.operators import layout as L
from quarrystone.plans.bank_queries import ORACLES, QUERIES
from quarrystone.plans.catalogue import query
from quarrystone.sources.formulas import with_latex
from quarrystone.sources.tables import table

__all__ = ["ORACLES", "QUERIES"]


def paper(spark, d) -> DataFrame:
    """Orders as papers: a chapter for each priority, lines as questions over two blocks, answers by flag at the end."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = lines.withColumns({"n": F.row_number().over(at), "of": F.count("*").over(Window.partitionBy("l_orderkey"))})
    block = lambda page, no, kind, text, asset=None: F.struct(F.lit(page).cast("int").alias("page") if isinstance(page, int) else page.cast("int").alias("page"), no.cast("int").alias("block_no"), F.lit(kind).alias("type"), text.alias("text"), (asset if asset is not None else F.lit(None)).cast("string").alias("asset_id"))
    n = F.col("n")
    first = F.when(n == 1, F.concat(F.lit("第一章 "), "o_orderpriority"))
    each = F.array(
        block(n, F.lit(0), "title", first),
        block(n, F.lit(1), "text", F.concat(n, F.lit(". How many of "), "l_partkey", F.lit("?"))),
        block(n + 1, F.lit(-2), "image", F.lit(None).cast("string"), F.concat(F.lit("img-"), "l_suppkey")),
        block(n + 1, F.lit(-1), "text", F.when(n % 2 == 0, F.concat(F.lit("答案：own "), "l_quantity")).otherwise(F.lit("go on"))),
        block(F.lit(1000), F.lit(0), "title", F.when(n == 1, F.lit("参考答案"))),
        block(F.lit(1000), n, "text", F.concat(n, F.lit(". "), "l_returnflag")),
    )
    rows = lines.select(F.col("l_orderkey").alias("doc_id"), F.inline(each))
    return rows.where("type <> 'title' OR text IS NOT NULL")


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem)
SELECT l_orderkey AS doc_id, CAST(n AS INT) AS question_no, CAST(n AS VARCHAR) AS number, '第一章 ' || o_orderpriority AS chapter,
       'How many of ' || l_partkey || '?' || CASE WHEN n % 2 = 1 THEN chr(10) || 'go on' ELSE '' END AS question,
       CASE WHEN n % 2 = 0 THEN 'own ' || l_quantity ELSE l_returnflag END AS answer, CAST(n AS INT) AS page_start, CAST(n + 1 AS INT) AS page_end,
       'image,text' AS block_types, 'img-' || l_suppkey AS assets
FROM l JOIN orders ON o_orderkey = l_orderkey""")
def questions_of_pages(spark, d):
    """Questions over block and page borders, pictures, own answers and those of the bank."""
    out = L.question_blocks(paper(spark, d))
    return out.select("doc_id", "question_no", "number", "chapter", "question", "answer", "page_start", "page_end", F.array_join("block_types", ",").alias("block_types"), F.array_join("assets", ",").alias("assets"))


@query(r"""
WITH e AS (SELECT user_id, ts, event_id, row_number() OVER w - 1 AS i, value, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, i // 5 + 1 AS page, CASE WHEN event_type = 'purchase' THEN '第一章 ' || event_id WHEN event_type = 'signup' THEN '第一节 ' || event_id END AS head FROM e),
p AS (SELECT *, CASE WHEN page % 3 = 0 THEN '第二章 of pages' END AS pc FROM b WHERE page % 7 <> 1),
c AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN head ELSE pc END IGNORE NULLS) OVER w AS chapter FROM p WINDOW w AS (PARTITION BY user_id ORDER BY i)),
x AS (SELECT *, CASE WHEN event_type = 'purchase' THEN '-' WHEN event_type = 'signup' THEN head WHEN pc IS NOT NULL AND pc IS DISTINCT FROM lag(chapter) OVER w THEN '-' END AS ev FROM c WINDOW w AS (PARTITION BY user_id ORDER BY i)),
s AS (SELECT *, nullif(last_value(ev IGNORE NULLS) OVER w, '-') AS section FROM x WINDOW w AS (PARTITION BY user_id ORDER BY i)),
t AS (SELECT *, CASE WHEN head IS NOT NULL OR chapter IS DISTINCT FROM lag(chapter) OVER w OR section IS DISTINCT FROM lag(section) OVER w THEN 1 ELSE 0 END AS turn FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)),
g AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY i) AS seg FROM t)
SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seg) AS INT) AS segment_no, chapter, section, string_agg('event ' || event_id, chr(10) ORDER BY i) AS text,
       CAST(min(page) AS INT) AS page_start, CAST(max(page) AS INT) AS page_end
FROM g WHERE head IS NULL GROUP BY user_id, seg, chapter, section""")
def segments_of_pages(spark, d):
    """Events as blocks of a user's pages; purchases open chapters, signups sections, every third page has a chapter of its own, every seventh lists contents."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    i = F.row_number().over(order) - 1
    kind, no = F.col("event_type"), F.col("event_id")
    text = F.when(kind == "purchase", F.concat(F.lit("第一章 "), no)).when(kind == "signup", F.concat(F.lit("第一节 "), no)).otherwise(F.concat(F.lit("event "), no))
    blocks = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (F.floor(i / 5) + 1).cast("int").alias("page"), i.alias("block_no"), kind.alias("type"), text.alias("text"), F.lit(None).cast("string").alias("asset_id"))
    pages = blocks.select("doc_id", "page").distinct()
    told = pages.where("page % 3 = 0").select("doc_id", "page", F.lit("第二章 of pages").alias("chapter"), F.lit(None).cast("string").alias("section"))
    out = L.structured_segments(blocks, told, pages.where("page % 7 = 1"))
    return out.select("doc_id", "segment_no", "chapter", "section", "text", "page_start", "page_end")


@query("""
WITH l AS (SELECT l_orderkey AS doc_id, l_partkey, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem),
b AS (SELECT doc_id, n AS position, CAST(n AS VARCHAR) AS number, '已知甲求 ' || l_partkey AS text, 0 AS is_answer FROM l
      UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 200 - n ELSE 100 + n END, CAST(n AS VARCHAR), f, 1 FROM l WHERE n % 2 = 1
      UNION ALL SELECT doc_id, 50, '1', '已知乙求', 0 FROM l WHERE n = 1 AND doc_id % 3 = 2),
f AS (SELECT *, min(position) OVER (PARTITION BY doc_id, number) AS first, count(*) OVER (PARTITION BY doc_id) AS of FROM b),
s AS (SELECT a.doc_id, a.position AS split, x.number, x.is_answer, x.first, x.of, lag(x.first) OVER (PARTITION BY a.doc_id, a.position ORDER BY x.position) AS before
      FROM b AS a JOIN f AS x ON x.doc_id = a.doc_id AND x.position >= a.position),
good AS (SELECT doc_id, split, sum(is_answer) = count(*) AS whole FROM s GROUP BY doc_id, split
         HAVING count(*) >= 2 AND min(of) >= 3 AND count(DISTINCT number) = count(*) AND max(first) < split AND sum(is_answer) >= greatest(1, count(*) - 1) AND count(*) FILTER (WHERE before >= first) = 0),
chosen AS (SELECT doc_id, min(split) AS split, arg_min(whole, split) AS whole FROM good GROUP BY doc_id),
m AS (SELECT b.*, coalesce(whole AND position >= split, false) AS in_bank FROM b LEFT JOIN chosen USING (doc_id))
SELECT doc_id, CAST(position AS INT) AS position, number, text, bank_answer
FROM (SELECT *, max(CASE WHEN in_bank THEN text END) OVER (PARTITION BY doc_id, number) AS bank_answer FROM m) WHERE NOT in_bank""")
def repeated_banks(spark, d):
    """Answers to odd questions behind the questions; a third of the papers answers in reverse, another repeats a question before them. The oracle tries each split."""
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = table(spark, d, "lineitem").withColumn("n", F.row_number().over(at))
    key, n = F.col("l_orderkey"), F.col("n")
    asked = lines.select(key.alias("doc_id"), n.alias("position"), n.cast("string").alias("number"), F.concat(F.lit("已知甲求 "), "l_partkey").alias("text"))
    given = lines.where(n % 2 == 1).select(key.alias("doc_id"), F.when(key % 3 == 0, 200 - n).otherwise(n + 100).alias("position"), n.cast("string").alias("number"), F.col("l_returnflag").alias("text"))
    between = lines.where((n == 1) & (key % 3 == 2)).select(key.alias("doc_id"), F.lit(50).alias("position"), F.lit("1").alias("number"), F.lit("已知乙求").alias("text"))
    out = L.repeated_banks_merged(asked.unionByName(given).unionByName(between))
    return out.select("doc_id", F.col("position").cast("int").alias("position"), "number", "text", "bank_answer")


def joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("""SELECT p_partkey, '1. ' || p_brand || chr(10) || '2. ' || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'goes on' ELSE '' END || chr(10) ||
CASE p_size % 3 WHEN 0 THEN '1. 解析：' || p_name || chr(10) || '2. ' || p_brand WHEN 1 THEN '解析：' || p_name || chr(10) || 'more' ELSE '3. 解析：' || p_name END AS bank FROM part""")
def banks_normalised(spark, d):
    """Inline entries, lines that go on, explanations of three kinds, an answer among them."""
    size = F.col("p_size")
    why = F.when(size % 3 == 0, joined("【解析】 1. ", F.col("p_name"), " 2. 答案：", F.col("p_brand"))).when(size % 3 == 1, joined("解析：", F.col("p_name"), "\n more ")).otherwise(joined("详解\n\n（3）", F.col("p_name")))
    text = joined("答案：1. ", F.col("p_brand"), " 2. ", F.col("p_type"), "\n", F.when(size % 2 == 0, "goes on\n").otherwise(""), why)
    return table(spark, d, "part").select("p_partkey", K.normalised_bank(text).alias("bank"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY g), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), ' ' || chr(10) || chr(9)) AS text
FROM (SELECT doc_id, g, string_agg(l, ' ' ORDER BY i) AS line FROM (
  SELECT doc_id, i, l, sum(CASE WHEN l = '' OR prev = '' OR begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
    SELECT doc_id, i, l, lag(l) OVER (PARTITION BY doc_id ORDER BY i) AS prev, regexp_matches(l, '^(#{1,6}\s|[*+-]\s|[0-9]{1,2}\.\s|[0-9]{1,2}[)）]\s|>\s|\|)') AS begins FROM (
      SELECT doc_id, i, trim(ls[i], ' ' || chr(9)) AS l FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(160), ' '), chr(10)) AS ls FROM documents WHERE NOT regexp_matches(text, '[$\\`~\r\x0b\x0c\x1c-\x1f\x85 -     　 ]')), unnest(range(1, len(ls) + 1)) AS t(i))))
  GROUP BY doc_id, g) GROUP BY doc_id""")
def markdown_paragraphs(spark, d):
    """H14 over all documents without formulas and fences: soft breaks join, blocks stay; marks are tested by hand."""
    plain = table(spark, d, "documents").where(~F.rlike("text", F.lit(r"[$\\`~\r\x0b\x0c\x1c-\x1f\x85 -     　 ]")))
    return plain.select("doc_id", normalised_markdown(F.col("text")).alias("text"))


@query(r"""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '$\frac{' || p_size || '}{\sqrt{' || p_brand || '}}$' WHEN 1 THEN '$\sum_{i}^{' || p_size || '} {x}_{i}^{2}$'
WHEN 2 THEN '$\left\{\begin{matrix}' || p_size || ' & a \\ b & \vec{v}\end{matrix}\right)$' ELSE '$$' || p_type || '$$' || chr(10) || '$$' || p_size || '$$' END AS latex FROM part""")
def formulas_as_latex(spark, d):
    """Fractions in roots, sums with scripts, matrices in brackets with accents, paragraphs of formulas."""
    m = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    tag = lambda name, *parts: joined(f"<m:{name}>", *parts, f"</m:{name}>")
    run = lambda t: tag("r", tag("t", t))
    size = F.col("p_size").cast("string")
    e = lambda *parts: tag("e", *parts)
    frac = tag("f", tag("num", run(size)), tag("den", tag("rad", tag("deg", ""), e(run(F.col("p_brand"))))))
    total = tag("nary", tag("naryPr", '<m:chr m:val="∑"/>'), tag("sub", run("i")), tag("sup", run(size)), e(tag("sSubSup", e(run("x")), tag("sub", run("i")), tag("sup", run("2")))))
    accent = tag("acc", tag("accPr", '<m:chr m:val="→"/>'), e(run("v")))
    matrix = tag("d", tag("dPr", '<m:begChr m:val="{"/>'), e(tag("m", tag("mr", e(run(size)), e(run("a"))), tag("mr", e(run("b")), e(accent)))))
    one = lambda x: joined(f"<m:oMath {m}>", x, "</m:oMath>")
    many = joined(f"<m:oMathPara {m}>", tag("oMath", run(F.col("p_type"))), tag("oMath", run(size)), "</m:oMathPara>")
    xml = F.when(F.col("p_size") % 4 == 0, one(frac)).when(F.col("p_size") % 4 == 1, one(total)).when(F.col("p_size") % 4 == 2, one(matrix)).otherwise(many)
    return with_latex(table(spark, d, "part").select("p_partkey", xml.alias("xml")), "xml").select("p_partkey", "latex")
