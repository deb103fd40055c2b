"""Blocks of laid-out pages: questions, sections, and answer banks that repeat the numbers of the questions before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import banks as K
from quarrystone.functions import sections as S
from quarrystone.functions.text import stripped

# A heading behind which a document's answers stand.
BANK_HEADING = r"(?U)^\s*【?(?:参考)?(?:答案(?:与解析)?|答案及解析|解答|参考解答|参考解析|解析|详解)】?\s*$"


def in_order(items: Column, field: str) -> Column:
    """A field of collected structs, in their order, nulls left out."""
    return F.filter(F.transform(F.array_sort(items), lambda x: x[field]), lambda x: x.isNotNull())


def placed(blocks: DataFrame, pages: DataFrame | None, kind: str) -> DataFrame:
    """The blocks with the chapter and section that they stand in, whether they are headings, and ``turn``, which grows where either changes.

    ``pages`` (doc_id, page, chapter, section) says where pages stand: that
    overrides what headings said before, until the next heading; a chapter that
    changes so without a section leaves none.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "block_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = blocks.withColumn("text", stripped(F.coalesce("text", F.lit("")))).withColumn("head", S.heading(F.col("text"), F.lit(kind)))
    if pages is not None:
        told = pages.select("doc_id", "page", F.col("chapter").alias("page_chapter"), F.col("section").alias("page_section"))
        rows = rows.join(told, ["doc_id", "page"], "left")
    else:
        rows = rows.withColumns({"page_chapter": F.lit(None).cast("string"), "page_section": F.lit(None).cast("string")})
    rows = rows.withColumn("chapter", F.last(F.coalesce("head.chapter", "page_chapter"), True).over(so_far))
    # The page's word comes before the block's own heading.
    before = F.lag("chapter").over(order)
    changed = F.col("page_chapter").isNotNull() & ~F.col("page_chapter").eqNullSafe(before)
    event = (
        F.when(F.col("head.chapter").isNotNull(), F.struct(F.lit(None).cast("string").alias("s")))
        .when(F.col("head.section").isNotNull(), F.struct(F.col("head.section").alias("s")))
        .when(F.col("page_section").isNotNull(), F.struct(F.col("page_section").alias("s")))
        .when(changed, F.struct(F.lit(None).cast("string").alias("s")))
    )
    rows = rows.withColumn("event", event).withColumn("section", F.last("event", True).over(so_far)["s"])
    is_head = F.col("head").isNotNull()
    moved = ~(F.col("chapter").eqNullSafe(before) & F.col("section").eqNullSafe(F.lag("section").over(order)))
    rows = rows.withColumn("is_head", is_head).withColumn("moved", F.coalesce(moved, F.lit(True)))
    return rows.withColumn("turn", F.sum((F.col("is_head") | F.col("moved")).cast("int")).over(so_far)).drop("head", "event", "page_chapter", "page_section", "moved")


def structured_segments(blocks: DataFrame, pages: DataFrame | None = None, contents: DataFrame | None = None, kind: str = "textbook") -> DataFrame:
    """A row per run of blocks under one heading: doc_id, segment_no, chapter, section, text, page_start, page_end, block_types, assets.

    ``blocks``: doc_id, page, block_no, type, text, asset_id. Pages named in
    ``contents`` (doc_id, page) are left out, as are blocks with neither text
    nor asset; headings are no text. Documents are wholes to a task, as long as
    they are.
    """
    rows = blocks.where((stripped(F.coalesce("text", F.lit(""))) != "") | F.col("asset_id").isNotNull())
    if contents is not None:
        rows = rows.join(contents.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    rows = placed(rows, pages, kind).where(~F.col("is_head"))
    each = F.collect_list(F.struct("page", "block_no", F.nullif("text", F.lit("")).alias("text"), "asset_id"))
    found = rows.groupBy("doc_id", "turn", "chapter", "section").agg(each.alias("b"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.array_sort(F.collect_set("type")).alias("block_types"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("turn"))
    return found.select("doc_id", number.alias("segment_no"), "chapter", "section", F.array_join(in_order(F.col("b"), "text"), "\n").alias("text"), "page_start", "page_end", "block_types", F.array_distinct(in_order(F.col("b"), "asset_id")).alias("assets"))


def question_blocks(blocks: DataFrame, kind: str = "question_set") -> DataFrame:
    """A row per question of laid-out pages: doc_id, question_no, number, chapter, section, question, answer, explanation, page_start, page_end, block_types, assets.

    A question goes on over block and page borders to the next question,
    heading, or heading of answers; from that on blocks are answers, whose
    entries fill what questions lack by their number (its last entry counts),
    even such as elsewhere would be headings.
    Questions without text go. Null texts are empty.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "block_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed(blocks, None, kind)
    opens = ~F.col("is_head") & F.rlike("text", F.lit(BANK_HEADING))
    rows = rows.withColumn("opens", opens).withColumn("in_bank", F.max("opens").over(so_far))
    start = ~F.col("is_head") & ~F.col("in_bank") & F.rlike("text", F.lit(f"(?U)^{S.QUESTION_START}"))
    rows = rows.withColumn("start", start).withColumn("part", F.sum((F.col("start") | F.col("is_head")).cast("int")).over(so_far))

    # Blocks are read once: a document's bank is one more part, without a number.
    line = F.when(F.col("start"), K.behind(F.col("text"), S.QUESTION_START)).otherwise(F.col("text"))
    number = F.when(F.col("start"), F.regexp_extract("text", K.FIRST_NUMBER, 1))
    rows = rows.where(F.when(F.col("in_bank"), ~F.col("opens")).otherwise(~F.col("is_head"))).withColumn("part", F.when(~F.col("in_bank"), F.col("part")))
    each = F.collect_list(F.struct("page", "block_no", F.nullif(line, F.lit("")).alias("line"), "asset_id"))
    parts = rows.groupBy("doc_id", "part").agg(
        F.max(number).alias("number"), F.sort_array(each).alias("b"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
        F.sort_array(F.collect_set("type")).alias("block_types"), F.max("chapter").alias("chapter"), F.max("section").alias("section"),
    )
    parts = parts.where("part IS NULL OR number IS NOT NULL").withColumn("text", F.array_join("b.line", "\n"))
    asked = F.col("part").isNotNull()
    parts = parts.withColumn("said", F.when(asked, K.question_sections(F.col("text")))).withColumn("bank", F.when(~asked, K.normalised_bank(F.col("text"))))
    some = (F.col("said.question") != "") | F.col("said.answer").isNotNull() | F.col("said.explanation").isNotNull()
    item = F.struct("part", "number", "chapter", "section", "said", "page_start", "page_end", "block_types", F.array_distinct(F.array_compact("b.asset_id")).alias("assets"))
    docs = parts.groupBy("doc_id").agg(F.max("bank").alias("bank"), F.sort_array(F.collect_list(F.when(some, item))).alias("asked"))
    entries = F.transform(S.numbered_entries(F.col("bank"), F.col("asked.number")), lambda e: F.struct(e["number"], S.answer_sections(e["entry"])))
    docs = docs.withColumn("given", F.when(F.col("bank").isNotNull(), F.map_from_entries(entries)))

    def filled(item: Column, i: Column) -> Column:
        given = F.try_element_at(F.col("given"), item["number"])
        said = [item["said"]["question"], *[F.coalesce(item["said"][c], given[c]).alias(c) for c in ("answer", "explanation")]]
        return F.struct((i + 1).alias("question_no"), item["number"], item["chapter"], item["section"], *said, *[item[c] for c in ("page_start", "page_end", "block_types", "assets")])

    return docs.select("doc_id", F.inline(F.transform("asked", filled)))


def repeated_banks_merged(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, position, number, text) without a bank of answers at the end that repeats numbers, and what that bank answers: bank_answer, bank_explanation.

    The bank is the longest end of two or more blocks whose numbers differ, all
    stand before it, in the order in which they come first there, and of which
    all but one at most look like answers. If one of them is none after all, or
    the document has fewer than three blocks, all blocks stay. Found in one
    backward pass over each document. Null numbers take part as empty ones.
    """
    rows = blocks.withColumn("number", F.coalesce("number", F.lit(""))).withColumn("payload", K.answer_payload(F.col("text")))
    like = F.coalesce(F.col("payload.answer"), F.col("payload.explanation")).isNotNull().cast("int")
    same = Window.partitionBy("doc_id", "number")
    order = Window.partitionBy("doc_id").orderBy("position")
    back = Window.partitionBy("doc_id").orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"like": like, "earlier": F.lag("position").over(same.orderBy("position")), "first": F.min("position").over(same)})
    rows = rows.withColumn("rising", F.coalesce(F.lead("first").over(order) > F.col("first"), F.lit(True)))
    rows = rows.withColumns({
        "n": F.count("*").over(back),
        "likes": F.sum("like").over(back),
        "all_before": F.min(F.col("earlier").isNotNull()).over(back) & (F.max("earlier").over(back) < F.col("position")) & F.min("rising").over(back),
        "of": F.count("*").over(Window.partitionBy("doc_id")),
    })
    fits = F.col("all_before") & (F.col("n") >= 2) & (F.col("n") < F.col("of")) & (F.col("of") >= 3) & (F.col("likes") >= F.greatest(F.lit(1), F.col("n") - 1))
    rows = rows.withColumn("split", F.min(F.when(fits, F.struct("position", (F.col("likes") == F.col("n")).alias("whole")))).over(Window.partitionBy("doc_id")))
    in_bank = F.coalesce(F.col("split.whole") & (F.col("position") >= F.col("split.position")), F.lit(False))
    rows = rows.withColumn("in_bank", in_bank)
    # The bank's numbers differ, so that one block at most has each.
    told = F.max(F.when(F.col("in_bank"), F.struct("payload.answer", "payload.explanation"))).over(same)
    rows = rows.withColumn("told", told).where(~F.col("in_bank"))
    return rows.select(*[F.col(f"`{c}`") for c in blocks.columns], F.col("told.answer").alias("bank_answer"), F.col("told.explanation").alias("bank_explanation"))
