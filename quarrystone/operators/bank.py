"""Question banks: filters of lists, nested reads, summaries, states, and the assets of their texts."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.metadata import kept_keys
from quarrystone.functions.sections import heading, title_key
from quarrystone.operators.sequence import forward_filled

# ---------------------------------------------------------------- filters


def of_grade(rows: DataFrame, wanted: str | None, grade: str = "grade", graduated: str = "graduated_at") -> DataFrame:
    """People of a grade 1, 2 or 3 who are still there, without a grade ("unset"), or "graduated"; any other word keeps all."""
    word = (wanted or "").strip().lower()
    if word in ("1", "2", "3"):
        return rows.where((F.col(grade) == int(word)) & F.col(graduated).isNull())
    if word == "unset":
        return rows.where(F.col(grade).isNull() & F.col(graduated).isNull())
    return rows.where(F.col(graduated).isNotNull()) if word == "graduated" else rows


def containing(rows: DataFrame, column: str, word: str | None) -> DataFrame:
    """Rows whose column has the word, capitals as they are; an empty word keeps all."""
    word = (word or "").strip()
    return rows.where(F.contains(F.col(column), F.lit(word))) if word else rows


def among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is in a list of any length."""
    return rows.join(wanted.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def newest_where(rows: DataFrame, equal: Mapping[str, object | None], order: Sequence[Column], limit: int) -> DataFrame:
    """The newest rows of those that match; conditions come before the limit, absent ones count not."""
    for column, value in equal.items():
        rows = rows if value in (None, "") else rows.where(F.col(column) == F.lit(value))
    return rows.orderBy(*order).limit(limit)


def masked(rows: DataFrame, secret: Sequence[str], role: Column) -> DataFrame:
    """The columns ``secret`` only for staff; students read null."""
    return rows.withColumns({c: F.when(role != "student", F.col(c)) for c in secret})


# ---------------------------------------------------------------- nested reads


def with_children(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Each parent with its children as an array, in order; aggregated before the join, empty where there are none."""
    fields = [c for c in children.columns if c != key]
    whole = F.struct(*[F.col(c) for c in [*order, *[f for f in fields if f not in order]]])
    listed = children.groupBy(key).agg(F.array_sort(F.collect_list(whole)).alias(name))
    return parents.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(dict(listed.dtypes)[name])))


def history_before(messages: DataFrame, turns: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """For each asked turn the messages strictly before it, as (role, text) in order.

    ``turns``: key and turn, once each. All turns of a conversation share one
    ordered list; none is joined with every message.
    """
    lists = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(turn, "role", "text"))).alias("m"))
    before = F.transform(F.filter("m", lambda x: x[turn] < F.col(turn)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    none = F.array().cast("array<struct<role:string,text:string>>")
    return turns.join(lists, key, "left").select(key, turn, F.coalesce(before, none).alias("history"))


def by_chapter_number(titles: DataFrame, entries: DataFrame) -> DataFrame:
    """The chapter of a title's number: title_id, chapter.

    ``titles``: title_id, number, decimal (whether its sections are written
    1.2). ``entries``: place, kind, chapter, number, style. The first chapter
    of that number; for decimal titles the first that has decimal sections, if
    any has.
    """
    styles = entries.where("style = 'decimal'").select("number", "chapter").distinct().withColumn("decimal_too", F.lit(True))
    chapters = entries.where("kind = 'chapter'").join(styles, ["number", "chapter"], "left").withColumn("decimal_too", F.coalesce("decimal_too", F.lit(False)))
    best = chapters.groupBy("number").agg(F.min_by("chapter", "place").alias("first"), F.min_by("chapter", F.when(F.col("decimal_too"), F.col("place"))).alias("first_decimal"))
    chosen = F.when(F.col("decimal"), F.coalesce("first_decimal", "first")).otherwise(F.col("first"))
    return titles.join(best, "number").select("title_id", chosen.alias("chapter"))


def catalogue_titles(headings: DataFrame, entries: DataFrame) -> DataFrame:
    """Headings as their catalogue writes them: heading_id, title, normalized (whether it was changed).

    ``headings``: heading_id, doc_id, title. ``entries``: doc_id, place, title.
    The first entry of the same key counts; headings without one stay.
    """
    first = entries.withColumn("key", title_key(F.col("title"))).where("key is not null and title <> ''").groupBy("doc_id", "key").agg(F.min_by("title", "place").alias("written"))
    done = headings.withColumn("key", title_key(F.col("title"))).join(first, ["doc_id", "key"], "left")
    title = F.coalesce("written", "title")
    return done.select("heading_id", title.alias("title"), F.coalesce(title != F.col("title"), F.lit(False)).alias("normalized"))


def reread_metadata(chunks: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Chunks of stored documents with chapter, section and metadata as their texts now say.

    ``chunks``: doc_id, chunk_index, text, kind, metadata (flat JSON or null),
    and the document's own doc_chapter and doc_section. A chapter clears the
    section before it; the document's own hold until the first of either. Of
    the metadata the keys ``keep`` stay.
    """
    opened = chunks.withColumn("__h", heading(F.col("text"), F.col("kind")))
    read = forward_filled(opened, "doc_id", "chunk_index", F.col("__h.chapter"), F.col("__h.section"))
    section = F.when(F.col("chapter").isNull(), F.coalesce("section", "doc_section")).otherwise(F.col("section"))
    fixed = F.coalesce(kept_keys(F.coalesce("metadata", F.lit("{}")), keep), F.lit("{}"))
    return read.select("doc_id", "chunk_index", F.coalesce("chapter", "doc_chapter").alias("chapter"), section.alias("section"), fixed.alias("metadata"))


def edited_metadata(json: Column, new: Mapping[str, Column], derived: Sequence[str]) -> Column:
    """A flat JSON object after an edit: derived keys go, as they no longer hold, and new values replace old ones."""
    kept = F.map_filter(F.from_json(F.coalesce(json, F.lit("{}")), "map<string,string>"), lambda k, v: ~k.isin(*derived, *new))
    cells = F.map_from_arrays(F.array(*map(F.lit, new)), F.array(*[c.cast("string") for c in new.values()]))
    return F.to_json(F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), cells))


def classed(documents: DataFrame, report: DataFrame, classes: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Documents that a report puts in one of the classes."""
    return documents.join(report.where(F.col("class").isin(*classes)).select(key).distinct(), key, "left_semi")


# ---------------------------------------------------------------- summaries


def ingest_summary(chunks: DataFrame, key: str) -> DataFrame:
    """Per document: chunks, questions, answers, explanations, chapters, sections, images, and whether ids are grouped."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return chunks.groupBy(key).agg(
        F.count("*").alias("chunks"),
        *[F.count(filled(c)).alias(f"{c}s") for c in ("question", "answer", "explanation")],
        F.countDistinct(filled("chapter")).alias("chapters"),
        F.countDistinct(filled("section")).alias("sections"),
        F.coalesce(F.sum("images"), F.lit(0)).alias("images"),
        F.coalesce(F.bool_or(F.contains("number", F.lit("-"))), F.lit(False)).alias("grouped"),
    )


def page_spans(rows: DataFrame, key: str, page: str) -> DataFrame:
    """First, last and all pages of each key."""
    return rows.groupBy(key).agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.array_sort(F.collect_set(page)).alias("pages"))


def bank_answers_fit(asked: Column, answered: Column) -> Column:
    """Whether a bank of answers belongs to these questions: two numbers or more, and none that was not asked."""
    numbers = F.array_distinct(answered)
    return (F.size(numbers) >= 2) & (F.size(F.array_except(numbers, asked)) == 0)


# ---------------------------------------------------------------- states


def marked(rows: DataFrame, chosen: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """Soft deletion, archiving, disabling or (with null) restoring: ``column`` set for the chosen keys."""
    flags = chosen.select(key).distinct().withColumn("__hit", F.lit(True))
    return rows.join(flags, key, "left").withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).drop("__hit").select(*rows.columns)


def patched(rows: DataFrame, columns: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Rows of an older table under a newer schema: missing columns are added, nulls filled; name -> (type, default)."""
    for name, (kind, default) in columns.items():
        own = F.coalesce(F.col(name).cast(kind), default.cast(kind)) if name in rows.columns else default.cast(kind)
        rows = rows.withColumn(name, own)
    return rows


# ---------------------------------------------------------------- assets

def labelled_assets(texts: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """Texts with numbered labels for their markers ``[[asset:x]]``, and the assets in order of first mention.

    ``assets``: key, asset_id, title. A known asset's label is numbered by
    first mention among known ones and says its title; a marker of no asset is
    a label without number. Labels follow the count so far, as readers see it.
    """
    own = assets.groupBy(key).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("asset_id", F.coalesce("title", F.lit("")).alias("title"))))).alias("known"))
    parts = F.split("text", r"(?=\[\[asset:)")
    name = lambda p: F.regexp_extract(p, r"^\[\[asset:([A-Za-z0-9_.-]+)\]\]", 1)
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("seen"))

    def step(acc: Column, part: Column) -> Column:
        asset, title = name(part), F.element_at("known", name(part))
        rest = F.regexp_replace(part, r"^\[\[asset:[A-Za-z0-9_.-]+\]\]", "")
        seen = F.when(title.isNotNull() & ~F.array_contains(acc["seen"], asset), F.concat(acc["seen"], F.array(asset))).otherwise(acc["seen"])
        label = F.when(title.isNull(), F.lit("【附图】")).otherwise(F.concat(F.lit("【附图"), F.size(seen).cast("string"), F.when(title != "", F.concat(F.lit("："), title)).otherwise(F.lit("")), F.lit("】")))
        return F.struct(F.concat(acc["text"], F.when(asset == "", part).otherwise(F.concat(label, rest))).alias("text"), seen.alias("seen"))

    whole = texts.join(own, key, "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,string>")))
    return whole.withColumn("done", F.aggregate(parts, start, step)).select(key, F.col("done.text").alias("text"), F.col("done.seen").alias("assets"))


def distinct_assets(refs: Column) -> Column:
    """References without later ones of the same id, file name and address."""
    same = lambda a, b: (F.coalesce(a["asset_id"], F.lit("")) == F.coalesce(b["asset_id"], F.lit(""))) & (F.coalesce(a["filename"], F.lit("")) == F.coalesce(b["filename"], F.lit(""))) & (F.coalesce(a["url"], F.lit("")) == F.coalesce(b["url"], F.lit("")))
    return F.filter(refs, lambda x, i: ~F.exists(F.slice(refs, F.lit(1), i), lambda y: same(x, y)))


def flat_text(value: object) -> str:
    """The text of a tree of content: lists line by line, formulas after their kind, other maps by their parts."""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, list):
        return "\n".join(t for t in map(flat_text, value) if t)
    if not isinstance(value, dict):
        return ""
    kind = str(value.get("type") or "").strip().lower()
    if kind == "text":
        return str(value.get("content") or "").strip()
    if "equation" in kind:
        name = "equation_interline" if "interline" in kind else "equation_inline"
        return "\n".join(t for t in (name, str(value.get("content") or "").strip()) if t)
    return flat_text([v for k, v in value.items() if k != "type"])


def flattened(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Key, text and roles (top keys that hold text) of JSON trees of any depth; what is no JSON gives neither."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, roles = [], []
            for raw in batch.column(1).to_pylist():
                try:
                    tree = json.loads(raw or "null")
                except ValueError:
                    tree = None
                texts.append(flat_text(tree))
                roles.append([k for k, v in tree.items() if k != "type" and flat_text(v)] if isinstance(tree, dict) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(roles, pa.list_(pa.string()))], names=[key, "text", "roles"])

    return rows.select(key, content).mapInArrow(read, f"{key} {dict(rows.dtypes)[key]}, text string, roles array<string>")


# ---------------------------------------------------------------- prompts


def prompts(turns: DataFrame, base: str, last: int = 6) -> DataFrame:
    """The request of each turn: the base, subject, stage and context as system text, the last messages, the question.

    ``turns``: turn_id, subject, stage, context (or null), history (role,
    text), question. Absent parts leave no line.
    """
    named = [("学科", "subject"), ("引导阶段", "stage"), ("知识库参考", "context")]
    lines = [F.lit(base), *[F.when(F.trim(c) != "", F.concat(F.lit(f"{label}："), F.col(c))) for label, c in named]]
    message = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    recent = F.slice("history", F.greatest(F.size("history") - last + 1, F.lit(1)), F.lit(last))
    return turns.select("turn_id", F.concat(F.array(message(F.lit("system"), F.concat_ws("\n", *lines))), recent, F.array(message(F.lit("user"), F.col("question")))).alias("messages"))

