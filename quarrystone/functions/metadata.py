"""Metadata as columns: JSON layers, labels, flags, keys, titles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def layered(parts: Mapping[str, Mapping[str, Column]]) -> Column:
    """JSON of named layers; null and empty values are left out, and so are layers without any."""

    def layer(fields: Mapping[str, Column]) -> Column:
        cells = [F.when(c.cast("string") != "", c).alias(n) for n, c in fields.items()]
        some = F.coalesce(*[F.when(c.cast("string") != "", F.lit(True)) for c in fields.values()])
        return F.when(some, F.struct(*cells))

    return F.to_json(F.struct(*[layer(f).alias(n) for n, f in parts.items()]))


def kept_keys(json: Column, keys: Sequence[str]) -> Column:
    """A flat JSON object with only these keys."""
    return F.to_json(F.map_filter(F.from_json(json, "map<string,string>"), lambda k, v: k.isin(*keys)))


def usage_tokens(json: Column) -> Column:
    """Prompt, completion and total tokens of a provider's usage report, under either of their names."""
    of = lambda *paths: F.coalesce(*[F.get_json_object(json, p).cast("long") for p in paths], F.lit(0))
    prompt, done = of("$.prompt_tokens", "$.input_tokens"), of("$.completion_tokens", "$.output_tokens")
    total = F.coalesce(F.get_json_object(json, "$.total_tokens").cast("long"), prompt + done)
    return F.struct(prompt.alias("prompt"), done.alias("completion"), total.alias("total"))


def week_key(day: Column) -> Column:
    """ISO year and week, the week not padded."""
    return F.concat_ws("-W", F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.weekofyear(day).cast("string"))


def question_flags(question: Column, answer: Column, images: Column, needs_image: Column) -> Column:
    """What is wrong with a question, in order."""
    checks = [
        F.when(F.coalesce(F.trim(question), F.lit("")) == "", "empty_question_text"),
        F.when(needs_image & (F.coalesce(images, F.lit(0)) == 0), "missing_required_image"),
        F.when(F.size(F.regexp_extract_all(question, F.lit(r"(?m)^\s*\d{1,3}[.、]\s*\S"), F.lit(0))) > 1, "multi_question_suspected"),
        F.when((F.coalesce(F.trim(answer), F.lit("")) == "") & (F.trim(question) != ""), "answer_pairing_suspected"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def image_binding(needs: Column, wants: Column, images: Column) -> Column:
    has = F.coalesce(images, F.lit(0)) > 0
    return F.when(has, "bound").when(needs, "missing_required").when(wants, "optional_unbound").otherwise("none_needed")


def locator(doc: Column, group: Column, number: Column, suffix: Column) -> Column:
    """Where a record comes from, as one text; a missing part is left out."""
    none = lambda c: F.when(c.cast("string") != "", c.cast("string"))
    return F.concat_ws("/", F.concat(F.lit("d:"), none(doc)), F.concat(F.lit("g:"), none(group)), F.concat(F.lit("q:"), none(number)), none(suffix))


def clean_title(name: Column) -> Column:
    """A file name as a title: extension, copy and version marks, dates and outline numbers go."""
    for pattern, by in (
        (r"(?i)\.(pdf|docx?|pptx?|txt|md|xlsx?)$", ""),
        (r"(?i)(?:[\s_\-]*(?:\(\d+\)|（\d+）|copy|副本|v\d+(?:\.\d+)*|final|最终版|(?<!\d)(?:19|20)\d{2}[-.年]?\d{1,2}[-.月]?\d{1,2}日?))+$", ""),
        (r"^\s*(?:\d+(?:\.\d+)*[.、\s]+|第[一二三四五六七八九十\d]+[章节课]\s*)+", ""),
        (r"[\s_]+", " "),
    ):
        name = F.regexp_replace(name, pattern, by)
    return F.trim(name)


def title_tags(title: Column, most: int = 5) -> Column:
    """Names in book marks, else what follows a colon, else the title itself; at most ``most``."""
    marked = F.regexp_extract_all(title, F.lit("《([^》]{2,32})》"), F.lit(1))
    after = F.trim(F.regexp_extract(title, "[:：](.{2,32})$", 1))
    tags = F.when(F.size(marked) > 0, marked).when(after != "", F.array(after)).when(F.char_length(title) >= 2, F.array(F.substring(title, 1, 32))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(tags), 1, most)


def confidence(score: Column, letters: Column) -> Column:
    """Grade of a text read from an image, by its confidence and its share of meaningful characters."""
    return F.when(F.coalesce(letters, F.lit(0.0)) < 0.3, "low").when(score >= 0.85, "high").when(score >= 0.6, "medium").otherwise("low")


def meaningful(text: Column) -> Column:
    """Share of letters, digits and CJK characters."""
    n = F.char_length(text)
    return F.when(n > 0, F.char_length(F.regexp_replace(text, r"[^A-Za-z0-9一-鿿]", "")) / n).otherwise(F.lit(0.0))
