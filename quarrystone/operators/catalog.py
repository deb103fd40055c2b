"""Catalogue queries: filters, search, paging, facets, suggestions, and writes as next states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(rows: DataFrame, equal: Mapping[str, object | None]) -> DataFrame:
    """Rows equal in all columns whose wanted value is given (None: any)."""
    wanted = [F.col(c) == F.lit(v) for c, v in equal.items() if v is not None]
    return rows.where(reduce(lambda a, b: a & b, wanted)) if wanted else rows


def keyword(rows: DataFrame, word: str | None, columns: Sequence[str]) -> DataFrame:
    """Rows that contain ``word`` in any of the columns, whatever its case."""
    if not word:
        return rows
    return rows.where(reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(word.lower())) for c in columns]))


def tagged(rows: DataFrame, word: str, tags: str = "tags") -> DataFrame:
    """Rows any of whose tags contains ``word``, whatever its case."""
    return rows.where(F.exists(tags, lambda t: F.contains(F.lower(F.trim(t)), F.lit(word.lower()))))


def tri_state(rows: DataFrame, column: str, wanted: bool | None) -> DataFrame:
    """All rows, or those whose column is not null (True) or null (False)."""
    if wanted is None:
        return rows
    return rows.where(F.col(column).isNotNull() if wanted else F.col(column).isNull())


def page(rows: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """One page of the ordered rows (from 1); the order should end in a unique key."""
    size = max(1, min(size, 1000))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_with_total(rows: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """A page, each row with the count of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return page(rows, order, number, size).crossJoin(F.broadcast(total))


def suggestions(values: DataFrame, column: str, typed: str, limit: int = 20) -> DataFrame:
    """Distinct values that contain ``typed``, those that start with it first, then by alphabet; one spelling of each."""
    low = F.lower(F.trim(F.col(column)))
    hits = values.where(F.contains(low, F.lit(typed.lower())) & (low != "")).select(F.trim(F.col(column)).alias("value"), low.alias("low"))
    one = hits.groupBy("low").agg(F.min("value").alias("value"))
    return one.withColumn("starts", F.startswith("low", F.lit(typed.lower()))).orderBy(F.desc("starts"), "low").limit(limit).select("value", "starts")


def vocabulary(*sources: tuple[DataFrame, str]) -> DataFrame:
    """Distinct trimmed non-empty terms of several tables' columns, with the number of tables that have them."""
    parts = [df.select(F.trim(F.col(c)).alias("term"), F.lit(i).alias("source")).where("term <> ''").distinct() for i, (df, c) in enumerate(sources)]
    return reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.count("*").alias("sources"))


def structure(rows: DataFrame, chapter: str, section: str) -> DataFrame:
    """Sorted distinct sections of each chapter."""
    return rows.groupBy(chapter).agg(F.array_sort(F.collect_set(section)).alias("sections"))


def latest(children: DataFrame, parent: str, order: Sequence[Column]) -> DataFrame:
    """The latest child of each parent."""
    newest = Window.partitionBy(parent).orderBy(*order)
    return children.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def with_flag(rows: DataFrame, key: str, other: DataFrame, flag: str) -> DataFrame:
    """Every row, and whether the other table has its key."""
    keys = other.select(key).distinct().withColumn(flag, F.lit(True))
    return rows.join(keys, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def missing(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table lacks."""
    return rows.join(other.select(key), key, "left_anti")


def json_has(json: Column, key: str) -> Column:
    """Whether a JSON object has a key, be its value null."""
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def effective(json: Column, key: str, fallback: Column) -> Column:
    """The JSON value where its key is present (even null), else the fallback."""
    return F.when(json_has(json, key), F.get_json_object(json, f"$.{key}")).otherwise(fallback)


def chunk_summary(messages: DataFrame, parent: str, role: Column) -> DataFrame:
    """Per parent: questions, answers, explanations and how they fail to match."""
    return (
        messages.groupBy(parent)
        .agg(F.count("*").alias("chunks"), F.count_if(role == "user").alias("questions"), F.count_if(role == "assistant").alias("answers"), F.count_if(role == "system").alias("explanations"))
        .withColumn("mismatch", mismatch(F.col("questions"), F.col("answers"), F.col("explanations")))
    )


def mismatch(questions: Column, answers: Column, explanations: Column) -> Column:
    return (
        F.when((questions == answers) & (questions == explanations), "aligned")
        .when((answers < questions) & (explanations == questions), "missing_answer_only")
        .when((explanations < questions) & (answers == questions), "missing_explanation_only")
        .otherwise("mixed")
    )


def duplicates(rows: DataFrame, group: str, key: Column) -> DataFrame:
    """Rows whose key recurs in its group, with the key's count and the row's place among its like."""
    keyed = rows.withColumn("key", key)
    alike = Window.partitionBy(group, "key")
    return keyed.withColumn("copies", F.count("*").over(alike)).where("copies > 1")


def grouped_classes(found: DataFrame, group: str, total: DataFrame) -> DataFrame:
    """Class of each group by its share of duplicate rows: clean, some or heavy."""
    per = found.groupBy(group).agg(F.count("*").alias("duplicated"))
    share = F.coalesce("duplicated", F.lit(0)) / F.col("n")
    return total.join(per, group, "left").select(group, "n", F.coalesce("duplicated", F.lit(0)).alias("duplicated"), F.when(share == 0, "clean").when(share < 0.1, "some").otherwise("heavy").alias("class"))


def merge(rows: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The next state: supplied (non-null) values replace, all else stays."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def activated(rows: DataFrame, key: str, chosen: object, flag: str = "is_active") -> DataFrame:
    """Exactly the chosen row is active."""
    return rows.withColumn(flag, F.col(key).eqNullSafe(F.lit(chosen)))


def next_version(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_version"))


def reconciled(incoming: DataFrame, existing: DataFrame, key: str, reason: Column, order: str) -> DataFrame:
    """Each incoming row as invalid (with the reason), duplicate in the file, existing, or created."""
    marked = incoming.withColumn("reason", reason)
    among = Window.partitionBy("ok", key).orderBy(order)
    marked = marked.withColumn("ok", F.col("reason").isNull()).withColumn("turn", F.when(F.col("ok"), F.row_number().over(among)))
    flagged = with_flag(marked, key, existing, "known")
    return flagged.withColumn("outcome", F.when(~F.col("ok"), "invalid").when(F.col("turn") > 1, "duplicate").when(F.col("known"), "existing").otherwise("created")).drop("ok", "turn", "known")


def flat_archive(parents: DataFrame, children: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A row per child, or one for a parent without any, empty text for nulls."""
    joined = parents.join(children, key, "left")
    return joined.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def compared(versions: DataFrame, key: str, a: object, b: object, columns: Sequence[str]) -> DataFrame:
    """Of two versions, which columns differ."""
    left, right = (versions.where(F.col(key) == F.lit(v)).select(*[F.col(c).alias(f"{c}_{s}") for c in columns]) for v, s in ((a, "a"), (b, "b")))
    return left.crossJoin(right).select(*[(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).alias(f"{c}_changed") for c in columns])
