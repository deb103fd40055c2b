"""Ordered-sequence operators: fills, runs, as-of joins, ranks, relative gates, rolling counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_filled(lines: DataFrame, group: str, order: str, chapter: Column, section: Column) -> DataFrame:
    """The chapter and section in force at each line, and the number of its run.

    ``chapter`` and ``section`` are null where a line is no such heading; a new
    chapter clears the section.
    """
    so_far = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumns({"own_chapter": chapter, "own_section": section})
    marked = marked.withColumns(
        {
            "chapter": F.last("own_chapter", True).over(so_far),
            "chapter_no": F.count("own_chapter").over(so_far),
            "segment": F.count(F.coalesce("own_chapter", "own_section")).over(so_far),
        }
    )
    within = Window.partitionBy(group, "chapter_no").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("section", F.last("own_section", True).over(within)).drop("own_chapter", "own_section", "chapter_no")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, tie: str) -> DataFrame:
    """Each left row with the value of the latest right row of its key at or before its time (null if none).

    Both sides become one timeline per key: a sort and a running last value,
    however many right rows there are, and no row is paired with another.
    ``tie`` orders left rows of one time; right rows of that time come first.
    """
    a = left.select("*", F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("found"))
    b = right.select(key, time, F.lit(0).alias("side"), F.col(value).alias("found"))
    so_far = Window.partitionBy(key).orderBy(time, "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(f"latest_{value}", F.last("found", True).over(so_far)).where("side = 1").select(*left.columns, f"latest_{value}")


def mode_first_seen(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones that seen first."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first"))).alias("m")).select(group, f"m.{value}", "m.n")


def keep_first(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def ordinal_suffix(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """``suffix`` v:1, v:2 ... for rows of a key that recurs, else empty."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    several = F.count("*").over(Window.partitionBy(*key)) > 1
    return rows.withColumn("suffix", F.when(several, F.concat(F.lit("v:"), place)).otherwise(F.lit("")))


def near_best(rows: DataFrame, group: Sequence[str], score: str, delta: float, floor: float) -> DataFrame:
    """Rows that reach the floor and come within ``delta`` of their group's best."""
    best = F.max(score).over(Window.partitionBy(*group))
    return rows.withColumn("best", best).where((F.col(score) >= floor) & (F.col(score) >= F.col("best") - delta)).drop("best")


def rolling_count(rows: DataFrame, key: str, time: Column, seconds: int) -> DataFrame:
    """Rows of the key in the last ``seconds`` seconds, the row itself included."""
    window = Window.partitionBy(key).orderBy("__us").rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("__us", F.unix_micros(time.cast("timestamp"))).withColumn("recent", F.count("*").over(window)).drop("__us")


def last_prompts(messages: DataFrame, n: int, mark: str = "; ", most: int = 500) -> DataFrame:
    """Of each conversation its last ``n`` distinct user messages, oldest first, joined and cut."""
    users = messages.where("role = 'user' AND trim(text) <> ''").groupBy("conv_id", F.trim("text").alias("text")).agg(F.max("turn").alias("turn"))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = users.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= n)
    return kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("all")).select("conv_id", F.substring(F.array_join("all.text", mark), 1, most).alias("seed"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n).drop("back")


def history_before(messages: DataFrame, turn: int) -> DataFrame:
    """Of each conversation what stands before a turn, as ordered role and text."""
    return messages.where(F.col("turn") < turn).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("history"))


def turns_and_stage(messages: DataFrame) -> DataFrame:
    """At each message: user messages so far, and the stage that half of the earlier messages lead to."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = F.floor((F.row_number().over(order) - 1) / 2)
    stage = F.when(done == 0, "initial").when(done >= 3, "fallback").otherwise("hint")
    return messages.withColumns({"user_turns": F.count_if(F.col("role") == "user").over(so_far), "stage": stage})


def first_topic(messages: DataFrame, longest: int = 22, default: str = "untitled") -> DataFrame:
    """The first non-blank user message of each conversation, shortened; or a default."""
    said = F.trim(F.regexp_replace("text", r"\s+", " "))
    user = F.when((F.col("role") == "user") & (said != ""), said)
    first = messages.groupBy("conv_id").agg(F.min_by(user, F.when(user.isNotNull(), F.col("turn"))).alias("t"))
    short = F.when(F.char_length("t") > longest, F.concat(F.substring("t", 1, longest), F.lit("..."))).otherwise(F.col("t"))
    return first.select("conv_id", F.coalesce(short, F.lit(default)).alias("topic"))


def replays(requests: DataFrame, key: Sequence[str], time: str, seconds: int) -> DataFrame:
    """Each request as new, or a replay of one with the same key at most ``seconds`` after the one before it."""
    order = Window.partitionBy(*key).orderBy(time, "event_id")
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(order).cast("timestamp"))
    return requests.withColumn("replayed", F.coalesce(gap <= seconds * 1_000_000, F.lit(False)))


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Extension: session windows, as in a stream with a watermark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.session_window("ts", gap)
    return stamped.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("started"), "n")
