"""Next states of tables: idempotent inserts, cascades, repairs, queues, fallbacks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inserted_once(rows: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows and those new ones whose key is neither there nor earlier among them; a null key always counts as new."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    first = new.withColumn("__n", place).where((F.col("__n") == 1) | F.col(key).isNull()).drop("__n")
    return rows.unionByName(first.join(rows.select(key), key, "left_anti").select(rows.columns))


def without_children(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """What a cascading delete of parents leaves of their children."""
    return children.join(gone.select(key), key, "left_anti")


def repaired(parents: DataFrame, children: DataFrame, key: str, status: str, waiting: str, failed: str) -> DataFrame:
    """Waiting parents without any child become failed."""
    has = children.select(key).distinct().withColumn("__has", F.lit(True))
    new = F.when((F.col(status) == waiting) & F.col("__has").isNull(), failed).otherwise(F.col(status))
    return parents.join(has, key, "left").withColumn(status, new).drop("__has")


def stale(updated: Column, now: Column, poll_seconds: float) -> Column:
    """Not updated for ten polls, or for half a minute if that is longer."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) >= int(max(30.0, 10 * poll_seconds) * 1_000_000)


def queue_heads(tasks: DataFrame, lane: str, order: Sequence[str]) -> DataFrame:
    """The first waiting task of each lane in which none is running."""
    waiting = tasks.where("status = 'waiting'")
    busy = tasks.where("status = 'running'").select(lane).distinct()
    first = waiting.withColumn("__n", F.row_number().over(Window.partitionBy(lane).orderBy(*order))).where("__n = 1").drop("__n")
    return first.join(busy, lane, "left_anti").select(tasks.columns)


def fallbacks(models: DataFrame, policies: DataFrame, accounts: DataFrame) -> DataFrame:
    """Models of enabled accounts with their policy, if any: the primary first, then by rank and name."""
    joined = models.join(accounts.where("enabled").select("account_id"), "account_id", "left_semi").join(policies, "model_id", "left")
    order = Window.orderBy(F.desc("is_primary"), "rank", "model_id")
    return joined.withColumn("place", F.row_number().over(order))


def best_of(extracts: Sequence[DataFrame], score: Column) -> DataFrame:
    """Of several extractors' texts of each page the best; ties to the earlier extractor."""
    tagged = [df.select("path", "page", "text", F.lit(i).alias("extractor")) for i, df in enumerate(extracts)]
    best = F.max_by(F.struct("text", "extractor"), F.struct(score.alias("s"), (-F.col("extractor")).alias("e")))
    return reduce(DataFrame.unionByName, tagged).groupBy("path", "page").agg(best.alias("b")).select("path", "page", "b.text", "b.extractor")
