"""Usage analytics: overviews, trends over a full calendar, cohorts, portraits, roll-ups.

An activity table has a person, a subject, a time and two flags (resolved,
fallback). Everything is grouped before it is joined, so that joins see a row
per person or per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded, 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, digits))


def scoped(people: DataFrame, role: str, viewer: int | None = None, duties: DataFrame | None = None) -> DataFrame:
    """The people that a viewer may see: all for an admin, own groups' for a teacher, oneself for a student.

    ``duties`` has teacher_id and group_id; a teacher without any sees no one.
    """
    if role == "admin":
        return people
    if role == "student":
        return people.where(F.col("person_id") == F.lit(viewer))
    own = duties.where(F.col("teacher_id") == F.lit(viewer)).select("group_id")
    return people.join(own, "group_id", "left_semi")


def overview(activity: DataFrame) -> DataFrame:
    """Per subject: conversations, share resolved, people; the busiest first."""
    return (
        activity.groupBy("subject")
        .agg(
            F.count("*").alias("conversations"),
            ratio(F.count_if("resolved"), F.count("*")).alias("resolved_rate"),
            F.countDistinct("person_id").alias("people"),
        )
        .orderBy(F.desc("conversations"), "subject")
    )


def mean_turns(messages: DataFrame) -> DataFrame:
    """One row: conversations, messages by users, and their mean per conversation."""
    per = messages.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"))
    return per.agg(F.count("*").alias("conversations"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), ratio(F.sum("turns"), F.count("*"), 2).alias("mean_turns"))


def bucket(day: Column, unit: str) -> Column:
    """First date of the day's period: day, week (from Monday) or month."""
    return F.trunc(day, unit) if unit in ("week", "month") else day


def label(start: Column, unit: str) -> Column:
    return F.date_format(start, "yyyy-MM" if unit == "month" else "yyyy-MM-dd")


def trend(activity: DataFrame, unit: str, start: str, end: str, subjects: Sequence[str] = ()) -> DataFrame:
    """Counts per period from start to end (swapped if need be), zeros included, with a series for all and one per subject."""
    start, end = min(start, end), max(start, end)
    spark = activity.sparkSession
    day = F.col("ts").cast("date")
    inside = activity.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(bucket(day, unit).alias("period"), "subject")
    counts = inside.groupBy("period", "subject").agg(F.count("*").alias("n"))
    named = F.array(F.lit("total"), F.when(F.col("subject").isin(*subjects), F.col("subject"))) if subjects else F.array(F.lit("total"))
    series = counts.select("period", F.explode(named).alias("series"), "n").groupBy("period", "series").agg(F.sum("n").alias("n"))
    ends = [bucket(F.lit(d).cast("date"), unit) for d in (start, end)]
    spine = spark.range(1).select(F.explode(F.sequence(*ends, F.expr(f"INTERVAL 1 {unit}"))).alias("period"))
    names = F.explode(F.array(*map(F.lit, ["total", *dict.fromkeys(subjects)]))).alias("series")
    full = spine.select("period", names)
    return full.join(F.broadcast(series), ["period", "series"], "left").select(label(F.col("period"), unit).alias("period"), "series", F.coalesce("n", F.lit(0)).alias("n"))


def profiles(activity: DataFrame) -> DataFrame:
    """Per person: conversations, share resolved and fallen back, modal subject (ties to the first seen), last activity.

    One scan: counts per person and subject, then per person.
    """
    per = activity.groupBy("person_id", "subject").agg(
        F.count("*").alias("n"),
        F.count_if("resolved").alias("ok"),
        F.count_if("fallback").alias("fell"),
        F.max("ts").alias("last"),
        F.min("event_id").alias("first"),
    )
    return per.groupBy("person_id").agg(
        F.sum("n").alias("conversations"),
        ratio(F.sum("ok"), F.sum("n")).alias("resolved_rate"),
        ratio(F.sum("fell"), F.sum("n")).alias("fallback_rate"),
        F.max("last").alias("last_seen"),
        F.max_by("subject", F.struct("n", -F.col("first"))).alias("focus"),
    )


def portraits(activity: DataFrame, people: DataFrame, limit: int = 12) -> DataFrame:
    """Profiles of people with any activity: most conversations, then lowest resolved rate, then name."""
    return profiles(activity).join(people.select("person_id", "name"), "person_id").orderBy(F.desc("conversations"), "resolved_rate", "name").limit(limit)


def classrooms(activity: DataFrame, people: DataFrame, groups: DataFrame, default: str = "unassigned") -> DataFrame:
    """Per group label: people, conversations, share resolved; groups without activity stay, with zeros."""
    per = activity.groupBy("person_id").agg(F.count("*").alias("n"), F.count_if("resolved").alias("ok"))
    named = people.join(groups, "group_id", "left").withColumn("group", F.coalesce("group", F.lit(default)))
    return (
        named.join(per, "person_id", "left")
        .groupBy("group")
        .agg(
            F.count("*").alias("people"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("conversations"),
            ratio(F.coalesce(F.sum("ok"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).alias("resolved_rate"),
            F.max_by("group_id", F.struct("name", "person_id")).alias("last_group_id"),
        )
    )


def usage_rollup(usage: DataFrame, day: str) -> DataFrame:
    """Requests and tokens by model and billing mode on one UTC day (a range on the time, so that it is pushed down)."""
    first = F.lit(day).cast("date").cast("timestamp_ntz")
    inside = usage.where((F.col("ts") >= first) & (F.col("ts") < first + F.expr("INTERVAL 1 DAY")))
    return inside.groupBy("model", "billing").agg(F.count("*").alias("requests"), F.sum("tokens").cast("long").alias("tokens"))


def status_summary(tasks: DataFrame, active: Sequence[str], done: Sequence[str], failed: Sequence[str]) -> DataFrame:
    """One row of counts: all, active, done, failed and any other."""
    s = F.col("status")
    known = [*active, *done, *failed]
    return tasks.agg(
        F.count("*").alias("total"),
        F.count_if(s.isin(*active)).alias("active"),
        F.count_if(s.isin(*done)).alias("completed"),
        F.count_if(s.isin(*failed)).alias("failed"),
        F.count_if(~s.isin(*known) | s.isNull()).alias("other"),
    )


def shares(counted: DataFrame, name: str, n: str) -> DataFrame:
    """Each row's part of the whole, in percent to one place."""
    return counted.withColumn("share", F.round(100.0 * F.col(n) / F.sum(n).over(Window.partitionBy()), 1)).select(name, n, "share")


def histogram(values: DataFrame, unit: str = "5 minutes") -> DataFrame:
    """Count, rate per second, p95 and p99 per tumbling window and label."""
    seconds = F.expr(f"CAST(INTERVAL {unit} AS INTERVAL SECOND)").cast("long")
    return (
        values.groupBy(F.window(F.col("ts").cast("timestamp"), unit).alias("w"), "label")
        .agg(F.count("*").alias("n"), F.percentile("value", 0.95).alias("p95"), F.percentile("value", 0.99).alias("p99"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "label", "n", F.round(F.col("n") / seconds, 6).alias("per_second"), F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))
    )


def counter_increase(values: DataFrame, labels: Sequence[str], unit: str = "1 hour") -> DataFrame:
    """Events per label and window: the increase of a counter."""
    return values.groupBy(F.window(F.col("ts").cast("timestamp"), unit).alias("w"), *labels).agg(F.count("*").alias("increase")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *labels, "increase")


def running_ratio(hits: DataFrame, key: str, order: Sequence[str], flag: Column) -> DataFrame:
    """The share of hits so far, per key."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("hit_rate", F.round(F.avg(flag.cast("double")).over(so_far), 6))


def group_counts(rows: DataFrame, *labels: str) -> DataFrame:
    """Rows per combination of labels."""
    return rows.groupBy(*labels).agg(F.count("*").alias("n"))


def cube_overview(activity: DataFrame) -> DataFrame:
    """Extension: counts by subject and flag at every level of a cube."""
    return activity.cube("subject", "resolved").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def bucketed(values: DataFrame, bounds: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """A histogram per key: how many values are at most each bound (``le``), and at most infinity.

    Values are counted by the first bound that holds them, so that one row for
    each key and bound is shuffled however many values there are; the sums over
    lower bounds follow. Nulls and NaN are in no bucket. Columns: keys, le, n.
    """
    tops = [*sorted(bounds), float("inf")]
    le = F.element_at(F.filter(F.array(*map(F.lit, tops)), lambda b: F.col("value") <= b), 1)
    per = values.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*keys, le.alias("le")).agg(F.count("*").alias("m"))
    known = F.map_from_entries(F.collect_list(F.struct("le", "m")))
    whole = per.groupBy(*keys).agg(known.alias("at")).select(*keys, "at", F.explode(F.array(*map(F.lit, tops))).alias("le"))
    below = F.aggregate(F.map_values(F.map_filter("at", lambda b, _: b <= F.col("le"))), F.lit(0).cast("long"), lambda s, m: s + m)
    return whole.select(*keys, "le", below.alias("n"))


def bucket_quantiles(histogram: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """Quantiles of cumulative bucket counts (keys, le, n), which add up over sources of counts.

    The bucket that a quantile falls in is taken to be evenly filled, from the
    bound before it (zero before a first positive one). One in the bucket
    without a top gives the greatest bound; no counts at all give null.
    """
    rows = F.array_sort(F.collect_list(F.struct("le", "n")))
    summed = histogram.groupBy(*keys, "le").agg(F.sum("n").alias("n")).groupBy(*keys).agg(rows.alias("b"))

    def quantile(q: float) -> Column:
        wanted = F.col("b")[F.size("b") - 1]["n"] * F.lit(q)
        at = F.array_position(F.transform("b", lambda r: r["n"] >= wanted), True).cast("int")
        top, before = F.get("b", at - 1), F.get("b", at - 2)
        low = F.when(at > 1, before["le"]).otherwise(F.least(F.lit(0.0), top["le"]))
        under = F.coalesce(before["n"], F.lit(0))
        inner = low + (top["le"] - low) * (wanted - under) / F.nullif(top["n"] - under, F.lit(0))
        first = F.when((at == 1) & (top["le"] <= 0), top["le"])
        return F.when(F.col("b")[F.size("b") - 1]["n"] > 0, F.when(top["le"] == float("inf"), before["le"]).otherwise(F.coalesce(first, inner)))

    return summed.select(*keys, *[F.round(quantile(q), 6).alias(name) for name, q in quantiles.items()])
