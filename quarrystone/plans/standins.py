"""The test tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.sources.tables import table


def activity(spark: SparkSession, d: str) -> DataFrame:
    """Events as conversations: the type is the subject, a purchase is resolved, an error fell back."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("person_id"),
        F.col("event_type").alias("subject"),
        "event_id",
        "ts",
        (F.col("event_type") == "purchase").alias("resolved"),
        (F.col("event_type") == "error").alias("fallback"),
    )


def people(spark: SparkSession, d: str) -> DataFrame:
    """Customers as students, their nation as the class."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("group_id"))


def groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("group"))


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Line items as usage events."""
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("billing"), F.col("l_quantity").alias("tokens"), F.col("l_shipdate").alias("ts"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the documents, in order."""
    return table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
