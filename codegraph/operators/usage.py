"""Usage and adoption summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import percent

TOP = 5


def by_tool(usage: DataFrame) -> DataFrame:
    return usage.groupBy("tool").agg(F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "tool")


def top_values(usage: DataFrame, value: Column, limit: int = TOP) -> DataFrame:
    """The most frequent values, ties by value; nulls don't count."""
    return usage.select(value.alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "value").limit(limit)


def string_arg(args: Column, name: str) -> Column:
    """A named argument of a VARIANT if it is a string."""
    kind = F.schema_of_variant(F.try_variant_get(args, f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(args, f"$.{name}", "string"))


def first_last(usage: DataFrame, order: str) -> DataFrame:
    """Time stamps of the first and last record in file order, and the number of records."""
    return usage.agg(F.min_by("ts", order).alias("first_ts"), F.max_by("ts", order).alias("last_ts"), F.count(F.lit(1)).alias("calls"))


def adoption(timeline: DataFrame) -> DataFrame:
    """One row: own, grep and search counts, and the rounded share of own among own and grep."""
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    row = timeline.agg(*[count(k).alias(k) for k in ("own", "grep", "search")])
    return row.withColumn("share_pct", percent(F.col("own"), F.col("own") + F.col("grep")))
