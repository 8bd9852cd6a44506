"""Incremental snapshots: what changed between two listings, and the upsert of derived rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(old: DataFrame, new: DataFrame, key: str, stamps: list[str]) -> DataFrame:
    """Keys of new that are not in old or whose stamps differ."""
    was = old.select(key, F.struct(*stamps).alias("_was"))
    return new.join(was, key, "left").filter(~F.struct(*stamps).eqNullSafe(F.col("_was"))).select(key)


def removed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.select(key).join(new.select(key), key, "left_anti")


def diff(old: DataFrame, new: DataFrame, key: str, stamps: list[str]) -> DataFrame:
    """(key, change) with changed and removed keys."""
    return changed(old, new, key, stamps).withColumn("change", F.lit("changed")).unionByName(removed(old, new, key).withColumn("change", F.lit("removed")))


def replace_rows(rows: DataFrame, gone: DataFrame, key: str, fresh: DataFrame) -> DataFrame:
    """rows without those whose key is in gone, and the fresh ones."""
    return rows.join(gone.select(key), key, "left_anti").unionByName(fresh)
