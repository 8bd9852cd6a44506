"""Exact deduplication with skew-safe combining: locally, by salted digest, then over the salts' winners.

Every stage groups by the digest and the full text, so texts are compared byte by byte and a digest collision never
merges two texts. A hot text leaves each map task as one row, meets at most `salts` reducers and only their winners
meet in one: no task ever holds the rows of a group. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, text_of


def _hashed(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    bare = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    return bare.withColumn("_sha", F.unhex(F.sha2("_text", 256)))


def text_classes(docs: DataFrame, id_col: str, text: Column, salts: int) -> DataFrame:
    """One row per distinct text: _sha, _text, _keep (largest id), _n."""
    salted = _hashed(docs, id_col, text).withColumn("_salt", F.spark_partition_id() % salts)
    winners = salted.groupBy("_sha", "_salt", "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    return winners.groupBy("_sha", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, salts: int = 16) -> DataFrame:
    """Per row of docs: its id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. The largest id of a group stays; rows that repeat that id with the same text are all
    marked kept. A null id never wins against another; a group of null ids alone has keep_id null and kept true.
    An empty table gives an empty result; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    text = text_of() if text is None else text
    classes = text_classes(docs, id_col, text, salts)
    narrow = materialise(
        classes.groupBy("_sha").agg(F.count(F.lit(1)).alias("_variants"), F.max("_keep").alias("_keep"), F.max("_n").alias("_n")), "exact"
    )
    rows = _hashed(docs, id_col, text)
    one = rows.drop("_text").join(narrow.filter("_variants = 1").drop("_variants"), "_sha")
    if not narrow.filter("_variants > 1").isEmpty():
        clash = narrow.filter("_variants > 1").select("_sha")
        full = classes.join(clash, "_sha", "left_semi")
        one = one.unionByName(rows.join(full, ["_sha", "_text"]).drop("_text"))
    return one.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
