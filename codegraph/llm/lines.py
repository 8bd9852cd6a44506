"""Removal of boilerplate lines by the spread of a line over distinct sites.

A HyperLogLog sketch of the sites is built per line hash and merged by aggregation. Lines whose estimate lies within
`band` of the threshold get an exact distinct count; the others are decided by the estimate. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import key_of, materialise, named, text_of

MIN_SITES, MIN_CHARS, BAND, LG_K = 10, 20, 0.35, 12


def _trimmed(line: Column) -> Column:
    return F.trim(line)


def _line_hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit(2), line).alias("_h2")]


def _lines(docs: DataFrame, min_chars: int, *keep: Column) -> DataFrame:
    """keep, the place and the hashes of each line long enough to be judged."""
    each = docs.select(*keep, F.posexplode(F.split(text_of("_text"), "\n", -1)).alias("_at", "_line"))
    named = [c for c in each.columns if c != "_line"]
    judged = each.select(*named, _trimmed(F.col("_line")).alias("_line")).filter(F.length("_line") >= min_chars)
    return judged.select(*named, *_line_hashes(F.col("_line")))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """Lines on at least min_sites sites: _h1, _h2, _first (the smallest id that has the line), _exact, _sites."""
    lines = _lines(docs, min_chars, F.col("_id"), F.col("_site"))
    spread = lines.groupBy("_h1", "_h2").agg(F.hll_sketch_agg("_site", lg_k).alias("_sketch"), F.min("_id").alias("_first"))
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    # no sketch of fewer sites than the band's lower end can hold a line that reaches the threshold
    judged = spread.withColumn("_sites", F.hll_sketch_estimate("_sketch")).drop("_sketch").filter(F.col("_sites") >= low)
    judged = materialise(judged, "spread")
    near = judged.filter(F.col("_sites") <= high)
    exact = (
        lines.join(near.select("_h1", "_h2"), ["_h1", "_h2"], "left_semi")
        .groupBy("_h1", "_h2")
        .agg(F.countDistinct("_site").alias("_sites"), F.min("_id").alias("_first"))
        .filter(F.col("_sites") >= min_sites)
    )
    sure = judged.filter(F.col("_sites") > high)
    columns = ["_h1", "_h2", "_first", "_sites"]
    return sure.select(*columns, F.lit(False).alias("_exact")).unionByName(exact.select(*columns, F.lit(True).alias("_exact")))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
    min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, band: float = BAND, counts: bool = True,
) -> DataFrame:
    """docs with boilerplate lines taken out of text_col; with counts, n_lines and n_removed follow (for columns of these names).

    Lines end at line feeds; they are compared without outer spaces, and only lines of min_chars characters or more are
    judged. A line found on min_sites distinct sites goes from every document but the one with the smallest id that
    has it, so nothing vanishes from the corpus. Null text stays null with one line and none removed; a null site is
    no site; a line whose ids are all null stays nowhere. Repeated rows are each cleaned. The rest is joined unchanged
    in order, and a text all of whose lines go is empty. An empty table stays empty.
    """
    bare = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(site_col).cast("string").alias("_site"))
    found = boilerplate(bare, min_sites, min_chars, band).select("_h1", "_h2", "_first")
    # by text and not by row: equal texts hold equal lines, and rows need no key of their own
    hits = (
        _lines(bare, min_chars, *key_of(text_of("_text")))
        .join(found, ["_h1", "_h2"])
        .select("_k1", "_k2", "_at", "_first")
        .distinct()  # copies of a text become one before a text's lines meet
        .groupBy("_k1", "_k2")
        .agg(F.collect_list(F.struct("_at", "_first")).alias("_hits"))
    )
    hits = materialise(hits, "hits")  # so that the planner may split the rows of a text that many documents share
    others = [c for c in docs.columns if c != text_col]  # the text travels once
    row = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(F.lit(0).alias("_"), *named(others)).alias("_row"))
    keyed = row.select("*", *key_of(text_of("_text"))).join(hits, ["_k1", "_k2"], "left")
    keyed = keyed.withColumn("_lines", F.split(text_of("_text"), "\n", -1))
    gone = F.transform(F.filter("_hits", lambda x: ~x["_first"].eqNullSafe(F.col("_id"))), lambda x: x["_at"])
    # places that stay, by a hash set: lines are not compared with hits one by one
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    done = keyed.withColumn("_kept", F.when(F.col("_hits").isNull(), F.col("_lines")).otherwise(F.transform(places, lambda i: F.get("_lines", i))))
    clean = F.when(F.col("_text").isNotNull(), F.array_join("_kept", "\n"))
    taken = ("n_lines", "n_removed") if counts else ()
    columns = [clean.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c not in taken]
    if not counts:
        return done.select(*columns)
    n_lines, n_kept = F.size("_lines").cast("long"), F.size("_kept").cast("long")
    return done.select(*columns, n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_removed"))
