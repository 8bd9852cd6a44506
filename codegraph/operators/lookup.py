"""Definition lookup: exact, scoped by a path glob, and ranked suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import matches_glob

SUGGESTIONS, LEAST_QUERY, LEAST_NAME = 12, 3, 4


def find(defs: DataFrame, symbol: str, path_glob: str | None = None) -> DataFrame:
    """Definitions of exactly this name, by file and line. The equality reaches the scan."""
    return defs.filter((F.col("symbol") == symbol) & matches_glob(F.col("file"), path_glob)).orderBy("file", "line", "ord")


def find_fuzzy(defs: DataFrame, query: str, path_glob: str | None = None, limit: int = SUGGESTIONS) -> DataFrame:
    """One definition per name that resembles query: names that begin with it, then hold it, then are held by it.

    Case doesn't count, and names equal but for case are left out; ties go by length, then name. One pass: the first
    definition of each name is the least struct of its group.
    """
    q, name = F.lit(query.lower()), F.lower("symbol")
    score = F.when(name.startswith(q), 0).when(name.contains(q), 1).when((F.length("symbol") >= LEAST_NAME) & q.contains(name), 2)
    scoped = defs.filter(matches_glob(F.col("file"), path_glob) & (name != q)).withColumn("score", score).filter("score is not null")
    rest = [c for c in defs.columns if c not in ("symbol", "file", "line", "ord")]
    first = scoped.groupBy("symbol", "score").agg(F.min(F.struct("file", "line", "ord", *rest)).alias("d"))
    ranked = first.select("symbol", "d.*", "score").orderBy("score", F.length("symbol"), "symbol").limit(limit)
    return ranked


def dedupe_specific(matches: DataFrame) -> DataFrame:
    """One row per (file, symbol, line): the first match, but any kind other than constant goes before a constant."""
    order = Window.partitionBy("file", "symbol", "line").orderBy(F.col("kind") == "constant", "ord")
    named = matches.filter((F.col("symbol") != "") & (F.col("symbol") != "constructor"))
    return named.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
