"""The corpus pipeline: documents in, packed training sequences out, in five stages.

Each stage takes what its predecessor kept as `docs` and reads nothing else of documents; every stage but the last
returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegraph.llm.decontam import decontaminate
from codegraph.llm.langid import keep_identified
from codegraph.llm.lines import line_dedup
from codegraph.llm.nearsets import similar_dedup
from codegraph.llm.packing import pack
from codegraph.llm.queries import tokenizer_path
from codegraph.llm.shared import materialise, named, table

ORACLE_SQL = None  # learned labels, components and a packing plan are beyond SQL; tests/llm holds the stages against brute force


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model places in a language; null texts and those without a letter go."""
    return keep_identified(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines taken out of the texts; n_chars follows the text. No document goes."""
    clean = line_dedup(docs, counts=False)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*named(docs.columns))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: texts whose word 5-grams are 0.8 similar or more, and chains of them.

    SimHash fingerprints that meet under Golay keys are compared exactly first; their four bits miss most copies of this
    similarity (README), so a prefix join of the 5-gram sets then finds the rest.
    """
    return similar_dedup(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash),
    ("decontaminate", decontaminate_stage),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
