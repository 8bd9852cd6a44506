"""What the jobs share: configuration, logging, and the session of a command line."""

from __future__ import annotations

import argparse
import contextlib
import json
import logging
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from codegraph.operators.graph import merged

LOG = logging.getLogger("jobs")
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settings(name: str, given: dict | None = None) -> dict:
    """The job's defaults, from the file beside it, with the given values over them; unknown names are an error."""
    known = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    wrong = set(given or {}) - set(known)
    if wrong:
        raise ValueError(f"unknown settings: {', '.join(sorted(wrong))}")
    return known | (given or {})


def arguments(description: str, paths: list[str]) -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=description)
    for name in paths:
        parser.add_argument(f"--{name}", required=True, help="a path that Spark reads or writes, local or remote")
    parser.add_argument("--config", help="a JSON file of settings; those it leaves out keep their defaults")
    return parser


def configured(spark: SparkSession, path: str | None) -> dict:
    """The settings of a JSON file, read by Spark so that it may be remote."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) if path else {}


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, or in a temporary one where none is set and all runs in one process."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or 'file://' + tempfile.gettempdir()).rstrip('/')}/jobs/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Each query made within leaves no shuffle files once it has ended; else they stay until the driver collects its garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


@contextlib.contextmanager
def holding(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes rows which are read more than once to a new folder and gives them back from there, to be merged in joins; in the end no rows stay there, as a checkpoint's would."""
    held = []

    def hold(rows: DataFrame) -> DataFrame:
        held.append((fresh_folder(spark, name), rows.schema))
        rows.write.mode("overwrite").parquet(held[-1][0])
        return merged(spark.read.schema(rows.schema).parquet(held[-1][0]))

    try:
        yield hold
    finally:
        for at, schema in held:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(at)
