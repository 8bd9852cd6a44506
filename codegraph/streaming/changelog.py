"""An extension: a stream of source changes applied to index tables, and a running count of tool calls.

The batch engine polls for changes; here a stream of (path, version, content, deleted) rows is merged as it comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.index import TABLES, parse_files

CHANGES = "path string, version long, content string, deleted boolean"


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path."""
    order = Window.partitionBy("path").orderBy(F.desc("version"))
    return changes.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def upsert(target: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends each batch's newest rows, keyed by path and version, under the batch's own folder.

    Writing a batch again writes the same folder, so a repeated batch changes nothing; `current` picks the newest version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        last = latest(batch).persist()
        parsed = parse_files(last.filter(~F.coalesce("deleted", F.lit(False))).select("path", "content"))
        rows = last.select(F.col("path").alias("file"), "version", "deleted").join(parsed, "file", "left")
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        last.unpersist()

    return write


def start(changes: DataFrame, target: str, checkpoint: str):
    """Run the merge; changes is a streaming DataFrame of CHANGES."""
    return changes.writeStream.foreachBatch(upsert(target)).option("checkpointLocation", checkpoint).start()


def current(written: DataFrame) -> DataFrame:
    """The newest row of each file, deleted ones left out, in the shape of the parsed index."""
    order = Window.partitionBy("file").orderBy(F.desc("version"), F.desc("batch"))
    newest = written.withColumn("_n", F.row_number().over(order)).filter("_n = 1 and not coalesce(deleted, false)")
    return newest.select("file", *[t for t in TABLES if t != "edges"], "edges", "problems")


def tool_counts(calls: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Calls per tool and window of event time, over a streaming (ts timestamp, tool string)."""
    return calls.withWatermark("ts", lateness).groupBy(F.window("ts", window), "tool").agg(F.count(F.lit(1)).alias("calls")).select("window.start", "tool", "calls")
