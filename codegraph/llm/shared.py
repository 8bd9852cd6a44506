"""What the corpus operators share: the shared working folder, written intermediate tables, text keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_BYTES = 4 << 20
BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_OWN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (only where none is set and all run in one process, as in tests) a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="codegraph-")
    sc.setCheckpointDir(made)
    return made


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed by purge(), at the latest when the driver's Python ends."""
    path = f"{shared_dir(spark)}/codegraph-work/{name}-{uuid.uuid4().hex}"
    _OWN.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def purge() -> None:
    """Delete the intermediate tables made so far; results that still read them must be written first."""
    while _OWN:
        spark, path = _OWN.pop()
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  at exit the JVM may be gone already
            return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop-style path and the path in it, for use in tasks."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    scheme, colon, rest = path.partition("://")
    if not colon:
        return fs.LocalFileSystem(), path
    scheme = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme)  # the other names of Hadoop's clients
    return fs.FileSystem.from_uri(f"{scheme}://{rest}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(columns: list[str]) -> list[Column]:
    """The columns of these names, whatever characters they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def text_of(column: str | Column = "text") -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def key_of(column: Column) -> list[Column]:
    """Two differently seeded 64-bit hashes: a 128-bit key of a text (columns _k1, _k2)."""
    return [F.xxhash64(column).alias("_k1"), F.xxhash64(F.lit(1), column).alias("_k2")]


Batches = Iterator[pa.RecordBatch]


def map_batches(df: DataFrame, f: Callable[[Batches], Batches], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(f, schema) with batches bounded in bytes, so that long texts don't make large ones.

    The bound is the session's where it sets one; else it is set to BATCH_BYTES for the session.
    """
    spark = df.sparkSession
    if spark.conf.get(BYTES_PER_BATCH, None) is None:
        spark.conf.set(BYTES_PER_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def with_text(docs: DataFrame, text_col: str, keep: list[str]) -> tuple[DataFrame, Callable[[pa.RecordBatch], tuple[pa.Array, pa.Array]]]:
    """A struct `row` of the kept columns, beside it the text where it isn't kept; and a function from a batch to (texts, rows)."""
    row = F.struct(*named(keep)).alias("row")
    if text_col in keep:
        return docs.select(row), lambda batch: (batch.column(0).field(text_col), batch.column(0))
    return docs.select(row, F.col(text_col).alias("text")), lambda batch: (batch.column(1), batch.column(0))
