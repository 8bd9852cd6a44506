"""An index of where symbols stand, kept up over a growing folder of texts; a lookup reads one bucket and no text.

The folder is read as a file stream with a checkpoint: a run takes the files that are new, in batches, and ends. A batch
writes its rows under its own number, so a batch that is repeated after a failure replaces itself. A document that comes
again replaces what was said of it before; with a null text it has no symbols any more. Readers take the newest batch of
each document (`current`).

    <out>/documents/batch=N           doc_id, n_symbols: what the batch told of each document
    <out>/symbols/bucket=B/batch=N    symbol, doc_id, n_refs, first_line, last_line
    <out>/summary/bucket=B            symbol, docs, refs: over the newest batches, written anew by every run
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, arguments, configured, session, settings

DOCUMENTS = "doc_id long, text string"
SEEN = "doc_id long, n_symbols long, batch long"
SYMBOLS = "symbol string, doc_id long, n_refs long, first_line int, last_line int, bucket int, batch long"
SPREAD = 8  # files in which a bucket's rows of a batch are written, at least
CHARS_A_TASK = 4 << 20  # of text: some hundred megabytes while its symbols are counted
SUMMARY = "symbol string, docs long, refs long, bucket int"


def bucket_of(symbol: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")


def tasks(batch: DataFrame) -> int:
    """Into how many tasks a batch is dealt: they get more with its texts, not larger."""
    return 1 + (batch.agg(F.sum(F.length("text"))).first()[0] or 0) // CHARS_A_TASK


def newest(batch: DataFrame, parts: int) -> DataFrame:
    """One row a document, dealt by documents: that of the newest file; of several in one file the largest text, a null one before all."""
    return batch.filter("doc_id is not null").repartition(parts, "doc_id").groupBy("doc_id").agg(F.max_by("text", F.struct("modified", "text")).alias("text"))


def places(docs: DataFrame, symbol: str) -> DataFrame:
    """(doc_id, symbol, n_refs, first_line, last_line): lines end at line feeds and count from 1."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    each = lines.select("doc_id", (F.col("at") + 1).alias("at"), F.explode(F.regexp_extract_all("line", F.lit(symbol), 0)).alias("symbol"))
    return each.groupBy("doc_id", "symbol").agg(F.count(F.lit(1)).alias("n_refs"), F.min("at").alias("first_line"), F.max("at").alias("last_line"))


def writer(out: str, symbol: str, buckets: int):
    """A foreachBatch function; each batch owns the partitions of its number, and writing them again replaces them."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        put = lambda df, name, by: df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{out}/{name}")
        parts = tasks(batch)
        found = places(newest(batch, parts).filter("text is not null"), symbol).withColumn("bucket", bucket_of(F.col("symbol"), buckets))
        spread = max(SPREAD, -(-parts // buckets))
        put(found.repartition(parts, "bucket", F.pmod(F.hash("doc_id"), F.lit(spread))), "symbols", ["bucket", "batch"])
        # written last: from here on the batch counts
        sizes = rows(spark, f"{out}/symbols", SYMBOLS).filter(F.col("batch") == number).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_symbols"))
        put(batch.select("doc_id").filter("doc_id is not null").distinct().join(sizes, "doc_id", "left").na.fill(0, ["n_symbols"]), "documents", ["batch"])
        LOG.info("reference_index: wrote batch %d", number)

    return write


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def watched(spark: SparkSession, path: str) -> str:
    """The path as a file stream takes it: a folder or pattern as it is, a single file as a pattern that only it matches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if system.exists(at) and system.getFileStatus(at).isFile() else path


def rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is written at the path; no rows before the first run has written any."""
    return spark.read.schema(schema).parquet(path) if there(spark, path) else spark.createDataFrame([], schema)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The index as it stands: symbol, doc_id, n_refs, first_line, last_line, bucket."""
    last = rows(spark, f"{out}/documents", SEEN).groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows(spark, f"{out}/symbols", SYMBOLS).join(last, ["doc_id", "batch"]).select("symbol", "doc_id", "n_refs", "first_line", "last_line", "bucket")


def lookup(spark: SparkSession, out: str, symbol: str) -> DataFrame:
    """Where a symbol stands (doc_id, n_refs, first_line, last_line): reads the files of its bucket alone, and which batches count."""
    known = kept_settings(spark, out)
    own = F.col("bucket") == bucket_of(F.lit(symbol), known["buckets"])
    hits = rows(spark, f"{out}/symbols", SYMBOLS).filter(own & (F.col("symbol") == symbol))
    last = rows(spark, f"{out}/documents", SEEN).groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return hits.join(last, ["doc_id", "batch"]).select("doc_id", "n_refs", "first_line", "last_line")


def kept_settings(spark: SparkSession, out: str) -> dict:
    row = spark.read.schema("symbol string, buckets int").json(f"{out}/settings").first()
    return row.asDict() if row else {}


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Take what is new at `documents` (Parquet: DOCUMENTS and more) into the index at `out`, write the summary anew, and tell what was done.

    Rows without a doc_id are left out. A file is taken once, under the path it first had; put a new text of a document
    into a new file. An index keeps the settings of its first run; others are an error.
    """
    known = settings("reference_index", config)
    own = {k: known[k] for k in ("symbol", "buckets")}
    kept = kept_settings(spark, out) if there(spark, f"{out}/settings") else {}
    if kept and kept != own:
        raise ValueError(f"the index at {out} was made with {kept}")
    if not kept:
        spark.createDataFrame([tuple(own.values())], "symbol string, buckets int").coalesce(1).write.mode("overwrite").json(f"{out}/settings")
    before = rows(spark, f"{out}/documents", SEEN).count()
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", known["files_per_batch"]).option("maxFileAge", "36500d").parquet(watched(spark, documents))
    stream = stream.select("doc_id", "text", F.col("_metadata.file_modification_time").alias("modified"))
    query = stream.writeStream.foreachBatch(writer(out, known["symbol"], known["buckets"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    summary = current(spark, out).groupBy("bucket", "symbol").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_refs").alias("refs"))
    summary.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/summary")
    seen = rows(spark, f"{out}/documents", SEEN)
    told = {"taken": seen.count() - before, "documents": seen.select("doc_id").distinct().count(), "symbols": spark.read.schema(SUMMARY).parquet(f"{out}/summary").count()}
    LOG.info("reference_index: took %(taken)d documents; the index has %(documents)d documents and %(symbols)d symbols", told)
    return told


def main() -> None:
    args = arguments(__doc__.splitlines()[0], ["documents", "out", "checkpoint"]).parse_args()
    spark = session("reference_index")
    try:
        run(spark, args.documents, args.out, args.checkpoint, configured(spark, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
