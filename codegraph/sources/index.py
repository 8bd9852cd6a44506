"""Parsing source tables: one pass of Python per file, split into tables by JVM expressions."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from ..functions.exprs import shingles
from .files import sources
from .frontend import File, extract

TIER = "syntactic"
TABLES = {
    "defs": "symbol string, kind string, line int, signature string, ord int",
    "edges": "specifier string, kind string, star boolean, names array<struct<imported: string, local: string>>, line int",
    "fingerprints": "name string, line int, types array<string>, shingles array<bigint>",
    "functions": "start int, name string, shown string, cls string, kind string, has_body boolean, line int, branches int, errors int, awaits int, top boolean, returns string, gives string, params array<string>",
    "calls": "caller int, ord int, kind string, form string, receiver string, name string, text string, pos int",
    "types": "name string, kind string, line int, params int",
    "heritage": "name string, parent string, args array<string>, kind string",
    "exports": "exported string, local string",
    "bindings": "scope int, until int, cls string, name string, type string, term string, pos int, via_kind string, via_form string, via_receiver string, via_name string, via_cls string, via_args array<string>",
}
PARSED = "file string, " + ", ".join(f"{t} array<struct<{', '.join(f'{n}: {k}' for n, k in (c.split(' ', 1) for c in cols.split(', ')))}>>" for t, cols in TABLES.items() if t != "edges")
PARSED += ", edges array<struct<specifier: string, kind: string, star: boolean, names: array<struct<imported: string, local: string>>, line: int>>, problems int"
FILES_A_TASK, BYTES_A_TASK = 2000, 2 << 20  # seconds of parsing, some ten megabytes of rows
ROWS_A_FRAME = 200  # files whose rows a task holds at once


def tasks(files: int, size: int = 0) -> int:
    """Into how many tasks Python's work on so many files, of so many bytes in all, is dealt."""
    return max(1, -(-files // FILES_A_TASK), -(-size // BYTES_A_TASK))


def dealt(files: DataFrame, parts: int | None, by: str = "path") -> DataFrame:
    """files by hash of their paths, so that the tasks don't depend on how the table is stored (a small one may be one split); as they are without parts."""
    return files.repartition(parts, by) if parts else files


def parse_files(files: DataFrame, parts: int | None = None) -> DataFrame:
    """A row per source file of (path, content): arrays of rows for every table, and the places that could not be parsed.

    A file that breaks the parser altogether has no rows and problems = -1. parts: see tasks.
    """

    schema = to_arrow_schema(DataType.fromDDL(PARSED))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_FRAME):
                part, rows = whole.slice(at, ROWS_A_FRAME), []
                for path, content, grammar in zip(*(c.to_pylist() for c in part.columns)):
                    try:
                        found = extract(path, content, grammar)
                        problems = found.pop("errors")
                    except Exception:  # noqa: BLE001  one odd file must not end the job; it is reported in problems
                        found, problems = {t: [] for t in TABLES}, -1
                    rows.append({"file": path, **found, "problems": problems})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return dealt(sources(files).select("path", "content", "grammar"), parts).mapInArrow(run, PARSED)


@dataclass
class Tables:
    """The index: DataFrames keyed by file."""

    parsed: DataFrame

    def _rows(self, name: str) -> DataFrame:
        return self.parsed.select("file", F.posexplode(name).alias("at", "r")).select("file", "at", "r.*")

    @property
    def files(self) -> DataFrame:
        return self.parsed.select(F.col("file").alias("path"), "problems")

    @property
    def defs(self) -> DataFrame:
        return self._rows("defs").drop("at").withColumn("tier", F.lit(TIER))

    @property
    def edges(self) -> DataFrame:
        return self._rows("edges").withColumn("edge_id", F.concat_ws("#", "file", "at")).drop("at")

    @property
    def fingerprints(self) -> DataFrame:
        rows = self._rows("fingerprints")
        hashes = ["shingles"] if "shingles" in rows.columns else [shingles(F.col("types")).alias("shingles")]  # an index saved before has none
        return rows.select(F.concat_ws("#", "file", "at").alias("id"), "file", "name", "line", F.size("types").alias("token_count"), *hashes)

    @property
    def functions(self) -> DataFrame:
        return self._rows("functions").withColumn("id", F.concat_ws("#", "file", "start")).drop("at")

    @property
    def calls(self) -> DataFrame:
        return self._rows("calls").withColumn("caller", F.concat_ws("#", "file", "caller")).drop("at")

    def table(self, name: str) -> DataFrame:
        return self._rows(name).drop("at")

    def counts(self) -> DataFrame:
        """One row: files, those with places that could not be parsed, symbols, imports, fingerprints."""
        return self.parsed.agg(
            F.count(F.lit(1)).alias("file_count"), F.count(F.when(F.col("problems") != 0, 1)).alias("problem_count"), *[F.coalesce(F.sum(F.size(t)), F.lit(0)).alias(n) for t, n in (("defs", "symbol_count"), ("edges", "edge_count"), ("fingerprints", "function_count"))]
        )


class SavedTables(Tables):
    """The index as written by save(): one Parquet table each, definitions in order of their names.

    A lookup by name then reads only the row groups that may hold it, and no arrays are exploded.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def files(self) -> DataFrame:
        return self._rows("files")

    def counts(self) -> DataFrame:
        names = {"files": "file_count", "defs": "symbol_count", "edges": "edge_count", "fingerprints": "function_count"}
        found = [self._rows(table).count() for table in names]  # from the files' footers
        problems = self.files.filter("problems <> 0").count()
        return self.spark.createDataFrame([[*found, problems]], ", ".join(f"{n} long" for n in [*names.values(), "problem_count"]))


# What each saved table is ordered by, beside the file: the columns that questions look up.
ORDER = {"defs": "symbol", "edges": "specifier", "functions": "name", "calls": "name", "types": "name", "heritage": "parent", "bindings": "name", "exports": "local", "fingerprints": "name"}


def save(tables: Tables, path: str) -> None:
    """Write every table under path, range-partitioned and sorted by its lookup column."""
    tables.files.write.mode("overwrite").parquet(f"{path}/files")
    for name in TABLES:
        rows = tables._rows(name)
        rows.repartitionByRange(ORDER[name], "file").sortWithinPartitions(ORDER[name], "file").write.mode("overwrite").parquet(f"{path}/{name}")


def occurrences(files: DataFrame, wanted: DataFrame, parts: int | None = None) -> DataFrame:
    """References to names in files: wanted has (file, local) and more; only those files are read and parsed.

    A file nested too deeply to be read has a row without a line. parts: see tasks.
    """
    from ..functions.exprs import reference_kind

    rest = [c for c in wanted.columns if c not in ("file", "local")]
    extra = {f.name: f.dataType.simpleString() for f in wanted.schema if f.name in rest}
    joined = sources(files).select("path", "content", "grammar").join(wanted, F.col("path") == F.col("file")).filter(F.col("content").contains(F.col("local")))

    def run(batches):
        import pandas as pd

        names = ["file", "local", *rest, "line", "column", "snippet", "node", "parent", "field"]
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    found = File(row["file"], row["content"], row["grammar"]).occurrences(row["local"])
                except RecursionError:
                    found = [dict.fromkeys(("line", "column", "snippet", "node", "parent", "field"))]
                out += [{k: row[k] for k in ("file", "local", *rest)} | x for x in found]
            yield pd.DataFrame(out, columns=names).astype({"line": "Int64", "column": "Int64"})

    schema = ", ".join(["file string", "local string", *(f"{n} {t}" for n, t in extra.items()), "line int", "column int", "snippet string", "node string", "parent string", "field string"])
    rows = dealt(joined.select("file", "local", *rest, "content", "grammar"), parts, "file").mapInPandas(run, schema)
    return rows.withColumn("ref_kind", reference_kind(F.col("node"), F.col("parent"), F.col("field"))).drop("node", "parent", "field")


def member_uses(files: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Uses of a name as a member, over files that hold it after a dot; a file nested too deeply to be read has a row without a line. parts: see tasks."""
    near = sources(files).filter(F.col("content").contains("." + name) | F.col("content").contains(f"'{name}'") | F.col("content").contains(f'"{name}"')).select("path", "content", "grammar")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, content, grammar in zip(pdf["path"], pdf["content"], pdf["grammar"]):
                try:
                    out += [{"file": path, "name": name} | x for x in File(path, content, grammar).member_names(name)]
                except RecursionError:
                    out.append({"file": path, "name": name})
            yield pd.DataFrame(out, columns=["file", "name", "line", "column", "snippet", "kind", "form", "receiver", "pos", "cls"]).astype({"pos": "Int64", "line": "Int64", "column": "Int64"})

    return dealt(near, parts).mapInPandas(run, "file string, name string, line int, column int, snippet string, kind string, form string, receiver string, pos int, cls string")
